"""An FM-index over words: a wavelet matrix of the Burrows-Wheeler transform, backward search for many queries at once."""

from __future__ import annotations

import numpy as np

from lodestar.llm import kernel as K


class WaveletMatrix:
    """Rank queries over a sequence of small integers: one bit vector per level, counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        s = symbols
        for level in range(self.bits - 1, -1, -1):
            one = (s >> level & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(len(s) // 64 + 1, K.U)
            words.view(np.uint8)[: len(packed)] = packed
            before = K.counts_before(np.bitwise_count(words))[:-1].astype(np.int32)
            zeros = int(len(s) - one.sum())
            self.levels.append((words, before, zeros))
            s = np.concatenate([s[~one], s[one]])
        self.start = np.zeros(sigma, np.int64)  # where each symbol's run starts below the last level
        if len(s):
            new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            self.start[s[new]] = new

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        i = at.astype(np.int64)
        for k, (words, before, zeros) in enumerate(self.levels):
            w = i >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((K.U(1) << (i & 63).astype(K.U)) - K.U(1)))
            bit = symbol >> (self.bits - 1 - k) & 1 > 0
            i = np.where(bit, zeros + ones, i - ones)
        return i - self.start[symbol]


def suffix_array(s: np.ndarray, depths: list[np.ndarray]) -> np.ndarray:
    """Suffixes in order, by prefix doubling; `depths` gets the ranks by the first 1, 2, 4 ... symbols."""
    n = len(s)
    rank, k = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    depths.append(rank)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.append(False, ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        k *= 2
        depths.append(rank)
        if k >= n or int(new.sum()) == n - 1:
            return order


class Marks:
    """A bit vector with rank, and the nearest mark at or before and after a position: 128 bits for 64 positions."""

    def __init__(self, flag: np.ndarray) -> None:
        packed = np.packbits(flag, bitorder="little")
        self.words = np.zeros(len(flag) // 64 + 1, K.U)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = K.counts_before(np.bitwise_count(self.words))[:-1].astype(np.int32)
        some = np.flatnonzero(self.words).astype(np.int32)
        slot = np.arange(len(self.words))
        at = np.searchsorted(some, slot, side="right")
        self.last = some[np.maximum(at - 1, 0)] if len(some) else np.zeros(len(slot), np.int32)  # the last word with a mark, up to this one

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each position."""
        w = at >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((K.U(1) << (at & 63).astype(K.U)) - K.U(1)))

    def at_or_before(self, at: np.ndarray) -> np.ndarray:
        """The last mark at or before each position; there is one at 0."""
        w = at >> 6
        x = self.words[w] & (K.U(0xFFFFFFFFFFFFFFFF) >> (K.U(63) - (at & 63).astype(K.U)))
        none = x == 0
        w = np.where(none, self.last[np.maximum(w - 1, 0)], w)
        x = np.where(none, self.words[w], x)
        for k in (1, 2, 4, 8, 16, 32):
            x = x | (x >> K.U(k))
        return (w.astype(np.int64) << 6) + np.bitwise_count(x).astype(np.int64) - 1


class FMIndex:
    """Index of texts (word hashes, one owner each) for matching statistics up to `depth` words.

    For every depth up to `depth` it has a bit per suffix: its first words, so many, differ from those of the suffix
    before. So a match is shortened on the right by looking for the nearest marks, and at full depth the mark's rank
    leads to the least owner of the range. With the wavelet matrix a word takes about 26 + 1.5 log2(alphabet) bits, and
    8 bytes for each different run of `depth` words.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, owner: np.ndarray, depth: int) -> None:
        n_texts = len(first) - 1
        self.depth = depth
        self.alphabet, code = np.unique(words, return_inverse=True)
        self.sigma = len(self.alphabet) + 1
        n = len(words) + n_texts
        where = np.arange(len(words)) + np.repeat(np.arange(n_texts), np.diff(first))
        ends = first[1:] + np.arange(n_texts)
        s = np.empty(n, np.int64)
        s[where], s[ends] = code + n_texts, np.arange(n_texts)  # every text ends with a symbol of its own
        ranks: list[np.ndarray] = []
        sa = suffix_array(s, ranks)
        self.n = n
        plain = np.zeros(n, np.int64)
        plain[where] = code + 1
        self.bwt = WaveletMatrix(plain[sa - 1], self.sigma)
        self.before = K.counts_before(np.bincount(plain, minlength=self.sigma))[:-1]
        self.marks: list[Marks | None] = [None]
        flag = np.ones(n + 1, bool)  # the end is a mark too
        for d in range(1, depth + 1):
            p = min(d.bit_length() - 1, len(ranks) - 1)
            r, step = ranks[p], d - (1 << p)
            same = r[sa[1:]] == r[sa[:-1]]
            if step > 0:
                far = np.minimum(sa + step, n - 1)
                same &= r[far[1:]] == r[far[:-1]]
            flag[1:n] = ~same
            self.marks.append(Marks(flag))
        owners = np.repeat(owner, np.diff(first) + 1)[sa]
        self.owner = np.minimum.reduceat(owners, np.flatnonzero(flag[:n]))

    def shorter(self, depth: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the first `depth` words of what the ranges lo to hi have in common."""
        out_lo, out_hi = np.zeros(len(lo), np.int64), np.full(len(hi), self.n, np.int64)
        for d in np.unique(depth[depth > 0]).tolist():
            at = np.flatnonzero(depth == d)
            m = self.marks[d]
            out_lo[at] = m.at_or_before(lo[at])
            out_hi[at] = self.next(d, hi[at])
        return out_lo, out_hi

    def next(self, d: int, at: np.ndarray) -> np.ndarray:
        """The first mark of depth d at or after each position (a range's end is never past the last mark)."""
        m = self.marks[d]
        w = at >> 6
        x = m.words[w] & (K.U(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(K.U))
        none = np.flatnonzero(x == 0)
        while len(none):
            w[none] += 1
            x[none] = m.words[w[none]]
            none = none[x[none] == 0]
        return (w << 6) + np.bitwise_count((x & (~x + K.U(1))) - K.U(1)).astype(np.int64)

    def matches(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """As owners(), with -1 for what is not indexed."""
        found, least = self.owners(words, first)
        return np.where(found, least, -1)

    def owners(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of each query: whether the `depth` words that start there are indexed, and their least owner.

        Backward search, all queries in step: a match is extended to the left by one rank query for each end of its
        range; where that fails it is shortened on the right and tried again.
        """
        slot = np.searchsorted(self.alphabet, words)
        slot = np.minimum(slot, len(self.alphabet) - 1)
        code = np.where(self.alphabet[slot] == words, slot + 1, 0)
        found, out = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at, stop = first[1:].copy(), first[:-1]
        length = np.zeros(len(at), np.int64)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        live = np.flatnonzero(at > stop)
        while len(live):
            i, c = at[live] - 1, code[at[live] - 1]
            a, b, k = lo[live], hi[live], length[live]
            full = np.flatnonzero(k == self.depth)
            if len(full):
                a[full], b[full] = self.shorter(np.full(len(full), self.depth - 1), a[full], b[full])
                k[full] -= 1
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([a, b])) + np.concatenate([self.before[c]] * 2)
            x, y = both[: len(live)], both[len(live) :]
            known = c > 0
            good = known & (x < y)
            failed = np.flatnonzero(known & ~good)
            new_lo, new_hi = np.where(good, x, 0), np.where(good, y, self.n)
            new_length = np.where(good, k + 1, 0)
            if len(failed):
                less = np.maximum(k[failed] - 1, 0)
                new_lo[failed], new_hi[failed] = self.shorter(less, a[failed], b[failed])
                new_length[failed] = less
                # a word that stands nowhere after the empty match is not indexed in front of anything: go on
                dead = failed[k[failed] == 0]
                good_step = np.ones(len(live), bool)
                good_step[failed] = False
                good_step[dead] = True
            else:
                good_step = np.ones(len(live), bool)
            lo[live], hi[live], length[live] = new_lo, new_hi, new_length
            hit = good & (new_length == self.depth)
            found[i[hit]] = True
            out[i[hit]] = self.owner[self.marks[self.depth].rank(x[hit])]
            at[live] = np.where(good_step, i, at[live])
            live = live[at[live] > stop[live]]
        return found, out
