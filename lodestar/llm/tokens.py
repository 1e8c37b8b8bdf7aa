"""Batch encoding of whole texts with a public tokenizer file, by the `tokenizers` library.

The two byte-pair files of this box split a text into pieces (a word with the space before it, say) and encode each piece
by itself. So the library is asked once per distinct piece: pieces are cut and hashed for a whole block at a time, new
ones go to `encode_batch` together, in batches balanced by bytes, and every further occurrence is a table lookup. The
cutting rule used here holds for "plain" bytes: ASCII and the letters U+00C0-U+00FF, without an apostrophe or the opening
of a special token. Whatever else stands in a text makes one piece of the stretch around it, from the last safe boundary
before it to the next one after it, and the library splits that stretch itself. A safe boundary is a single space between
two ASCII letters or digits, before which a piece ends in any case. So results are the library's own for every text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from lodestar.llm import kernel as K

#: An encoder keeps at most so many pieces, of at most so many bytes; when full it goes on with those that were met again.
MAX_PIECES, MAX_PIECE_BYTES = 1 << 19, 64
#: The library gets texts in batches of about so many bytes.
PART_BYTES = 1 << 16
#: A space between two ASCII letters or digits: a piece always ends before it, in both files.
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

_SPACE = K.table((0x20, 0x20), (0x09, 0x0D))
_LETTER = K.table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_DIGIT = K.table((0x30, 0x39))
_CLASS = np.full(256, 3, np.uint8)
_CLASS[_LETTER], _CLASS[_DIGIT], _CLASS[_SPACE] = 1, 2, 0
_LEAD = K.table((0xC0, 0xFF))
#: Bytes that can make a place not plain, by themselves or with the next one.
_ASK = _LEAD | K.table((0x27, 0x27), (0x3C, 0x3C))
_SIMPLE = K.table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))

_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The process's encoder for a tokenizer file; Python workers live on, so its table serves many batches."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]


def safe_parts(text: str, limit: int = PART_BYTES) -> list[str]:
    """A text cut at safe boundaries into parts of about `limit` characters; one with no boundary stays whole."""
    if len(text) <= limit:
        return [text]
    parts, at = [], 0
    while len(text) - at > limit:
        m = SAFE.search(text, at + limit)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


def batches_by_bytes(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about PART_BYTES; a longer one is a run of its own."""
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) <= PART_BYTES):
            held += len(texts[b])
            b += 1
        yield a, b
        a = b


class PieceTable:
    """Ids of pieces by their hashes, in sorted arrays."""

    def __init__(self) -> None:
        self.key, self.at, self.size = np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.key)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.key):
            return np.full(len(h), -1)
        row = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        hit = self.key[row] == h
        self.again[row[hit]] = True
        return np.where(hit, row, -1)

    def add(self, h: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """New pieces with the numbers of their ids, and all ids one after the other."""
        if len(self.key) + len(h) > MAX_PIECES:
            keep = np.flatnonzero(self.again)
            if len(keep) + len(h) > MAX_PIECES:
                keep = keep[:0]
            self.flat = self.flat[K.ranges(self.at[keep], self.size[keep].astype(np.int64))]
            self.key, self.size = self.key[keep], self.size[keep]
            self.at = K.counts_before(self.size)[:-1]
            self.again = np.zeros(len(keep), bool)
        order = np.argsort(h)
        at = K.counts_before(size)[:-1] + len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        place = np.searchsorted(self.key, h[order])
        self.key, self.at, self.size = (np.insert(a, place, b[order]) for a, b in ((self.key, h), (self.at, at), (self.size, size)))
        self.again = np.insert(self.again, place, False)


class BatchEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        opened = all(t["content"].startswith("<|") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
        self.kind = ""
        if opened and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.kind = "spaced"
        elif opened and pre.get("type") == "Sequence" and [x.get("type") for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "lower"
        self.table = PieceTable()

    def library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, all ids) of texts, straight from the library, in batches balanced by their bytes."""
        sizes, ids = np.zeros(len(texts), np.int32), []
        for a, b in batches_by_bytes(texts):
            for i, e in enumerate(self.lib.encode_batch([t.decode() for t in texts[a:b]], add_special_tokens=False), a):
                own = e.ids
                sizes[i] = len(own)
                ids += own
        return sizes, np.array(ids, np.uint32)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As library(), for pieces that are words alone (" word" or "word"): many in one text, told apart by word_ids."""
        sizes, ids = [], []
        for a, b in batches_by_bytes(texts):
            joined = (b" " if self.kind == "lower" else b"").join(texts[a:b]).decode()
            e = self.lib.encode(joined, add_special_tokens=False)
            own, word = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
            cut = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            if len(cut) != b - a:  # not the words that went in: ask for each
                size, own = self.library(texts[a:b])
            else:
                size = np.diff(np.append(cut, len(word)))
            sizes.append(size)
            ids.append(own)
        return np.concatenate(sizes).astype(np.int32), np.concatenate(ids)

    def odd_stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the stretches that hold a byte which is not plain; whole documents for other tokenizers."""
        if not self.kind:
            some = np.diff(offsets) > 0
            return offsets[:-1][some], offsets[1:][some]
        ask = np.flatnonzero(_ASK[data])
        here, after = data[ask], np.append(data, np.uint8(0))[ask + 1]
        odd = ask[(here == 0x27) | (_LEAD[here] & (here != 0xC3)) | ((here == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((here == 0x3C) & (after == 0x7C))]
        if not len(odd):
            return odd, odd
        space = np.flatnonzero(data[1:-1] == 0x20) + 1
        space = space[_SIMPLE[data[space - 1]] & _SIMPLE[data[space + 1]]]
        edge = np.union1d(offsets, space)
        at = np.unique(np.searchsorted(edge, odd, side="right") - 1)
        return edge[at], edge[at + 1]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, piece starts, piece ends) of a block of texts."""
        n = len(data)
        odd_start, odd_end = self.odd_stretches(data, offsets)
        raw = data
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        if self.kind == "lower":
            low = K.LOWER[data]
            second = np.zeros(n, bool)
            second[1:] = data[:-1] == 0xC3
            up = second & (data <= 0x9E) & (data != 0x97)
            data = np.where(up, low + 0x20, low).astype(np.uint8)
        c = _CLASS[data]
        space = np.ones(n + 2, bool)
        space[1:-1] = c == 0
        here, before, after = space[1:-1], space[:-2], space[2:]
        changed = np.ones(n, bool)
        changed[1:] = c[1:] != c[:-1]
        start = np.zeros(n + 1, bool)
        if self.kind == "lower":
            start[:-1] = ~here & (changed | first[:-1] | (c == 2))
            stop = start | first
            stop[:-1] |= here
        else:
            last = first[1:]
            unspaced = np.ones(n, bool)
            unspaced[1:] = data[:-1] != 0x20
            start[:-1] = first[:-1] | (here & (~before | (~after & ~last))) | (~here & np.where(before, unspaced, changed))
            stop = start | first
        if len(odd_start):
            inside = np.zeros(n + 1, np.int32)
            inside[odd_start] += 1
            np.subtract.at(inside, odd_end, 1)
            inside = np.cumsum(inside) > 0
            start[inside], stop[inside] = False, False
            start[odd_start] = True
            stop[odd_start], stop[odd_end] = True, True
            data = np.where(inside[:-1], raw, data)  # as written: the library normalizes a stretch itself
        s, stop = np.flatnonzero(start), np.flatnonzero(stop)
        return data, s, stop[np.searchsorted(stop, s, side="right")]

    def word_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which pieces are letters only; in a file that keeps spaces, a space and then letters only."""
        if not self.kind:
            return np.zeros(len(start), bool)
        other = K.counts_before(_CLASS[data] != 1)
        head = np.zeros(len(start), np.int64) if self.kind == "lower" else (data[start] == 0x20).astype(np.int64)
        plain = (other[end] - other[start + head] == 0) & (end - start > head)
        odd = K.counts_before(_LEAD[data] & (data != 0xC3))
        return plain & (odd[end] == odd[start]) & (head > 0 if self.kind == "spaced" else True)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct piece of each piece, first piece of each document; of the distinct pieces: numbers of ids, place of the first, all ids)."""
        none = np.zeros(0, np.int64)
        if not len(data):
            return none, np.zeros(len(offsets), np.int64), none, none, np.zeros(0, np.uint32)
        low, s, e = self.pieces(data, offsets)
        which, distinct = pd.factorize(K.hash_spans(low, s, e))
        row = self.table.find(distinct)
        old, new = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        size, at = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        size[old] = self.table.size[row[old]]
        known = self.table.flat[K.ranges(self.table.at[row[old]], size[old])]
        at[old] = K.counts_before(size[old])[:-1]
        flat = known
        if len(new):
            one = np.empty(len(distinct), np.int64)
            one[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            one = one[new]
            word = self.word_pieces(low, s[one], e[one])
            one, new = np.concatenate([one[word], one[~word]]), np.concatenate([new[word], new[~word]])
            n_words, raw = int(word.sum()), low.tobytes()
            texts = [raw[x:y] for x, y in zip(s[one].tolist(), e[one].tolist(), strict=True)]
            got = [f(t) for f, t in ((self.words, texts[:n_words]), (self.library, texts[n_words:])) if t]
            sizes, ids = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            size[new] = sizes
            own = K.counts_before(sizes)[:-1]
            at[new] = own + len(known)
            flat = np.concatenate([known, ids])
            short = e[one] - s[one] <= MAX_PIECE_BYTES
            if short.any():
                self.table.add(distinct[new][short], sizes[short], ids[K.ranges(own[short], sizes[short].astype(np.int64))])
        return which, np.searchsorted(s, offsets), size, at, flat

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of every text (null: 0)."""
        out = np.zeros(len(column), np.int64)
        for a, b, data, off in K.blocks(column):
            which, first, size, _, _ = self.block(data, off)
            out[a:b] = np.diff(K.counts_before(size[which])[first])
        return out

    def ids(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) for blocks of rows; `end_id` follows each text."""
        for a, b, data, off in K.blocks(column):
            which, first, size, at, flat = self.block(data, off)
            every = size[which]
            ids = flat[K.ranges(at[which], every)]
            offsets = K.counts_before(every)[first]
            if end_id is not None:
                own = np.full(len(ids) + b - a, end_id, np.uint32)
                place = np.ones(len(own), bool)
                offsets = offsets + np.arange(b - a + 1)
                place[offsets[1:] - 1] = False
                own[place] = ids
                ids = own
            yield a, b, ids, offsets
