"""Packing of tokenized documents into sequences of a fixed capacity by minimum bin slack.

Whole windows of a document become sequences by themselves. What remains of each (less than a window) waits in a pool
by length. A sequence starts with the largest piece that waits; a subset-sum dynamic program over a bitset (bit s: some
multiset of waiting lengths sums to s) finds the fill closest to the capacity, and backtracking through the saved
bitsets gives how many pieces of each length it takes. A multiset that fits is used again as often as the counts allow,
so the number of programs follows the number of different lengths. Where nothing fits exactly a piece is cut.

Each task packs its own rows; the less than one sequence that it has left goes to a second level, where one task takes
the rests of many, and so on, until one rest (under a sequence for the whole corpus) is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import Table, strip_to
from lodestar.llm.tokens import encoder

#: A pool is packed when it holds so many tokens.
POOL_TOKENS = 2 << 20
#: Tasks whose rests go to one task of the next level.
FAN_IN = 64

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, closed boolean, part long"


def best_fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths, within `counts` (by length), whose sum is closest to `capacity` from below."""
    if capacity <= 0:
        return {}
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    target = 1 << capacity
    for length in np.flatnonzero(counts[: capacity + 1])[::-1].tolist():
        left, m = min(int(counts[length]), capacity // length), 1
        while left > 0:
            take = min(m, left)
            before = reach
            reach |= (reach << (length * take)) & mask
            if reach != before:
                steps.append((length, take, before))
            left -= take
            m *= 2
        if reach & target:
            break
    s = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> s & 1:
            used[length] = used.get(length, 0) + take
            s -= length * take
    return used


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens); `rows` holds what is ready."""

    def __init__(self, capacity: int, first_sequence: int, part: int) -> None:
        self.capacity, self.sequence, self.part = capacity, first_sequence, part
        self.pool: list[list[tuple]] = [[] for _ in range(capacity)]
        self.counts = np.zeros(capacity, np.int64)
        self.held = 0
        self.rows: list[tuple] = []

    def put(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        """A piece of at most the capacity; one of exactly the capacity is a sequence."""
        n = len(ids)
        if n == self.capacity:
            self.emit([(doc_id, start, ids, total)])
        elif n:
            self.pool[n].append((doc_id, start, ids, total))
            self.counts[n] += 1
            self.held += n

    def windows(self, doc_id: int | None, ids: np.ndarray, total: int) -> None:
        """Whole sequences of one document."""
        raw, step = ids.tobytes(), 4 * self.capacity
        for k in range(len(ids) // self.capacity):
            self.rows.append((doc_id, k * self.capacity, self.capacity, raw[k * step : (k + 1) * step], total, self.sequence, 0, True, self.part))
            self.sequence += 1

    def take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.held -= length
        return self.pool[length].pop()

    def emit(self, pieces: list[tuple], closed: bool = True) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), total, self.sequence, at, closed, self.part))
            at += len(ids)
        self.sequence += 1

    def pack(self, down_to: int) -> None:
        """Makes full sequences until fewer than `down_to` tokens wait (or than a sequence)."""
        while self.held >= max(down_to, self.capacity):
            largest = int(np.flatnonzero(self.counts)[-1])
            self.counts[largest] -= 1
            used = best_fill(self.counts, self.capacity - largest)
            self.counts[largest] += 1
            used[largest] = used.get(largest, 0) + 1
            slack = self.capacity - sum(k * v for k, v in used.items())
            times = 1 if slack else min(int(self.counts[k]) // v for k, v in used.items())
            for _ in range(times):
                pieces = [self.take(k) for k in sorted(used, reverse=True) for _ in range(used[k])]
                if slack:  # whatever waits is longer than the gap: cut it there
                    doc_id, start, ids, total = self.take(int(np.flatnonzero(self.counts)[-1]))
                    pieces.append((doc_id, start, ids[:slack], total))
                    self.put(doc_id, start + slack, ids[slack:], total)
                self.emit(pieces)

    def rest(self, final: bool) -> None:
        """What is left: one padded sequence if this is the last level, else open pieces."""
        left = [x for same in reversed(self.pool) for x in same]
        if left:
            self.emit(left, closed=final)


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    names = [x.split()[0] for x in PIECE.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Packs every row of `docs` (doc_id, text) into sequences of `capacity` tokens.

    A document is the ids of its whole text (null: empty) and `end_id`. One row per piece: doc_id, start (ids of its
    document before it), length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Every id
    is in exactly one piece; offsets in a sequence are gapless from 0; all sequences are full but one for the whole
    table. An empty text is one piece of the end id. Repeated rows are packed each, a null doc_id stays null, an empty
    table gives no rows, other columns are ignored. Texts longer than a window are cut; memory holds one pool.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        packer = Packer(capacity, part << 32, part)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, flat, off in own.ids(batch.column(1), end_id):
                flat = flat.astype("<u4", copy=False)
                size = np.diff(off)
                whole = size // capacity
                for i in np.flatnonzero(whole).tolist():
                    packer.windows(doc_ids[a + i], flat[off[i] : off[i] + whole[i] * capacity], int(size[i]))
                done, left = whole * capacity, size - whole * capacity
                for i, x, y, n, k in zip(range(a, b), (off[:-1] + done).tolist(), off[1:].tolist(), size.tolist(), left.tolist(), strict=True):
                    if k:
                        packer.put(doc_ids[i], n - k, flat[x:y].copy(), n)  # a view would keep its block
                if packer.held >= POOL_TOKENS:
                    packer.pack(POOL_TOKENS // 4)
                if len(packer.rows) >= 2000:
                    yield piece_batch(packer.rows)
                    packer.rows = []
        packer.pack(0)
        packer.rest(final=False)
        yield piece_batch(packer.rows)

    def next_level(level: int, final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: (r[8], r[6]))
            part = TaskContext.get().partitionId()
            packer = Packer(capacity, level << 56 | part << 32, part)
            for doc_id, start, _, ids, total, *_ in rows:
                packer.put(doc_id, start, np.frombuffer(ids, "<u4"), total)
            packer.pack(0)
            packer.rest(final)
            yield piece_batch(packer.rows)

        return run

    done = Table(strip_to(docs, doc_id="long", text="string").mapInArrow(first_level, PIECE), "pack").df
    out, level = done.filter("closed"), 0
    while True:
        level += 1
        top = done.filter(~F.col("closed")).agg(F.max("part")).head()[0]
        if top is None:
            break
        groups = (top + 1 + FAN_IN - 1) // FAN_IN
        rests = done.filter(~F.col("closed")).repartitionByRange(groups, F.floor(F.col("part") / FAN_IN)) if groups > 1 else done.filter(~F.col("closed")).coalesce(1)
        done = Table(rests.mapInArrow(next_level(level, groups == 1), PIECE), f"pack{level}").df
        out = out.unionByName(done.filter("closed"))
        if groups == 1:
            break
    return out.drop("closed", "part")
