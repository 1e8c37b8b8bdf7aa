"""Token files that a reader can enter at any document.

A file is: one zstandard frame per document (its ids, little-endian unsigned 32-bit), a skippable frame with the doc_ids
(a null flag byte and a little-endian signed 64-bit each), and last a skippable frame with the seek table of the public
zstandard seekable format: compressed size, size and checksum (low 32 bits of XXH64 of the content) of every frame, then
the number of frames, a flag byte and a magic number. A reader takes the last nine bytes, the table, and then only the
frames of the documents it wants; plain zstandard tools decompress the whole file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import Table, scratch, strip_to
from lodestar.llm.tokens import encoder

#: Fixed values of the zstandard formats.
SKIPPABLE, SEEK_FRAME, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")


#: Bytes of text that a file holds, and sampled doc_ids for each bound between files.
FILE_BYTES, SAMPLES = 32 << 20, 50
NULL_ID = np.iinfo(np.int64).min


def checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class TokenFileWriter:
    """Appends documents to a binary stream; close() writes the index and the seek table."""

    def __init__(self, out, level: int = 3) -> None:
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level)
        self.entries: list[bytes] = []
        self.index: list[bytes] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        self.add_frame(doc_id, self.zstd.compress(raw), len(raw), checksum(raw))

    def add_frame(self, doc_id: int | None, frame: bytes, size: int, sum_: int) -> None:
        """A document that is compressed already, with the size and checksum of its ids."""
        self.out.write(frame)
        self.entries.append(struct.pack("<III", len(frame), size, sum_))
        self.index.append(struct.pack("<Bq", doc_id is None, doc_id or 0))
        self.n_tokens += size // 4

    def close(self) -> None:
        ids = b"".join(self.index)
        self.out.write(struct.pack("<II", SKIPPABLE, len(ids)) + ids)
        table = b"".join(self.entries) + FOOTER.pack(len(self.entries), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class TokenFileReader:
    """Reads a file (seekable, binary); documents are numbered as they were added."""

    def __init__(self, source) -> None:
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - FOOTER.size - 12 * n)
        entries = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.stored, self.sizes, self.sums = (entries[:, i].astype(np.int64) for i in range(3))
        self.at = np.zeros(n + 1, np.int64)
        np.cumsum(self.stored, out=self.at[1:])
        source.seek(int(self.at[-1]) + 8)
        raw = source.read(9 * n)
        self.doc_ids = [None if null else i for null, i in struct.iter_unpack("<Bq", raw)]

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, k: int) -> np.ndarray:
        self.source.seek(int(self.at[k]))
        raw = self.zstd.decompress(self.source.read(int(self.stored[k])), max_output_size=max(1, int(self.sizes[k])))
        if len(raw) != self.sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes every row of `docs` (doc_id, text) to token files below `folder`, a URI, in ascending doc_id order.

    A document is the ids of its whole text (null: empty) and `end_id`. Returns a row per file: part (files in doc_id
    order), path, n_docs, n_tokens. Texts are encoded and compressed where they are read; only frames are shuffled. Rows
    are dealt out by ranges of doc_id and sorted in their task, so a file holds a range; null doc_ids come first,
    repeated ones stay side by side (their order is that of their frames in a file; very many fill files of their own),
    an empty table gives no files, other columns are ignored. One text, its ids and its frame fit into memory. A task
    writes under a name of its own and only the returned names count, so a repeated task leaves at most an unread file.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    thin = strip_to(docs, doc_id="long", text="string")
    bounds = range_bounds(thin)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, zstd = encoder(path), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            doc_id = batch.column(0)
            key = doc_id.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for a, b, flat, off in own.ids(batch.column(1), end_id):
                raw = flat.astype("<u4", copy=False).tobytes()
                texts = [raw[4 * x : 4 * y] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                sums = np.array([checksum(x) for x in texts], np.int64)
                low, high = np.searchsorted(bounds, key[a:b], "left"), np.searchsorted(bounds, key[a:b], "right")
                part = low + sums % (high - low + 1)  # an id that fills files of its own is dealt over them
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), doc_id.slice(a, b - a), pa.array([zstd.compress(x) for x in texts], pa.binary()), pa.array(4 * np.diff(off)), pa.array(sums)], ["part", "doc_id", "frame", "size", "sum"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n_docs = None, 0
        for batch in batches:
            if out is None and len(batch):
                where, base = pafs.FileSystem.from_uri(folder)
                where.create_dir(base, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
                out = where.open_output_stream(f"{base}/{name}")
                writer = TokenFileWriter(out)
            for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                writer.add_frame(*row)
            n_docs += len(batch)
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "n_docs": n_docs, "n_tokens": writer.n_tokens}])

    frames = thin.mapInArrow(encode, "part int, doc_id long, frame binary, size long, sum long")
    rows = frames.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "frame")
    return Table(rows.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "tokenfiles").df


def range_bounds(docs: DataFrame) -> np.ndarray:
    """doc_ids between files of about FILE_BYTES of text each, from a sample of doc_ids; a null id counts as least."""
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).head()
    files = max(1, -(-(size or 0) // FILE_BYTES))
    if files == 1:
        return np.zeros(0, np.int64)
    wanted = files * SAMPLES
    ids = docs.select(F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("doc_id"))
    ids = ids.sample(min(1.0, 1.2 * wanted / n), seed=7) if n > 2 * wanted else ids
    found = np.sort(ids.toArrow()["doc_id"].to_numpy())
    return found[np.arange(1, files) * len(found) // files]


def read_tokens(files: DataFrame) -> DataFrame:
    """Reads token files back, all documents: doc_id, start (ids of all documents before it), n_tokens, ids (binary).

    `files` is what write_tokens returned. Every file is read by itself; the tokens before it are a running sum over files.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = max(1, files.count())
    placed = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, name = pafs.FileSystem.from_uri(row["path"])
                with where.open_input_file(name) as source:
                    reader, start = TokenFileReader(source), row["start"]
                    for a in range(0, len(reader), 1000):
                        got = [reader[k].tobytes() for k in range(a, min(len(reader), a + 1000))]
                        sizes = np.array([len(x) // 4 for x in got], np.int64)
                        starts = start + np.cumsum(sizes) - sizes
                        start += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[a : a + len(got)], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(got, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """write_tokens, then read_tokens; `folder` is by default a new one in the shared folder."""
    return read_tokens(write_tokens(docs, folder or scratch(docs.sparkSession, "tokens"), tokenizer, end_id))
