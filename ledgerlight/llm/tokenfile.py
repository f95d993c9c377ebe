"""Token ids as files of fixed-width bits.

An id takes the fewest bits that hold the vocabulary.  A file has blocks of
``BLOCK`` ids, each on a byte border, then the byte offset of each block, the
documents' ids and starts, and a trailer of fixed size.  Any range of ids is
read from its blocks alone and unpacked by numpy.

Documents are dealt out by ranges of doc_id, a file for each range, so the
files in order hold the documents in ascending order (null ids first, rows of
one id by a hash of their text).  Null text counts as empty and has the end id
only; texts are encoded whole; other columns do not matter, whatever their
names; an empty table gives files without documents and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedFiles, fresh_path, slices, staged, whole_text
from .tokenizing import load

MAGIC = b"FWIDTOK1"
TRAILER = struct.Struct("<8sIIQQQ")
BLOCK = 4096


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype="u4")) & 1
    return np.packbits(bits.astype("u1").ravel(), bitorder="little").tobytes()


def unpack_bits(data, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, "u1"), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype("<u4") << np.arange(width, dtype="u4")).sum(1, dtype="<u4")


class Writer:
    """Chunks of a file's bytes from documents that come one after another."""

    def __init__(self, width: int):
        self.width, self.n_ids, self.size = width, 0, 0
        self.held: list[bytes] = []
        self.held_ids = 0
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n_ids)
        self.held.append(ids)
        self.n_ids += len(ids) // 4
        self.held_ids += len(ids) // 4

    def blocks(self, last: bool = False):
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            data = pack_bits(ids[at : min(at + BLOCK, whole)], self.width)
            self.offsets.append(self.size)
            self.size += len(data)
            yield data
        self.held = [ids[whole:].tobytes()]
        self.held_ids = len(ids) - whole

    def end(self):
        yield from self.blocks(last=True)
        for numbers, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.starts, "<u8"), (self.nulls, "u1")):
            yield np.array(numbers, kind).tobytes()
        yield TRAILER.pack(MAGIC, self.width, BLOCK, self.n_ids, len(self.docs), self.size)


class Reader:
    """Random access to a file's ids and documents."""

    def __init__(self, data):
        magic, self.width, self.block, self.n_ids, n, size = TRAILER.unpack(data[len(data) - TRAILER.size :])
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        n_blocks = -(-self.n_ids // self.block)
        at = size
        self.offsets = np.append(np.frombuffer(data, "<u8", n_blocks, at), size).astype("i8")
        at += 8 * n_blocks
        self.docs = np.frombuffer(data, "<i8", n, at)
        self.starts = np.append(np.frombuffer(data, "<u8", n, at + 8 * n), self.n_ids).astype("i8")
        self.nulls = np.frombuffer(data, "u1", n, at + 16 * n).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        if self.width % 8 == 0:
            data = memoryview(self.data)[self.offsets[first] : self.offsets[last + 1]]
            whole = unpack_bits(data, min((last + 1) * self.block, self.n_ids) - first * self.block, self.width)
        else:
            parts = []
            for k in range(first, last + 1):
                data = memoryview(self.data)[self.offsets[k] : self.offsets[k + 1]]
                parts.append(unpack_bits(data, min(self.block, self.n_ids - k * self.block), self.width))
            whole = np.concatenate(parts)
        return whole[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, url: str | None = None) -> tuple[DataFrame, str]:
    """Encodes the documents into token files; the files' table (file, name, n_docs, n_ids) and their folder."""
    spark = docs.sparkSession
    url = url or fresh_path(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        encoder = load(path)
        end = np.array([end_id], "<u4").tobytes()
        writer = Writer(width_of(max(encoder.size, end_id + 1)))

        def chunks():
            for batch in batches:
                for part in slices(batch):
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode_each(part.column("text")), strict=True):
                        writer.add(doc_id, ids + end)
                    yield from writer.blocks()
            yield from writer.end()

        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}.tok"
        SharedFiles(url).write(name, chunks())
        yield pa.record_batch([[number], [name], [len(writer.docs)], [writer.n_ids]], ["file", "name", "n_docs", "n_ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = texts.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return staged(ranged.mapInArrow(run, "file long, name string, n_docs long, n_ids long"), "files"), url


def read_token_files(files: DataFrame, url: str) -> DataFrame:
    """One row per document from the files: doc_id, start among the ids of all files, n_tokens and ids_crc32."""

    def run(batches):
        store = SharedFiles(url)
        for batch in batches:
            for row in batch.to_pylist():
                file = Reader(store.map(row["name"]))
                for at in range(0, len(file.docs), 1000):
                    to = min(at + 1000, len(file.docs))
                    starts = file.starts[at : to + 1]
                    crcs = []
                    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                        crcs.append(zlib.crc32(file.ids(a, b).tobytes()))
                    ids = pa.array(file.docs[at:to], mask=file.nulls[at:to])
                    columns = [ids, pa.array(starts[:-1] + row["before"]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())]
                    yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    so_far = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    placed = files.filter("n_docs > 0").withColumn("before", F.coalesce(F.sum("n_ids").over(so_far), F.lit(0)))
    return placed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_file_round_trip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    return read_token_files(*write_token_files(docs, path, end_id))
