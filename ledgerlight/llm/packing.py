"""Best-fit packing of token sequences, planned over the histogram of lengths.

The plan is made from the number of pieces of each length, at most ``capacity``
numbers, by best fit in order of falling length.  It says which ranks within a
length go to which sequences at which place; pieces find their place by their
rank within their length.  Ranks come from rows counted within salted lanes of
a length, so that a very common length is shared among many tasks.

Null text counts as empty and has one piece, the end id; long documents are
cut whole; rows that repeat are packed each for itself; an empty table gives an
empty result; other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged, whole_text
from .tokenizing import load

#: Lanes among which the pieces of one length are ranked.
LANES = 256


def plan_best_fit(counts: list[int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset), sorted by length and rank.

    ``counts[n]`` pieces have length n.  Piece ``first rank + i`` of a run goes
    to sequence ``first sequence + i``.  The number of runs depends on the
    capacity, not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def leave(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in room:
                bisect.insort(rooms, space)
                room[space] = []
            room[space].append((first, n))

    for length in range(capacity, 0, -1):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space]
                    rooms.pop(at)
            else:
                space = capacity
                first, n = sequences, -(-left // (capacity // length))
                sequences += n
            each = space // length
            full = min(n, left // each)
            rest = min(left - full * each, each - 1) if full < n else 0
            for k in range(each if full else 0):
                runs.append((length, rank, full, first, capacity - space + k * length))
                rank += full
            for k in range(rest):
                runs.append((length, rank, 1, first + full, capacity - space + k * length))
                rank += 1
            leave(space - each * length, first, full)
            if rest:
                leave(space - rest * length, first + full, 1)
            leave(space, first + full + bool(rest), n - full - bool(rest))
            left -= full * each + rest
    return np.array(sorted(runs), "i8").reshape(-1, 5)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece."""

    def run(batches):
        encoder = load(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                owners, rows = [], []
                for i, ids in enumerate(encoder.encode_each(part.column("text"))):
                    ids += end
                    for k, (at, size) in enumerate(cut(len(ids) // 4, capacity)):
                        owners.append(i)
                        rows.append((k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                piece, start, length, crc = zip(*rows, strict=True)
                columns = [part.column("doc_id").take(pa.array(owners)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, capacity: int, lanes: int = LANES) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    They are read twice and must be a written table; ``salt`` is a number of each
    row's own that was written with it, so that rows which are all alike are
    dealt to many lanes too.

    To the driver go the counts by length and lane: at most capacity x lanes numbers.
    """
    spark = pieces.sparkSession
    laned = pieces.withColumn("lane", F.pmod(F.xxhash64("salt"), F.lit(lanes)).cast("int"))
    tally = np.zeros((capacity + 1, lanes), "i8")
    for r in laned.groupBy("length", "lane").count().toLocalIterator():
        tally[r["length"], r["lane"]] = r["count"]
    runs = plan_best_fit(tally.sum(1).tolist(), capacity)
    bases = np.cumsum(tally, 1) - tally
    shared = spark.sparkContext.broadcast((runs, bases))

    def run(batches):
        runs, bases = shared.value
        keys = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = bases[length, batch.column("lane").to_numpy()] + batch.column("nth").to_numpy() - 1
            of = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            sequence = runs[of, 3] + rank - runs[of, 1]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(runs[of, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    own = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = laned.withColumn("nth", F.row_number().over(own).cast("long"))
    kind = dict(pieces.dtypes)["doc_id"]
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece with its place; only documents over the capacity are cut."""
    pieces = token_pieces(docs, path, capacity, end_id).withColumn("salt", F.monotonically_increasing_id())
    return place_pieces(staged(pieces, "pieces"), capacity)
