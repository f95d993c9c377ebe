"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of consecutive
hashes the least is kept, the rightmost of equals, with its position.  Texts
that share a run of ``k + window - 1`` code points share a fingerprint entry.

A fingerprint is written as base64 of 5-byte entries: the hash, then the
distance from the entry before (which is below the window, or the position of
the first one).  A text shorter than k has one entry, the hash of the whole
text; an empty text has an empty fingerprint.  Null text counts as empty; long
texts are read whole; an empty table gives an empty result; other columns do
not matter, whatever their names.  Documents of one doc_id stand in the order
of a hash of their texts (then of the texts), however many they are and however
the table is partitioned; those without a doc_id come last.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_ROWS, slices, whole_text

K = 12
WINDOW = 24
BASE = np.uint64(0x100000001B3)
HIGH = np.uint64(0xFFFFFFFF)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each run of k code points (of the whole, if shorter)."""
    n = len(points) - k + 1
    if n < 1:
        k, n = len(points), min(1, len(points))
    rolled = np.zeros(n, "u8")
    done, sums = 0, points.astype("u8")
    # sums of runs of 1, 2, 4, ... points, of which k is put together
    size = 1
    while size <= k:
        if k & size:
            rolled = rolled * _power(size) + sums[done : done + n]
            done += size
        if size * 2 <= k:
            sums = sums[:-size] * _power(size) + sums[size:]
        size *= 2
    rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (rolled ^ (rolled >> np.uint64(32))) & HIGH


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def winnow(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes and their positions."""
    n = len(hashes)
    if not n:
        return np.zeros(0, "<u4"), np.zeros(0, "i8")
    keys = (hashes << np.uint64(32)) | (HIGH - np.arange(n, dtype="u8"))  # of equal hashes the rightmost is least
    size, least = 1, keys
    window = min(window, n)
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: n - window + 1], least[window - size :])
    first = np.concatenate([[True], least[1:] != least[:-1]])
    kept = least[first]
    return (kept >> np.uint64(32)).astype("<u4"), (HIGH - (kept & HIGH)).astype("i8")


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[str, np.ndarray]:
    """The fingerprint as text, and its distinct hashes in order."""
    hashes, positions = winnow(gram_hashes(code_points(text), k), window)
    entries = np.zeros(len(hashes), np.dtype([("hash", "<u4"), ("gap", "u1")]))
    entries["hash"] = hashes
    entries["gap"] = np.diff(positions, prepend=0)
    return base64.b64encode(entries.tobytes()).decode(), np.unique(hashes)


def entries(written: str) -> list[tuple[int, int]]:
    """(position, hash) of each entry of a fingerprint."""
    read = np.frombuffer(base64.b64decode(written), np.dtype([("hash", "<u4"), ("gap", "u1")]))
    return list(zip(np.cumsum(read["gap"], dtype="i8").tolist(), read["hash"].tolist(), strict=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common hashes among all of both; 1 for two empty fingerprints."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edit(text: str, other: str) -> str:
    """The text with its last third of code points replaced by the first ones of the other."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def with_next(docs: DataFrame, schema: str, make, parts: int | None = None) -> DataFrame:
    """Runs ``make(doc_ids, texts, next texts)`` over the documents by falling doc_id; after the last comes the first.

    Documents are dealt to ranges of doc_id, and the rows of one doc_id (or of
    none) that are more than ``HEAVY_ROWS`` and would fill several ranges to
    ranges of a hash of their text.  Rows of one doc_id follow each other by
    that hash, then by their text, so the order is one whether or not they are
    dealt to several ranges.  What follows a range's last document is
    the first of the next range, which goes along as a guest; the bounds and
    those firsts are a few numbers for each range.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * tasks
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found, n, none = rows.select(F.percentile_approx("doc_id", shares, 10 * parts), F.count("*"), F.count_if(F.col("doc_id").isNull())).head()
    found = (found or []) if parts > 1 else []
    cuts = np.unique(np.array(found, "i8"))
    spread = {i: found.count(i) for i in cuts.tolist() if found.count(i) > 1 and found.count(i) * (n - none) > parts * HEAVY_ROWS}
    many = np.array([spread.get(i, 0) for i in cuts.tolist()], "i8")
    nulls = none * parts // n if none > HEAVY_ROWS else 0

    @F.pandas_udf("long")
    def range_of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        """Ranges in falling order: of greater doc_ids first, and of one doc_id by rising hash."""
        null = keys.isna().to_numpy()
        ids = keys.fillna(0).to_numpy("i8")
        place = np.searchsorted(cuts, ids, side="right")
        share = ((ties.to_numpy("i8") ^ np.int64(-(1 << 63))).view("u8") >> np.uint64(11)) / float(1 << 53)  # rises with the hash
        at = np.maximum(place - 1, 0)
        split = np.where((place > 0) & (cuts[at] == ids), many[at], 0) if len(cuts) else np.zeros(len(ids), "i8")
        within = np.where(split > 0, 1 + (share * split).astype("i8"), 0)
        return pd.Series(np.where(null, -(share * nulls).astype("i8"), (place + 1) * (1 << 20) - within))

    tied = rows.withColumn("tie", F.xxhash64("text")).withColumn("part", range_of("doc_id", "tie"))
    first = F.min_by(F.struct("doc_id", "tie"), F.struct((-F.col("doc_id")).alias("down"), "tie", "text")).alias("head")
    heads = tied.groupBy("part").agg(first).orderBy(F.desc("part")).collect()
    hosts: dict[tuple, list[int]] = {}
    for r, above in zip(heads, [*heads[-1:], *heads[:-1]], strict=True):
        hosts.setdefault(tuple(r["head"]), []).append(above["part"])
    places = spark.createDataFrame([(i, t, h) for (i, t), own in hosts.items() for h in own], "first_id long, first_tie long, host long")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    chosen = tied.join(F.broadcast(places.select("first_id", "first_tie").distinct()), same, "left_semi")  # a row for each range
    guests = chosen.groupBy("doc_id", "tie").agg(F.min("text").alias("text")).join(F.broadcast(places), same)
    dealt = tied.select("doc_id", "tie", "text", "part", F.lit(False).alias("guest")).unionByName(guests.select("doc_id", "tie", "text", F.col("host").alias("part"), F.lit(True).alias("guest")))
    ordered = dealt.repartition(tasks, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "tie", "text")

    def run(batches):
        held = None  # (part, doc_id, text) that waits for its next; or a part whose guest has come
        for batch in batches:
            for rows in slices(batch):
                ids, texts, following = [], [], []
                for part, guest, doc_id, text in zip(*(rows.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True):
                    if held is not None and held[0] == part:
                        ids.append(held[1])
                        texts.append(held[2])
                        following.append(text)
                        held = None
                    if not guest:
                        held = (part, doc_id, text)
                if ids:
                    yield make(ids, texts, following)

    return ordered.mapInArrow(run, schema)


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and their likeness to each other and to the next document's."""

    def make(ids, texts, following):
        columns = [[] for _ in range(6)]
        last = (None, None)
        for text, other in zip(texts, following, strict=True):
            changed = edit(text, other)
            own, hashes = last[1] if last[0] == text else fingerprint(text, k, window)
            edited, edited_hashes = fingerprint(changed, k, window)
            after = fingerprint(other, k, window)
            last = (other, after)
            row = (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, edited, likeness(hashes, edited_hashes), likeness(hashes, after[1]))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return pa.record_batch([pa.array(ids, pa.int64()), *map(pa.array, columns)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, schema, make)
