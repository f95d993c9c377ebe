"""Exact top-k search by distributed selection over histograms of scores.

Queries are packed in blocks and all vectors in chunks; every block meets every
chunk.  A pass scores all of them and counts, for each query, the scores in the
bins of its current range; the bin that holds the k-th score is the range of
the next pass, until it holds one score value.  A last pass keeps what scores
at least that much, ties by the smaller id, and ranks it.

Components become floor(1024 * x).  Vectors that are null or hold a null or
non-finite component, and those without an id, take no part; vectors of other
lengths are filled up with zeros; rows that repeat, id included, are queries
and candidates each for itself, and only a query's own row is no candidate of
it; scores beyond a long are held at
its ends; no queries, or no other vectors, give an empty result; other columns
do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

CHUNK = 2048
BLOCK = 512
#: Bins of a pass.
BINS = 1024
#: Components up to which sums of products are exact in doubles (for up to 8192 components).
PLAIN = float(1 << 20)
#: Histogram cells that a task holds before it passes them on.
HELD = 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PACKED = "n int, dim int, plain boolean, norm double, ids binary, rows binary"


def scaled(vectors: DataFrame) -> DataFrame:
    """(id, v) of the vectors that take part."""
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    double = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("id"), double.alias("v")).filter(good)


def pack(vectors: DataFrame, most: int) -> DataFrame:
    """Rows of up to ``most`` vectors as arrays; those with very large components apart, in small rows."""

    def rows(ids: list, found: list, plain: bool):
        dim = max(map(len, found))
        matrix = np.zeros((len(found), dim))
        for i, v in enumerate(found):
            matrix[i, : len(v)] = v
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.binary(), pa.binary()]
        norm = float(np.sqrt((matrix**2).sum(1)).max())
        values = [len(ids), dim, plain, norm, np.array(ids, "<i8").tobytes(), matrix.tobytes()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["n", "dim", "plain", "norm", "ids", "rows"])

    def run(batches):
        held: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                v = np.floor(1024 * np.asarray(v.values, "f8"))
                plain = not len(v) or float(np.abs(v).max()) <= PLAIN
                ids, found = held[plain]
                ids.append(i)
                found.append(v)
                if len(ids) >= (most if plain else 32):
                    yield rows(ids, found, plain)
                    held[plain] = ([], [])
        for plain, (ids, found) in held.items():
            if ids:
                yield rows(ids, found, plain)

    return vectors.mapInArrow(run, PACKED)


def unpack(row: dict, prefix: str):
    n, dim = row[f"{prefix}n"], row[f"{prefix}dim"]
    return np.frombuffer(row[f"{prefix}ids"], "<i8"), np.frombuffer(row[f"{prefix}rows"], "<f8").reshape(n, dim)


def scores(queries: np.ndarray, rows: np.ndarray, plain: bool) -> np.ndarray:
    """Integer inner products of all queries with all rows."""
    dim = min(queries.shape[1], rows.shape[1])  # beyond it one side is zero
    q, r = queries[:, :dim], rows[:, :dim]
    if plain and dim <= 8192:
        return (q @ r.T).astype("i8")
    exact = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    out = exact(q) @ exact(r).T if dim else np.zeros((len(q), len(r)), object)
    return np.clip(out, LEAST, MOST).astype("i8")


def scores_of_rows(queries: np.ndarray, plain: bool) -> np.ndarray:
    """Integer inner product of each query with itself."""
    return np.concatenate([scores(queries[i : i + 1], queries[i : i + 1], plain)[0] for i in range(len(queries))])


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    found, of = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(of, np.concatenate(counts), len(found)).astype("i8")


def search(vectors: DataFrame, every: int = 100, k: int = 10, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each query; queries are the rows whose id is divisible by ``every``."""
    k += 1  # a query's own row is scored like others and left out at the end
    spark = vectors.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = scaled(vectors)
    chunks = staged(pack(whole, CHUNK).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")), "chunks")
    packed = pack(whole.filter(F.col("id") % every == 0).repartition(max(1, lanes // 4)), BLOCK)
    blocks = staged(packed.select(F.xxhash64("ids").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("n", "dim", "plain", "ids", "rows")]), "blocks")

    longest = chunks.agg(F.max("norm")).head()[0] or 0.0

    def first(batches):
        """A query's first range: a power of two of scores around zero, as wide as the product of lengths asks for."""
        for batch in batches:
            for row in batch.to_pylist():
                ids, queries = unpack(row, "q_")
                most = np.sqrt((queries**2).sum(1)) * longest * (1 + 1e-9) + 2
                width = np.minimum(np.ceil(np.log2(np.minimum(most, 2.0**64))).astype("i8") + 1, 64)
                low = np.array([-(1 << (w - 1)) for w in width.tolist()], "i8")
                yield pa.record_batch([pa.array([row["block"]]), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([width.tolist()], pa.list_(pa.int32())), pa.array([[k] * len(ids)], pa.list_(pa.int64()))], ["block", "low", "width", "left"])

    range_schema = "block long, low array<long>, width array<int>, left array<long>"
    ranges = staged(blocks.mapInArrow(first, range_schema), "ranges")
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")

    def meetings(now: DataFrame) -> DataFrame:
        return chunks.join(blocks.join(now, "block").select("*", lane), "lane")

    shift = bins.bit_length() - 1

    def histogram(batches):
        """Of queries whose range is wider than one score: scores by bin, those above the range left out, summed over a task's chunks."""
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        blocks: dict[int, int] = {}

        def cells():
            found, n = merged(keys, counts)
            names = np.array(list(blocks), "i8")
            within = found % (BLOCK * bins)
            return pa.record_batch([pa.array(names[found // (BLOCK * bins)]), pa.array(within // bins), pa.array(within % bins), pa.array(n)], ["block", "query", "bin", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                qids, queries = unpack(row, "q_")
                ids, rows = unpack(row, "")
                s = scores(queries, rows, row["plain"] and row["q_plain"])
                low, width = np.array(row["low"], "i8"), np.array(row["width"])
                step = np.maximum(width - shift, 0)
                place = (s.view("u8") - low.view("u8")[:, None]) >> step[:, None].astype("u8")  # what is below wraps round to the far end
                inside = s >= low[:, None]
                inside &= np.where(width[:, None] >= 64, True, place < (1 << np.minimum(width, shift))[:, None].astype("u8"))
                inside &= (width > 0)[:, None]
                q, c = np.nonzero(inside)
                own = np.bincount(q * bins + place[q, c].astype("i8"))
                used = np.flatnonzero(own)
                at = blocks.setdefault(row["block"], len(blocks))
                keys.append(used + at * BLOCK * bins)
                counts.append(own[used])
                if sum(map(len, keys)) > HELD:
                    found, n = merged(keys, counts)
                    if len(found) > HELD // 2:
                        keys, counts = [found], [n]
                        yield cells()
                        keys, counts, blocks = [], [], {}
                    else:
                        keys, counts = [found], [n]
        if keys:
            yield cells()

    def narrowed(batches):
        """The bin that holds the k-th score; a query with fewer scores keeps all of them."""
        for batch in batches:
            for row in batch.to_pylist():
                by_query: dict[int, list] = {}
                for cell in row["cells"] or []:
                    by_query.setdefault(cell["query"], []).append((cell["bin"], cell["n"]))
                low, width, left = row["low"], row["width"], row["left"]
                for q, w in enumerate(width):
                    if not w:
                        continue
                    step = max(w - shift, 0)
                    want = left[q]
                    for b, n in sorted(by_query.get(q, []), reverse=True):
                        if n >= want:
                            low[q], width[q], left[q] = low[q] + (b << step), step, want
                            break
                        want -= n
                    else:
                        low[q], width[q] = LEAST, 0
                yield pa.record_batch([pa.array([row["block"]]), pa.array([low], pa.list_(pa.int64())), pa.array([width], pa.list_(pa.int32())), pa.array([left], pa.list_(pa.int64()))], ["block", "low", "width", "left"])

    wide = ranges.agg(F.max(F.array_max("width"))).head()[0] or 0
    while wide > 0:
        counted = meetings(ranges).mapInArrow(histogram, "block long, query long, bin long, n long").groupBy("block", "query", "bin").agg(F.sum("n").alias("n"))
        cells = counted.groupBy("block").agg(F.collect_list(F.struct("query", "bin", "n")).alias("cells"))  # at most BLOCK x bins
        ranges = staged(ranges.join(cells, "block", "left").mapInArrow(narrowed, range_schema), "ranges")
        wide = max(wide - shift, 0)

    def keep(batches):
        """What can be among the k best: of each query and chunk the k best at least as good as its k-th score."""
        for batch in batches:
            for row in batch.to_pylist():
                qids, queries = unpack(row, "q_")
                ids, rows = unpack(row, "")
                s = scores(queries, rows, row["plain"] and row["q_plain"])
                low = np.array(row["low"], "i8")
                q, c = np.nonzero(s >= low[:, None])
                value = s[q, c]
                order = np.lexsort((ids[c], -np.maximum(value, -MOST), q))
                q, c, value = q[order], c[order], value[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                q, c, value = q[nth < k], c[nth < k], value[nth < k]
                itself = scores_of_rows(queries, row["q_plain"])
                own = (ids[c] == qids[q]) & (value == itself[q])
                columns = [pa.array(qids[q]), pa.array(ids[c]), pa.array(value), pa.array(own), pa.array(q), pa.array(np.full(len(q), row["block"])), pa.array(np.full(len(q), row["lane"], "i4"))]
                yield pa.record_batch(columns, ["query_id", "vec_id", "score", "own", "query", "block", "lane"])

    kept = meetings(ranges).mapInArrow(keep, "query_id long, vec_id long, score long, own boolean, query long, block long, lane int")
    entry = F.struct((-F.greatest("score", F.lit(-MOST))).alias("key"), "vec_id", "score", "own")
    best = lambda of: F.slice(F.array_sort(of), 1, k)
    # First the k best of a few lanes together, then of all: ties at the k-th score of many chunks never meet in one list.
    groups = max(2, round(lanes**0.5))
    some = kept.groupBy("block", "query", "query_id", (F.col("lane") % groups).alias("group")).agg(best(F.collect_list(entry)).alias("best"))
    whole = some.groupBy("block", "query", "query_id").agg(best(F.flatten(F.collect_list("best"))).alias("best"))
    itself = F.array_position(F.transform("best", lambda e: e["own"]), True) - 1  # of entries that are alike in id and score any one can go
    others = F.slice(F.filter("best", lambda e, i: i != itself), 1, k - 1)
    ranked = whole.select("query_id", F.posexplode(others).alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


ORACLE_SQL = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
