"""Hard-negative mining by threshold joins over an inverted index that bounds of norms keep small.

Each anchor has windows of scores to fill: first one for its positives (rows of
its label, all scores), then one for each positive (rows of other labels, a
share of the positive's score).  A round joins all anchors that still have an
open window with the chunks of vectors, for scores from a threshold up to the
window's end; a window with enough rows is done, as rows of lower scores would
come later, and for the others the threshold is lowered, at last to the
window's own end.

Where an anchor block meets a chunk, the dimensions are in rising order of
their weight in the chunk.  A row's first dimensions stay out of the index as
long as their norm, times that of any anchor's same dimensions, is below every
threshold: a row that meets no indexed dimension cannot reach it.  Rows stand
by the number of dimensions left out, so the list of a dimension is a run of
rows, and lists are worked off in bands from the heaviest dimensions on.  After
each band a pair goes when its partial score and the product of the remaining
norms are below the anchor's threshold.  When few pairs are left they are
finished one by one; what is left out of the index is added at the end, so
scores are exact.  A task also raises an anchor's threshold to the worst of the
rows that already fill its windows.

Rows with a null id, label or vector, or a null or non-finite component, take
no part; vectors of other lengths are filled up with zeros; rows that repeat,
id included, are anchors and candidates each for itself, and only a row itself
is no candidate of it; scores beyond a long are held at its ends; no anchors or
no candidates give an empty result; other columns do not matter, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .topk import LEAST, MOST, PLAIN, scores

#: Rows of a chunk and of a block, twice as many at most.
CHUNK, BLOCK = 2048, 256
#: Dimensions that are worked off together.
BAND = 16
#: Pairs are finished one by one when no more than one in so many is left.
FEW = 12
#: Blocks of which a task holds the best rows found so far; a block meets all chunks of a lane before the next one comes.
HELD = 4
#: Parts of a window, from its end on, that the rounds cover.
ROUNDS = (1 / 8, 1 / 2, 1.0)
#: Lower and upper end of a negative's score, in percent of the positive's.
LOW, HIGH = 50, 95

SOME = "label long, chunk long, place int, id long, most long, v binary"
PACKED = "label long, n int, dim int, plain boolean, norm double, places binary, ids binary, rows binary"
FOUND = "chunk long, place int, slot int, anchor_id long, vec_id long, of_chunk long, of_place int, score long"


def vectors_of(rows: DataFrame, scale: float, label: Column) -> DataFrame:
    """(label, id, v) of the rows that take part, components as floor(scale * x)."""
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    named = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return named.filter(good).withColumn("v", F.transform("v", lambda x: x * scale))


def packed(label, places: list, ids: list, found: list, plain: bool) -> pa.RecordBatch:
    dim = max(map(len, found))
    matrix = np.zeros((len(found), dim))
    for i, v in enumerate(found):
        matrix[i, : len(v)] = v
    norm = float(np.sqrt((matrix**2).sum(1)).max())
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    values = [label, len(ids), dim, plain, norm, np.array(places, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), matrix.tobytes()]
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["label", "n", "dim", "plain", "norm", "places", "ids", "rows"])


def is_plain(v: np.ndarray) -> bool:
    """Whether sums of products of the vector are exact in doubles."""
    return len(v) <= 8192 and (not len(v) or float(np.abs(v).max()) <= PLAIN)


def grouped(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """Rows of one label together, in as few groups of about twice ``size`` at most as the label needs, however often a label or a row repeats."""
    counts = rows.groupBy("label").agg(F.ceil(F.count("*") / (2 * size)).alias("parts")).filter("parts > 1")  # a row for each 2 * size rows at most
    sized = rows.join(F.broadcast(counts), "label", "left")
    dealt = sized.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))))
    return dealt.groupBy("label", "group").agg(F.collect_list(F.struct(*columns)).alias("members")).drop("group")


def parted(members: list, small: int = 32):
    """(plain, members) of the members with and without very large components, the latter in small lists."""
    plain = [is_plain(v) for _, v in members]
    if any(plain):
        yield True, [m for m, p in zip(members, plain, strict=True) if p]
    large = [m for m, p in zip(members, plain, strict=True) if not p]
    for at in range(0, len(large), small):
        yield False, large[at : at + small]


def chunks_of(vectors: DataFrame) -> DataFrame:
    """Vectors in chunks of one label; those with very large components apart, in small ones."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("members")[i].values
                members = [(n, np.floor(np.asarray(v.values, "f8"))) for n, v in zip(own.field("id").to_pylist(), own.field("v"), strict=True)]
                for plain, some in parted(members):
                    yield packed(batch.column("label")[i].as_py(), range(len(some)), [n for n, _ in some], [v for _, v in some], plain)

    return staged(grouped(vectors, CHUNK, "id", "v").mapInArrow(run, PACKED).select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")


def unpacked(row: dict, prefix: str = ""):
    return np.frombuffer(row[f"{prefix}ids"], "<i8"), np.frombuffer(row[f"{prefix}places"], "<i8"), np.frombuffer(row[f"{prefix}rows"], "<f8").reshape(row[f"{prefix}n"], row[f"{prefix}dim"])


def anchors_of(chunks: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``: the chunk and the place that tell a row from others, and what no score of it is beyond."""
    longest = float(chunks.agg(F.max("norm")).head()[0] or 0.0)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, rows = unpacked(row)
                at = np.flatnonzero(ids % every == 0)
                bound = np.sqrt((rows[at] ** 2).sum(1)) * longest * (1 + 1e-9) + 2
                most = [MOST if b >= 9e18 else int(b) for b in bound.tolist()]
                columns = [np.full(len(at), row["label"]), np.full(len(at), row["chunk"]), at.astype("i4"), ids[at], np.array(most, "i8")]
                yield pa.record_batch([*map(pa.array, columns), pa.array([rows[i].tobytes() for i in at.tolist()], pa.binary())], [c.split()[0] for c in SOME.split(", ")])

    return staged(chunks.mapInArrow(run, SOME), "anchors")


def blocks_of(anchors: DataFrame, slots: int) -> DataFrame:
    """Anchors of one label in blocks; ``high``, ``low`` are those of their windows by slot (a closed window has ``high`` below ``low``)."""

    def run(batches):
        for batch in batches:
            for group in batch.to_pylist():
                for plain, some in parted([(r, np.frombuffer(r["v"], "<f8")) for r in group["members"]]):
                    rows = [r for r, _ in some]
                    made = packed(group["label"], [r["place"] for r in rows], [r["id"] for r in rows], [v for _, v in some], plain)
                    high, low = np.full((len(rows), slots), LEAST), np.full((len(rows), slots), MOST)
                    for i, r in enumerate(rows):
                        for w in r["windows"]:
                            high[i, w["slot"]], low[i, w["slot"]] = w["high"], w["low"]
                    more = [np.array([r["chunk"] for r in rows], "i8"), high, low]
                    columns = [*made.columns, *(pa.array([m.astype("<i8").tobytes()], pa.binary()) for m in more)]
                    yield pa.record_batch(columns, [*made.schema.names, "chunks", "high", "low"])

    members = grouped(anchors, BLOCK, "chunk", "place", "id", "v", "windows")
    made = members.mapInArrow(run, PACKED + ", chunks binary, high binary, low binary")
    named = [F.col(c).alias(f"q_{c}") for c in ("label", "n", "dim", "plain", "ids", "places", "rows", "chunks", "high", "low")]
    return staged(made.select(F.monotonically_increasing_id().alias("block"), *named), "blocks")


def reaching(anchors: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) and scores of at least the anchor's ``least``, by the index described above.  All scores must be exact in doubles."""
    dim = min(anchors.shape[1], rows.shape[1])  # beyond it one side is zero
    if not dim:
        q, r = np.nonzero(np.broadcast_to(least[:, None] <= 0, (len(anchors), len(rows))))
        return q, r, np.zeros(len(q), "i8")
    anchors, rows = anchors[:, :dim], rows[:, :dim]
    light = np.argsort((rows**2).sum(0), kind="stable")
    anchors, rows = anchors[:, light], rows[:, light]
    norms = lambda m: np.sqrt(np.cumsum(np.concatenate([np.zeros((len(m), 1)), m**2], axis=1), axis=1))  # noqa: E731  of the first 0, 1, ... dimensions
    a_norm, r_norm = norms(anchors), norms(rows)
    slack = 1 + 1e-9
    out = (r_norm * a_norm.max(0) * slack + 1 < least.min()).sum(1) - 1  # so many of a row's first dimensions can stay out
    ends = dim - (dim - 1 - np.clip(out, 0, dim - 1)) // BAND * BAND
    covered = np.maximum(ends - BAND, 0)  # where its lists begin, in whole bands
    listed = np.flatnonzero(out < dim)
    listed = listed[np.argsort(covered[listed], kind="stable")]
    rows, r_norm, covered = rows[listed], r_norm[listed], covered[listed]
    partial = np.zeros((len(anchors), len(rows)))
    for end in range(dim, 0, -BAND):
        begin = max(0, end - BAND)
        m = int(np.searchsorted(covered, begin, side="right"))
        partial[:, :m] += anchors[:, begin:end] @ rows[:m, begin:end].T
        rest = np.maximum(covered, begin)
        alive = partial + a_norm[:, rest] * r_norm[np.arange(len(rows)), rest] * slack + 1 >= least[:, None]
        if not begin or alive.sum() * FEW <= alive.size:
            break
    q, r = np.nonzero(alive)
    values, rest = partial[q, r], rest[r]
    for to in np.unique(rest[rest > 0]).tolist():
        own = np.flatnonzero(rest == to)
        for at in range(0, len(own), 1 << 16):
            some = own[at : at + (1 << 16)]
            values[some] += (anchors[q[some], :to] * rows[r[some], :to]).sum(1)
    keep = values >= least[q]
    return q[keep], listed[r[keep]], values[keep].astype("i8")


def firsts(window: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their window, by falling score and rising id; in that order."""
    order = np.lexsort((ids, -np.maximum(values, -MOST), window))
    window = window[order]
    return order[np.arange(len(order)) - np.searchsorted(window, window) < k]


class Best:
    """The best rows found so far for the windows of one block."""

    names = ("window", "id", "chunk", "place", "score")

    def __init__(self, row: dict, slots: int, k: int):
        self.ids, self.places, self.vectors = unpacked(row, "q_")
        self.chunks = np.frombuffer(row["q_chunks"], "<i8")
        shape = (len(self.ids), slots)
        self.high, self.low = (np.frombuffer(row[f"q_{c}"], "<i8").reshape(shape) for c in ("high", "low"))
        self.label, self.plain, self.slots, self.k = row["q_label"], row["q_plain"], slots, k
        self.least = np.where(self.high >= self.low, self.low, MOST)
        self.rows = {c: np.zeros(0, "i8") for c in self.names}

    def meet(self, row: dict) -> None:
        ids, _, rows = unpacked(row)
        least = self.least.min(1)
        if self.plain and row["plain"]:
            q, r, value = reaching(self.vectors, rows, least)
        else:
            every = scores(self.vectors, rows, False)
            q, r = np.nonzero(every >= least[:, None])
            value = every[q, r]
        itself = (self.chunks[q] == row["chunk"]) & (self.places[q] == r)
        q, r, value = q[~itself], r[~itself], value[~itself]
        for slot in range(self.slots):
            inside = np.flatnonzero((value <= self.high[q, slot]) & (value >= self.least[q, slot]))
            if not len(inside):
                continue
            a, b = q[inside], r[inside]
            new = dict(zip(self.names, (a * self.slots + slot, ids[b], np.full(len(a), row["chunk"]), b, value[inside]), strict=True))
            self.add({c: np.concatenate([self.rows[c], new[c]]) for c in self.names})

    def add(self, rows: dict) -> None:
        kept = firsts(rows["window"], rows["id"], rows["score"], self.k)
        self.rows = {c: rows[c][kept] for c in self.names}
        window, first, n = np.unique(self.rows["window"], return_index=True, return_counts=True)
        full = n == self.k
        worst = self.rows["score"][first[full] + self.k - 1]
        at = (window[full] // self.slots, window[full] % self.slots)
        self.least[at] = np.maximum(self.least[at], worst)  # rows of the same score and smaller id still get in

    def batch(self) -> pa.RecordBatch:
        a, slot = self.rows["window"] // self.slots, self.rows["window"] % self.slots
        columns = [self.chunks[a], self.places[a].astype("i4"), slot.astype("i4"), self.ids[a], self.rows["id"], self.rows["chunk"], self.rows["place"].astype("i4"), self.rows["score"]]
        return pa.record_batch(list(map(pa.array, columns)), [c.split()[0] for c in FOUND.split(", ")])


def first_rows(chunks: DataFrame, anchors: DataFrame, slots: int, k: int, same: bool) -> DataFrame:
    """The first k rows of each open window: of the anchor's label, or of other labels.

    Blocks are copied to each lane, so their file says little about the size of
    the copies: they are merged by lane, never broadcast.  There are no more
    lanes than chunks.
    """
    lanes = max(1, min(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.count()))
    blocks = blocks_of(anchors, slots)
    spread = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    alike = F.col("label") == F.col("q_label")
    dealt = chunks.withColumn("own_lane", F.pmod(F.xxhash64("chunk"), F.lit(lanes)).cast("int"))
    met = spread.hint("merge").join(dealt, (F.col("own_lane") == F.col("lane")) & (alike if same else ~alike))

    def run(batches):
        found: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] not in found:
                    if len(found) >= HELD:
                        yield found.pop(next(iter(found))).batch()
                    found[row["block"]] = Best(row, slots, k)
                found[row["block"]].meet(row)
        for best in found.values():
            yield best.batch()

    part = met.drop("norm", "lane", "own_lane").mapInArrow(run, FOUND)
    window, entry = ["chunk", "place", "slot", "anchor_id"], F.struct((-F.greatest("score", F.lit(-MOST))).alias("key"), "vec_id", "of_chunk", "of_place", "score")
    best = lambda of: F.slice(F.array_sort(of), 1, k).alias("best")
    # First the best of a few tasks together, then of all: a window never has the rows of all tasks in one list.
    groups = max(2, round(lanes**0.5))
    some = part.groupBy(*window, (F.pmod(F.xxhash64("of_chunk"), F.lit(groups))).alias("group")).agg(best(F.collect_list(entry)))
    return staged(some.groupBy(*window).agg(best(F.flatten(F.collect_list("best")))), "found")


def fill(chunks: DataFrame, anchors: DataFrame, windows: DataFrame, slots: int, k: int, same: bool) -> DataFrame:
    """The first k rows of each window (chunk, place, slot, high, low): chunk, place, slot, anchor_id, rank, vec_id, of_chunk, of_place and score."""
    key = ["chunk", "place", "slot"]
    done = []
    for i, share in enumerate(ROUNDS):
        last = i == len(ROUNDS) - 1
        end, start = F.col("high").cast("double"), F.col("low").cast("double")
        least = F.greatest("low", F.least(end - (end - start) * share, F.lit(9e18)).cast("long"))
        open_ones = windows.withColumn("least", F.col("low") if last else least)
        listed = open_ones.groupBy("chunk", "place").agg(F.collect_list(F.struct("slot", "high", F.col("least").alias("low"))).alias("windows"))  # a few for each anchor
        found = first_rows(chunks, anchors.join(listed, ["chunk", "place"]), slots, k, same)
        full = found if last else found.filter(F.size("best") >= k)
        done.append(full)
        if last:
            break
        windows = staged(windows.join(full.select(*key), key, "left_anti"), "windows")
        if windows.isEmpty():
            break
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    ranked = whole.select(*key, "anchor_id", F.posexplode("best").alias("at", "b"))
    return ranked.select(*key, "anchor_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.of_chunk", "b.of_place", "b.score")


def share_down(score: Column, percent: int) -> Column:
    """floor(score * percent / 100) of a score of at least 0, without an overflow."""
    div = lambda x: F.call_function("div", x, F.lit(100))
    return div(score) * percent + div(score % 100 * percent)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; ``vectors`` has label, id and v, and anchors are the rows whose id is divisible by ``every``."""
    chunks = chunks_of(vectors)
    anchors = anchors_of(chunks, every)
    own = anchors.select("chunk", "place", F.lit(0).alias("slot"), F.col("most").alias("high"), F.when(F.col("most") == MOST, F.lit(LEAST)).otherwise(-F.col("most")).alias("low"))
    near = staged(fill(chunks, anchors, own, 1, positives, True).withColumn("slot", F.col("rank") - 1), "positives")
    least, up_to = F.col("score") - share_down(F.col("score"), 100 - low), share_down(F.col("score"), high)
    windows = near.filter(F.col("score") >= 0).select("chunk", "place", "slot", up_to.alias("high"), least.alias("low")).filter("high >= low")
    hard = fill(chunks, anchors, windows, positives, negatives, False)
    back = near.select("chunk", "place", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    rows = hard.join(back, ["chunk", "place", "slot"])
    return rows.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the table ``embeddings``, with its labels turned on where the id is divisible by 7."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors_of(embeddings, 256.0, turned))


ORACLE_SQL = """
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM good a JOIN good c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
