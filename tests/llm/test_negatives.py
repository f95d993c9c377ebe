"""Hard negatives against a plain version, and the index of norms against all products."""

import random
from collections import defaultdict

import numpy as np
from ledgerlight.llm import negatives
from ledgerlight.llm.topk import LEAST, MOST
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score double"


def plain(rows, every=50, positives=5, negatives_=3):
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, own))
    score = lambda a, b: max(LEAST, min(MOST, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for n, (i, label, v) in enumerate(good):
        if i % every:
            continue
        scored = [(score(v, w), j, k) for m, (j, k, w) in enumerate(good) if m != n]
        near = sorted((-s, j) for s, j, k in scored if k == label)[:positives]
        for s, j in near:
            p = -s
            hard = sorted((-x, y) for x, y, k in scored if k != label and 50 * p <= 100 * x <= 95 * p)[:negatives_]
            out += [(i, j, r, y, p, -x) for r, (x, y) in enumerate(hard, 1)]
    return sorted(out)


def check(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, v, label, "x", 0.5) for i, v, label in rows], SCHEMA).repartition(parts)
    got = negatives.mine_embeddings(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def vectors(seed, n, dim, labels=10, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    kinds = rng.integers(0, labels, n)
    return [(i, (centres[k] + spread * rng.normal(size=dim)).tolist(), int(k)) for i, k in enumerate(kinds)]


def test_against_all_scores(spark):
    rows = vectors(1, 700, 20)
    rows += [(None, [1.0] * 20, 1), (5000, None, 1), (5050, [1.0] * 20, None), (5100, [1.0, None] * 10, 1), (5150, [float("nan")] * 20, 1), (5200, [float("inf")] * 20, 2)]
    rows += [(6000, [0.0] * 20, 3), (6050, [], 4), (6100, [1.0, 2.0], 5), (6150, rows[3][1], rows[3][2]), (6151, rows[3][1], rows[3][2])]
    check(spark, rows)


def test_ties_repeats_and_large_numbers(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(4)], i % 3) for i in range(200)]
    rows += rows[:60] + [(50, rows[50][1], 2), (50, rows[50][1], 2)]
    rows += [(700, [1e30, 1.0], 0), (701, [1e30, 2.0], 0), (750, [-3e38, 5.0], 1), (702, [5000.0, 1.0], 2), (800, [4100.0, 0.5], 2)]
    check(spark, rows, parts=5)


def test_one_label_holds_most_rows(spark):
    rows = [(i, v, 3 if i % 3 else k) for i, v, k in vectors(7, 400, 40, spread=0.3)]
    check(spark, rows, parts=9)


def test_no_rows_no_anchors_one_label(spark):
    check(spark, [(1, [1.0], 1), (2, [1.0], 2)])
    check(spark, [(50, [1.0], 1)])
    check(spark, [(i, [1.0, float(i)], 1) for i in range(1, 7)] + [(50, [1.0], 1)])
    assert negatives.mine_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 8)
    monkeypatch.setattr(negatives, "BLOCK", 2)
    check(spark, vectors(11, 500, 33, labels=4, spread=0.5))


def test_index_of_norms_loses_no_pair():
    rng = np.random.default_rng(2)
    for dim in (1, 5, 16, 17, 64, 70):
        scale = np.exp(-np.arange(dim) / 6)  # weight in few dimensions, so much stays out of the index
        anchors, rows = (np.floor(256 * scale * rng.normal(size=(n, dim))) for n in (40, 300))
        rows[:3] = 0
        every = anchors @ rows.T
        for share in (0.5, 0.9, 0.99, 0.9999):
            least = np.quantile(every, share, axis=1).astype("i8")
            q, r, value = negatives.reaching(anchors, rows, least)
            found = defaultdict(int, {(a, b): v for a, b, v in zip(q.tolist(), r.tolist(), value.tolist(), strict=True)})
            want = {(a, b): int(every[a, b]) for a, b in zip(*(x.tolist() for x in np.nonzero(every >= least[:, None])), strict=True)}
            assert dict(found) == want and len(q) == len(want)


def test_windows_close_at_once_where_they_can(spark):
    """A window that is filled in the first round is not asked for again."""
    rows = spark.createDataFrame([(i, [1.0, 0.0], 1) for i in range(20)] + [(50, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    chunks = negatives.chunks_of(negatives.vectors_of(rows, 256.0, F.col("label")))
    anchors = negatives.anchors_of(chunks, 50)
    windows = anchors.select("chunk", "place", F.lit(0).alias("slot"), F.col("most").alias("high"), (-F.col("most")).alias("low"))
    found = negatives.fill(chunks, anchors, windows, 1, 3, True)
    assert sorted(r.vec_id for r in found.filter("anchor_id = 50").collect()) == [0, 1, 2]
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_never_broadcast(spark, monkeypatch):
    """Copies of the blocks for each lane outgrow a broadcast, however small the file of the blocks is."""
    plans = []
    monkeypatch.setattr(negatives, "staged", lambda df, name, f=negatives.staged: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or f(df, name))
    check(spark, vectors(3, 300, 8))
    found = [plan for name, plan in plans if name == "found"]
    assert found and not any("BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan for plan in found)


def test_each_label_has_as_few_groups_as_it_needs(spark):
    rows = spark.range(470).selectExpr("id", "IF(id < 400, id % 10, IF(id < 410, 77, 88)) AS label")
    sizes = [(r.label, len(r.members)) for r in negatives.grouped(rows, 20, "id").collect()]
    assert sorted(label for label, _ in sizes) == sorted([*range(10), 77, 88, 88])  # 40, 10 and 60 rows
    assert sum(n for _, n in sizes) == 470


def test_one_block_held_at_a_time(spark, monkeypatch):
    for name, n in (("CHUNK", 8), ("BLOCK", 2), ("HELD", 1)):
        monkeypatch.setattr(negatives, name, n)
    check(spark, vectors(12, 500, 9, labels=3, spread=0.5))
