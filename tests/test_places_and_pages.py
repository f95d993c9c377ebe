"""Cells that split, names by their beginnings, pages that skip, words that are looked up, runs stitched together."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from ledgerlight.operators import export, hours, matching, search, snapshot
from pyspark.sql import functions as F


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_nearest_of_a_dense_city(spark, most):
    rng = random.Random(most)
    places = [(i, 35.70 + rng.gauss(0, 0.003), 139.70 + rng.gauss(0, 0.003), f"v{i}") for i in range(400)]
    places += [(400 + i, rng.uniform(35.5, 35.9), rng.uniform(139.5, 139.9), f"w{i}") for i in range(60)]
    places += [(900 + i, places[5][1], places[5][2], "twin") for i in range(30)] + [(999, 35.73, 139.73, "corner"), (-1, -35.0, -0.001, "south")]
    points = [(i, rng.uniform(35.6, 35.8), rng.uniform(139.6, 139.8)) for i in range(80)] + [(200 + i, 35.70 + rng.gauss(0, 0.004), 139.70 + rng.gauss(0, 0.004)) for i in range(60)]
    points += [(500, 35.73, 139.73), (501, 35.7, 139.7), (502, -35.01, 0.001), (503, 0.0, 0.0), (504, places[5][1], places[5][2])]
    p = spark.createDataFrame(points, "k int, lat double, lon double")
    q = spark.createDataFrame(places, "id int, lat double, lon double, name string")
    got = {r.k: r.name for r in matching.nearest(p, q, ["k"], ["name"], most=most).collect()}
    for k, y, x in points:
        near = [(metres(y, x, b, c), i, n) for i, b, c, n in places if abs(y - b) <= 0.03 and abs(x - c) <= 0.03]
        assert got[k] == (min(near)[2] if near else None), k


def test_split_cells_are_bounded(spark):
    rng = random.Random(1)
    places = spark.createDataFrame([(35.7 + rng.random() * 0.01, 139.7 + rng.random() * 0.01) for _ in range(3000)] + [(36.5, 140.0)], "_lat double, _lon double")
    near = places.withColumns({"_y": F.floor(F.col("_lat") / 0.03), "_x": F.floor(F.col("_lon") / 0.03)})
    cells, parts = matching.split_cells(near, 0.03, 100)
    rows = {(r._y, r._x): r.depth for r in cells.collect()}
    assert min(rows.values()) == 0 and max(rows.values()) >= 3
    side = lambda c: F.floor(F.col(c) / (F.lit(0.03) / F.pow(F.lit(2.0), "depth")))
    assert near.join(cells, ["_y", "_x"]).groupBy("_y", "_x", side("_lat"), side("_lon")).count().agg(F.max("count")).head()[0] <= 100
    assert parts.filter("level = 0").count() == sum(d > 0 for d in rows.values())


def test_names_by_their_beginnings(spark):
    names = spark.createDataFrame([("a", "x"), ("a", "xy"), ("a", "xyz"), ("a", "xyzab"), ("a", "xyq"), ("b", "x"), ("a", ""), ("a", None)], "s string, name string")
    rows = spark.createDataFrame([(1, "a", "xyzabc"), (2, "a", "xy"), (3, "a", "x"), (4, "b", "xyzab"), (5, "a", ""), (6, "a", None), (7, "c", "x"), (8, "a", "xyzaX")], "k int, s string, text string")
    met = matching.begun_by(rows, names, ["s"], "text", "name")
    assert sorted((r.k, r.name) for r in met.collect()) == [(1, "x"), (1, "xy"), (1, "xyz"), (1, "xyzab"), (2, "x"), (2, "xy"), (3, "x"), (4, "x"), (8, "x"), (8, "xy"), (8, "xyz")]


def test_candidates_grow_with_the_rows_only(spark):
    """Many names that share their first characters are no candidates of a text that begins with none of them."""
    names = spark.range(5000).select(F.lit("a").alias("s"), F.concat(F.lit("common "), F.col("id").cast("string")).alias("name"))
    rows = spark.range(200).select("id", F.lit("a").alias("s"), F.concat(F.lit("common "), (F.col("id") * 7).cast("string"), F.lit("/1")).alias("text"))
    met = matching.begun_by(rows, names, ["s"], "text", "name")
    assert met.count() <= 4 * 200 and met.filter("length(name) = length(text) - 2").count() == 200
    lengths = names.groupBy("s", F.substring("name", 1, matching.HEAD)).agg(F.collect_set(F.length("name")).alias("n"))
    assert lengths.agg(F.max(F.size("n"))).head()[0] == 4


def test_land_registry_rows_repeat(spark):
    names = spark.createDataFrame([("13", "千代田区", "13101")], "prefecture_code string, name string, code string")
    feature = lambda kind, name, address, lat: ((kind, name, address), ("Point", [139.7, lat]))
    rows = [feature("1", "甲", "千代田区2番地3", 35.1), feature("2", "乙", "千代田区2番地3", 35.2), feature("1", "甲", "千代田区2番地3", 35.1), feature("1", "丙", None, 35.3), feature("1", "丁", "何処か", 35.4)]
    features = spark.createDataFrame(rows, "properties struct<P04_001:string,P04_002:string,P04_003:string>, geometry struct<type:string,coordinates:array<double>>")
    got = sorted((r.name, r.institution_type, r.municipality_code, r.address_key, r.latitude) for r in matching.land_locations(features, names, F.lit("13")).collect())
    assert got == sorted([("乙", 2, "13101", "2-3", 35.2), ("甲", 1, "13101", "2-3", 35.1), ("甲", 1, "13101", "2-3", 35.1)])


def test_pages_skip_what_lies_before(spark, tmp_path):
    start = datetime(2020, 1, 1)
    rows = spark.range(20000).select("id", F.when(F.col("id") % 500 > 0, F.timestamp_seconds(F.lit(start.timestamp()) + F.floor(F.col("id") * 7919 % 20000 / 3) * 86400)).alias("at"), F.repeat(F.lit("x"), 50).alias("pad"))
    search.write_ordered(rows, str(tmp_path / "t"), "at", "id", group_bytes=16 << 10)
    stored = spark.read.parquet(str(tmp_path / "t"))
    every = [(r.at, r.id) for r in rows.orderBy(F.asc_nulls_first("at"), "id").collect()]
    for i in (0, 20, 39, 40, 777, 19_900, 19_999):
        got = search.page_after(stored, every[i], 25, "at", "id")
        assert [(r.at, r.id) for r in got.collect()] == every[i + 1 : i + 26], i
    late = search.page_after(stored, every[19_000], 25, "at", "id").select("id")
    assert "PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at" in late._jdf.queryExecution().executedPlan().toString()
    late.collect()
    read = [int(x) for x in _metric(late, "number of output rows", "Scan parquet")]
    assert sum(read) < 8000
    assert [r.id for r in search.page_after(stored, (None, 9500), 3, "id", "id").collect()] == [9501, 9502, 9503]
    assert search.page_after(stored, (start + timedelta(days=10**5), 0), 3, "at", "id").count() == 0


def _metric(df, name, node):
    """Values of a metric of the plan's nodes of a kind, after it ran."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        if p.nodeName().startswith(node.split(" ")[0]) and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_words_are_looked_up(spark, tmp_path):
    rng = random.Random(3)
    words = ["中央", "病院", "みなみ", "abc", "abd", "bcd", "x", "é"]
    rows = [(i, "".join(rng.choices(words, k=rng.randint(0, 4))) or None, rng.choice(words)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, name string, address string")
    search.write_word_index(frame, "id", ["name", "address"], str(tmp_path / "w"), blocks=8)
    for query in ("中央", "病院　みなみ", "abcd", "x", "ABC ｘ", "", "bca", "é中", "院み 央"):
        got = sorted(tuple(r) for r in search.indexed_words(spark, str(tmp_path / "w"), query, "id", ["name", "address"]).collect())
        want = sorted(tuple(r) for r in search.has_words(frame, query, ["name", "address"], normalized=True).collect())
        assert got == want and (query in ("bca",) or len(want) < 300 or query == ""), query
    search.write_word_index(frame.filter("id = 7").withColumn("name", F.lit("only one")), "id", ["name"], str(tmp_path / "one"), blocks=8)
    assert search.indexed_words(spark, str(tmp_path / "one"), "one", "id", ["name"]).count() == 1
    plan = search.indexed_words(spark, str(tmp_path / "w"), "中央", "id", ["name", "address"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_block", plan) and "EqualTo(gram,中央)" in plan


def test_runs_are_stitched(spark):
    keys = ["a", "a", "b", "b", None, None, "a", "c", "c", "c", "c", "c", "b"]
    rows = spark.createDataFrame([(u, i, k) for u in ("x", "y") for i, k in enumerate(keys)] + [("z", 0, "a"), ("z", 900, "a"), ("z", 2000, "a")], "u string, n int, k string")
    want = [("x", "a", 2), ("x", "b", 2), ("y", "a", 2), ("y", "b", 2)]
    for stretch in (1, 2, 3, 5, 100, 100_000):
        got = sorted((r.u, r.k, r.runs) for r in hours.not_contiguous(rows, "k", "n", ["u"], stretch).collect())
        assert got == want, stretch


def test_files_are_digested_in_pieces(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 1000
    for i, n in enumerate((0, 1, 999, 1000, 1001, len(data))):
        (tmp_path / f"part-{i}").write_bytes(data[:n])
    files = spark.createDataFrame([(f"file://{tmp_path}/part-{i}",) for i in range(6)], "path string")
    got = {r.path[-1]: (r.bytes, r.sha256) for r in export.file_digests(files, chunk=1000).collect()}
    assert got == {str(i): (n, hashlib.sha256(data[:n]).hexdigest()) for i, n in enumerate((0, 1, 999, 1000, 1001, len(data)))}


def test_counters_are_observed_in_one_scan(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit(None).cast("string").alias("started"), F.lit("2024-01-01").alias("updated_at"))
    rows.write.parquet(str(tmp_path / "m"))
    listed = spark.createDataFrame([(3, "a"), (4, "b"), (4, "b"), (500, "c")], "code long, started string")
    after, counters = snapshot.enrich_observed(spark.read.parquet(str(tmp_path / "m")), listed, F.col("id"), ["started"], "2024-02-01")
    assert after._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    after.write.parquet(str(tmp_path / "n"))
    assert counters.get == {"listed": 3, "matched": 2, "changed": 2}
    plain, counted = snapshot.enrich_by_code(spark.read.parquet(str(tmp_path / "m")), listed, F.col("id"), ["started"], "2024-02-01")
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "n")).select(*plain.columns).collect()), key=str)
    assert counted.head().asDict() == counters.get
