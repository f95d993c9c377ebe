"""The master by scope and version, streams that go on after a failure, and days that close once."""

import json

import pytest
from ledgerlight.operators import snapshot
from ledgerlight.operators.versions import Master
from ledgerlight.streaming import jobs
from pyspark.sql import functions as F

LAYOUT = snapshot.Layout(key=("institution_type", "prefecture_code", "k"), attributes=("name",), order="n", described=("name",))
SEEN = "2024-02-02 00:00:00"
MASTER = "k int, name string, status int, institution_type int, prefecture_code string, last_seen_download long, created_at timestamp, updated_at timestamp"
EDITION = "k int, name string, status int, institution_type int, prefecture_code string, n int"


def first(spark):
    rows = [(i, f"name {i}", 1, 1 + i % 2, f"0{1 + i % 3}") for i in range(30)]
    frame = spark.createDataFrame(rows, ", ".join(MASTER.split(", ")[:5]))
    at = F.lit("2024-01-01").cast("timestamp")
    return frame.withColumns({"last_seen_download": F.lit(1).cast("long"), "created_at": at, "updated_at": at})


def edition(spark, kind, area, changed="", gone=(), fresh=()):
    keys = [i for i in range(30) if 1 + i % 2 == kind and f"0{1 + i % 3}" == area and i not in gone]
    rows = [(i, f"name {i}{changed}", 1, kind, area, 1) for i in keys] + [(i, "fresh", 1, kind, area, 1) for i in fresh]
    return spark.createDataFrame(rows, EDITION)


def master_at(spark, root):
    return Master(spark, f"file://{root}", LAYOUT, first(spark).schema)


def state(master):
    return {(r.institution_type, r.prefecture_code, r.k): (r.name, r.status, r.last_seen_download) for r in master.read().collect()}


def told(master):
    return sorted((r.k, r.event_type, r.download_id) for r in master.events().collect())


def folders(root):
    return {str(p.relative_to(root)) for p in root.glob("rows/*/*/version=*")}


def test_an_edition_touches_its_scopes_only(spark, tmp_path):
    master = master_at(spark, tmp_path)
    master.create(first(spark))
    before = state(master)
    assert master.apply(1, edition(spark, 1, "01", "!", gone=(6,), fresh=(90,)), 2, "2024-02-01", SEEN)
    assert not master.apply(1, edition(spark, 1, "01", "?"), 2, "2024-02-01", SEEN)
    after = state(master)
    assert {k for k in after if after[k] != before.get(k)} == {(1, "01", k) for k in (0, 6, 12, 18, 24, 90)}
    assert after[1, "01", 6] == ("name 6", 2, 1) and after[1, "01", 90] == ("fresh", 1, 2)
    assert told(master) == [(0, 3, 2), (6, 2, 2), (12, 3, 2), (18, 3, 2), (24, 3, 2), (90, 1, 2)]
    assert {f for f in folders(tmp_path) if "version=1" in f} == {"rows/institution_type=1/prefecture_code=01/version=1"}
    plan = master.read([(1, "01")])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "version" in filters and "struct(institution_type" in filters and "INSET" not in plan.split("DataFilters: [")[1].split("]")[0]


def test_only_two_versions_remain(spark, tmp_path):
    master = master_at(spark, tmp_path)
    master.create(first(spark))
    for step in range(1, 5):
        master.apply(step, edition(spark, 2, "02", str(step)), step + 1, f"2024-02-0{step}", SEEN)
    assert master.steps() == [3, 4] and state(master)[2, "02", 1][0] == "name 14"
    own = {f for f in folders(tmp_path) if f.startswith("rows/institution_type=2/prefecture_code=02")}
    assert {f.split("version=")[1] for f in own} == {"3", "4"}
    assert {f.split("version=")[1] for f in folders(tmp_path) - own} == {"0"}
    assert master.read(step=3).filter("k = 1").head().name == "name 13"
    with pytest.raises(ValueError, match="cannot follow"):
        master.apply(2, edition(spark, 2, "02"), 9, "2024-02-09", SEEN)


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="part of the key"):
        Master(spark, f"file://{tmp_path}/x", snapshot.Layout(key=("k",), attributes=("name",)), first(spark).schema)
    master = master_at(spark, tmp_path)
    master.create(first(spark))
    with pytest.raises(ValueError, match="already"):
        master.create(first(spark))
    with pytest.raises(ValueError, match="rows without"):
        master.apply(1, edition(spark, 1, "01").withColumn("prefecture_code", F.lit(None).cast("string")), 2, "2024-02-01", SEEN)
    unordered = Master(spark, f"file://{tmp_path}/y", snapshot.Layout(key=LAYOUT.key, attributes=("name",)), first(spark).schema)
    unordered.create(first(spark))
    twice = edition(spark, 1, "01")
    assert unordered.apply(1, twice.union(twice), 2, "2024-02-01", SEEN)  # alike: no order is asked for
    with pytest.raises(Exception, match="no order"):
        unordered.apply(2, twice.union(edition(spark, 1, "01", "!")), 3, "2024-02-02", SEEN)
    assert unordered.steps() == [0, 1] and unordered.read().filter("name LIKE '%!'").count() == 0


class Cut(Exception):
    pass


def stream_of(spark, root):
    schema = edition(spark, 1, "01").withColumns({"download_id": F.lit(2).cast("long"), "published_on": F.lit("2024-02-01").cast("date"), "part": F.lit(0)}).schema
    return spark.readStream.schema(schema).parquet(f"file://{root}/inbox")


def arrive(spark, root, rows, download, part, parts_of):
    named = rows.withColumns({"download_id": F.lit(download).cast("long"), "published_on": F.lit("2024-02-01").cast("date"), "part": F.lit(part)})
    named.filter(F.floor(F.col("k") / 6) % parts_of == part).write.mode("append").parquet(f"file://{root}/inbox")


@pytest.mark.parametrize("cut", [None, "_commit", "retain", "remove"])
def test_a_stream_that_is_cut_off_goes_on(spark, tmp_path, monkeypatch, cut):
    expected = spark.createDataFrame([(2, 2), (3, 1), (4, 3)], "download_id long, parts int")
    master = master_at(spark, tmp_path)
    master.create(first(spark))

    def run():
        return jobs.run_snapshots(stream_of(spark, tmp_path), expected, master, SEEN, f"file://{tmp_path}/checkpoint")

    arrive(spark, tmp_path, edition(spark, 1, "01", "!"), 2, 0, 2)
    run().awaitTermination()
    assert state(master) == {k: v for k, v in state(master).items() if v[2] == 1}  # half an edition waits
    arrive(spark, tmp_path, edition(spark, 1, "01", "!"), 2, 1, 2)
    arrive(spark, tmp_path, edition(spark, 2, "02", "?", gone=(1,)), 3, 0, 1)
    arrive(spark, tmp_path, edition(spark, 1, "03", "x"), 4, 0, 3)  # two thirds never come
    if cut:
        whole, left = getattr(Master, cut), [1]

        def failing(self, *args, **kwargs):
            if left:
                left.pop()
                raise Cut(cut)
            return whole(self, *args, **kwargs)

        monkeypatch.setattr(Master, cut, failing)
        with pytest.raises(Exception, match="Cut|cut|STREAM"):
            run().awaitTermination()
        assert len(left) == 0
    run().awaitTermination()
    run().awaitTermination()  # nothing new
    after = state(master)
    assert after[2, "02", 1] == ("name 1", 2, 1) and after[2, "02", 7] == ("name 7?", 1, 3) and after[1, "03", 2] == ("name 2", 1, 1)
    assert {k for k in after if after[k][0].endswith("!")} == {(1, "01", k) for k in (0, 6, 12, 18, 24)}
    assert told(master) == sorted([(k, 3, 2) for k in (0, 6, 12, 18, 24)] + [(k, 3, 3) for k in (7, 13, 19, 25)] + [(1, 2, 3)])
    assert len(master.steps()) == 2 and len(list((tmp_path / "waiting").glob("*"))) <= 2 and not list((tmp_path / "arrived").glob("*"))


def test_days_close_once_and_late_entries_are_counted(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    day = 86_400
    begin = 1_704_034_800  # 2023-12-31 15:00 UTC, when a day of Tokyo begins
    line = lambda at, status=200, uri="/": json.dumps({"ts": float(at), "status": status, "request": {"uri": uri}})

    def run():
        stream = jobs.read_access_stream(spark, f"file://{log}")
        return jobs.run_access_days(stream, f"file://{tmp_path}/days", f"file://{tmp_path}/checkpoint")

    def days():
        return sorted((int(r.start.timestamp() - begin) // day, r.status, r.n, r.probes) for r in spark.read.parquet(f"{tmp_path}/days").collect())

    (log / "a").write_text("\n".join([line(begin + 5), line(begin + 6, 404, "/.env"), line(begin + day), line(begin + 2 * day + 1), "broken"]))
    assert run() == {"arrived": 4, "closed": 2, "held": 2, "late": 0}
    assert [d[0] for d in days()] == [0, 0]
    (log / "b").write_text("\n".join([line(begin + 7), line(begin + 8), line(begin + 8, 500), line(begin + day + 9), line(begin + 4 * day)]))
    assert run() == {"arrived": 5, "closed": 3, "held": 1, "late": 3}  # two of day 1 and one of day 2 close, one of day 4 opens
    assert run() == {"arrived": 0, "closed": 0, "held": 1, "late": 0}
    got = days()
    assert len({d[:2] for d in got}) == len(got)
    assert got[:2] == [(0, 200, 1, 0), (0, 404, 1, 1)] and (1, 200, 2, 0) in got
