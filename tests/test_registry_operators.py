"""Operators whose input the driver's tables do not have, on literal rows."""

import datetime
import hashlib
import io
import json
import tracemalloc
import unicodedata
import zipfile

import pyarrow as pa
import pytest
from ledgerlight.functions import fixed, geo, text
from ledgerlight.functions.variants import VARIANTS
from ledgerlight.operators import documents, events, export, hours, matching, records, search, snapshot
from ledgerlight.plans import mapped
from ledgerlight.sources import files, ledger, links
from ledgerlight.streaming import jobs
from pyspark.sql import functions as F

D = datetime.date


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_texts(spark):
    assert values(spark, ["a", None], text.replace_private_use) == ["土〓a", None]
    assert values(spark, ["ＡＢ　髙", None], lambda c: text.normalize_text(c, {"髙": "高"})) == ["AB 高", None]
    assert values(spark, ["１ー２ビルー", "12‐3一丁目二十三丁目十丁目ケヵ"], text.normalize_for_matching) == ["1-2ビルー", "12-31丁目23丁目10丁目ヶヶ"]
    assert values(spark, ["霞 ヶ関ヵ"], text.normalize_station) == ["霞ケ関カ"]
    assert values(spark, ["医療法人社団 青空会 山田・クリニック", "(医)青空会やまだ皮フ科", "医療法人青空会"], text.name_key) == ["山田クリニック", "やまだ皮膚科", "医療法人青空会"]
    assert values(spark, ["北海道札幌市大字北一条西三丁目12番地の5号 ビル3F", "どこか"], text.address_key) == ["札幌市北1条西3-12-5", "どこか"]
    assert values(spark, ["0012番地の03号", "字北5-6", "なし"], text.house_numbers) == [("12", "3"), ("5", "6"), (None, None)]
    assert values(spark, ["http//例え.example.jp", "www.example.jp/あ", "HTTPS://A.example.jp/x y", "mailto:a", "", "ftp://a.b"], text.clean_url) == [None, "http://www.example.jp/%E3%81%82", "https://A.example.jp/x%20y", None, None, None]
    assert values(spark, [" ｱｵ ", "", "あ" * 256], text.kana_reading) == ["アオ", None, None]
    assert values(spark, ["昭47. 3. 1", "令元.5.1", "平2.2.30", "新規"], text.era_date) == [D(1972, 3, 1), D(2019, 5, 1), None, None]
    assert values(spark, ["x（令和8年9月1日現在）", "なし"], text.page_date) == [D(2026, 9, 1), None]
    probes = ["/.env", "/.well-known/x", "/index.php", "/a/index.php", "/wp-admin/", "/x.sql", "/%2Egit", "/a+b", "/%zz", "/ok"]
    assert values(spark, probes, text.scanner_path) == [True, False, False, True, True, True, True, False, False, False]
    assert values(spark, ["小児科", "心臓血管外科", "歯科口腔外科", "外", "謎"], text.category_of) == [3, 23, 15, 2, None]
    assert len(fixed.MARKERS) == 74 and len(fixed.PRIVATE_USE) == 55 and len(fixed.PREFECTURES) == 47


def test_variant_kanji_become_usual_ones_in_every_normal_form(spark, tmp_path):
    assert len(VARIANTS) == 368 and VARIANTS["髙"] == "高" and not set(VARIANTS) & set(VARIANTS.values())
    assert values(spark, ["澤田クリニック　ＡＢＣ", "髙橋", "德田", "\ufa19社", "渡邉﨑", "山田太郎", "", None], text.normalize_text) == ["沢田クリニック ABC", "高橋", "徳田", "神社", "渡辺崎", "山田太郎", "", None]
    assert values(spark, ["髙"], lambda c: text.normalize_text(c, {})) == ["髙"]
    forms = [text.normalize_address, text.normalize_station, text.normalize_for_matching, text.name_key, text.address_key]
    assert [values(spark, ["澤"], make) for make in forms] == [["沢"]] * len(forms)
    docs = ["a", "澤 é", "ｱ", None]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in ("a", "沢 é", "ア", None)]
    assert [r[1] for r in mapped.normalize_text(spark, str(tmp_path)).orderBy("doc_id").collect()] == want


def test_a_batch_of_long_texts_is_never_python_strings_as_a_whole():
    texts = pa.array(["ａé" * 10_000, None] * 800)  # 40 MB
    tracemalloc.start()
    made = text.nfkc.func(texts)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 8 << 20
    assert made.to_pylist() == ["aé" * 10_000, None] * 800
    assert [text.nfkc.func(pa.array(t, pa.string())).to_pylist() for t in ([], [None], ["", "ｱ"])] == [[], [None], ["", "ア"]]


def test_texts_that_nfkc_leaves_as_they_are_do_not_go_through_python(spark, monkeypatch):
    sent = F.udf(lambda t: None if t is None else f"<{t}>", "string")
    monkeypatch.setattr(text, "nfkc", sent)
    assert values(spark, ["", "Größe\n漢字 かな", None, "e\u0301", "か\u3099", "ﾊﾟ", "a\n𠀀", "한"], text.normalize_text) == ["", "Größe\n漢字 かな", None, "<e\u0301>", "<か\u3099>", "<ﾊﾟ>", "<a\n𠀀>", "<한>"]


def test_inert_characters_are_inert(spark):
    every = spark.range(0x110000).select("id").filter("id NOT BETWEEN 55296 AND 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    inert = [chr(r[0]) for r in every.filter(char.rlike(f"^[{text.INERT}]$")).collect()]
    second = {d[-1] for c in range(0x110000) if len(d := unicodedata.normalize("NFD", chr(c))) > 1}  # those that join what stands before
    assert len(inert) > 27_000
    assert [c for c in inert if not unicodedata.is_normalized("NFKC", c) or unicodedata.combining(c) or c in second] == []


def test_keys_that_appear_or_go_meet_in_one_grouping(spark):
    before = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", None), (None, 7)], "k string, n int")
    after = spark.createDataFrame([(2, "b"), (1, "b"), (2, "b"), (None, "c")], "n int, k string")
    found = snapshot.appeared_and_gone(before, after, ["k", "n"])
    expected = [("a", 1, "gone"), ("b", 2, "new"), ("c", None, "gone"), ("c", None, "new"), (None, 7, "gone")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


ROW = ["1", "07,3355,2", "港診療所", "〒231－0861横浜市中区元町3丁目", "045(212)3456", "開設者", "管理者", "平12. 9.15", "療養　　 48", "病院"]


def test_records(spark):
    rows = [("u", 1, ["医療機関一覧"]), ("u", 2, ROW), ("u", 3, ["", "", "", "", "", "", "", "新規", "一般　 120　 一般15", "現存"]), ("u", 4, ["", "", "", "", "", "", "", "令6. 7.10", "外　小児科", ""])]
    rows += [("u", 5, ["", "", "", "", "", "", "", "更新", "", "休止"]), ("u", 6, ["2", "12", "x", "bad"]), ("v", 1, ROW)]
    grouped = records.group_records(spark.createDataFrame(rows, "unit string, row_no int, cells array<string>").repartition(3))
    assert sorted((r.unit, r.record, len(r.cells)) for r in grouped.collect()) == [("u", 1, 4), ("u", 2, 1), ("v", 1, 1)]
    mapped = records.map_records(grouped, F.lit(1))
    good, bad = records.split_errors(mapped, fail=False)
    r = good.filter("unit = 'u'").head()
    assert (r.facility_code, r.institution_type, r.status, r.name, r.postal_code, r.phone_number) == ("0733552", 1, fixed.SUSPENDED, "港塚診療所", "231-0861", "045-212-3456")
    assert r.designated_on == D(2000, 9, 15) and [tuple(h) for h in r.designation_history] == [("新規", D(2024, 7, 10)), ("更新", None)]
    assert r.bed_counts == {"療養": 48, "一般": 135} and r.department_categories == [2, 3]
    assert "facility code" in bad.head()["_error"]
    with pytest.raises(Exception, match="facility code"):
        records.split_errors(mapped)[0].collect()


def test_derived_and_labels(spark):
    df = spark.createDataFrame([("13", 4, "0000001", "a", "b"), ("13", 3, "0000002", "a", "a")], "p string, t int, c string, name string, k string")
    assert [r[0] for r in df.select(records.institution_code(F.col("p"), F.col("t"), F.col("c"))).collect()] == ["1340000001", "1330000002"]
    out = records.recompute_derived(df, {"k": F.col("name")}).orderBy("c").collect()
    assert [r["_changed"] for r in out] == [True, False] and [r.k for r in out] == ["a", "a"]
    assert documents.with_labels(df, {"p": fixed.PREFECTURES}).head().p == ("13", "東京都")


def test_diff(spark):
    kinds = {"a": "string", "n": "double", "d": "date", "m": "map<string,int>"}
    df = spark.sql("SELECT named_struct('a', '01', 'n', 1.0000001D, 'd', date'2024-01-01', 'm', map('x', 1, 'y', 2)) AS o, named_struct('a', '1', 'n', 1.0D, 'd', CAST(NULL AS date), 'm', map('y', 2, 'x', 1)) AS w")
    got = df.select(snapshot.diff_attributes(F.col("o"), F.col("w"), kinds)).head()[0]
    assert set(got) == {"a", "d"} and tuple(got["a"]) == ("01", "1") and got["d"]["new"] is None


def test_origins_of_same_edition(spark):
    layout = snapshot.Layout(key=("k", "institution_type", "prefecture_code"), attributes=("v",))
    master = spark.sql("SELECT 1 AS k, 1 AS institution_type, '01' AS prefecture_code, 'a' AS v, 1 AS status, CAST(7 AS long) AS last_seen_download, timestamp'2024-01-01' AS created_at, timestamp'2024-01-01' AS updated_at")
    incoming = spark.sql("SELECT * FROM VALUES (1, 1, '01', 'b', 1), (2, 1, '01', 'n', 1), (3, 1, '02', 'n', 3) AS t(k, institution_type, prefecture_code, v, status)")
    downloads = spark.sql("SELECT CAST(7 AS long) AS id, date'2024-02-01' AS published_on, CAST(NULL AS timestamp) AS superseded_at")
    after, logged = snapshot.apply_snapshot(master, incoming, 8, "2024-02-01", "2024-02-02 00:00:00", layout, downloads)
    assert {r.k: (r.event_type, r.origin) for r in logged.collect()} == {1: (3, 3), 2: (1, 2), 3: (1, 1)}
    assert {r.k: (r.v, r.last_seen_download, str(r.created_at)[:10]) for r in after.collect()} == {1: ("b", 8, "2024-01-01"), 2: ("n", 8, "2024-02-02"), 3: ("n", 8, "2024-02-02")}
    _, forced = snapshot.apply_snapshot(master, incoming, 8, "2024-02-01", "2024-02-02 00:00:00", layout, None, reimport=True)
    assert {r.origin for r in forced.collect()} == {3}
    failed = spark.sql("SELECT '0' AS facility_code")
    layout2 = snapshot.Layout(key=("k", "institution_type", "prefecture_code"), attributes=("v",))
    rows = master.withColumn("facility_code", F.lit("0"))
    assert snapshot.reconcile_closures(rows, incoming.filter("k = 2"), 8, "2024-02-01", "2024-02-02 00:00:00", layout2, failed)[1].count() == 0
    assert snapshot.reconcile_closures(rows, incoming.filter("k = 2"), 8, "2024-02-01", "2024-02-02 00:00:00", layout2)[1].count() == 1


def test_snapshot_with_repeats_payloads_and_positions(spark):
    layout = snapshot.Layout(key=("k",), attributes=("name", "address"), order="n")
    master = spark.sql("""SELECT *, CAST(7 AS long) AS last_seen_download, timestamp'2024-01-01' AS created_at, timestamp'2024-01-01' AS updated_at, 35.0D AS latitude, 139.0D AS longitude, 1 AS geocode_level, address AS geocoded_address, upper(name) AS name_normalized
      FROM VALUES (1, 'a', 'x', 1, 1, '01'), (2, 'b', 'x', 1, 1, '01'), (3, 'c', 'x', 2, 1, '01'), (4, 'd', 'x', 1, 1, '01'), (5, 'e', 'x', 1, 2, '01') AS t(k, name, address, status, institution_type, prefecture_code)""")
    incoming = spark.sql("SELECT * FROM VALUES (1, 'old', 'y', 1, 1, '01', 1), (1, 'a', 'y', 1, 1, '01', 2), (2, 'bb', 'x', 1, 1, '01', 3), (3, 'c', 'x', 3, 1, '01', 4), (6, 'f', 'z', 1, 1, '02', 5), (6, 'g', 'z', 1, 1, '02', 6) AS t(k, name, address, status, institution_type, prefecture_code, n)")
    after, logged = snapshot.apply_snapshot(master, incoming, 8, "2024-02-01", "2024-02-02 00:00:00", layout, derive={"name_normalized": F.upper("name")})
    rows = {r.k: r for r in after.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6] and after.count() == 6 and after.columns == master.columns
    assert (rows[1].name, rows[1].latitude, rows[1].geocode_level, rows[1].geocoded_address) == ("a", None, None, None)
    assert (rows[2].name_normalized, rows[2].latitude) == ("BB", 35.0) and rows[6].name_normalized == "G" and rows[6].prefecture_code == "02"
    told = {r.k: (r.event_type, r.origin, {a: tuple(c) for a, c in r.payload.items()}) for r in logged.collect()}
    assert told == {1: (3, 2, {"address": ("x", "y")}), 2: (3, 2, {"name": ("b", "bb")}), 3: (1, 2, {"name": (None, "c"), "address": (None, "x")}), 6: (1, 1, {"name": (None, "g"), "address": (None, "z")})}
    closed, gone = snapshot.reconcile_closures(after, incoming, 8, "2024-02-01", "2024-02-02 00:00:00", layout, origin=fixed.REPROCESSED)
    assert [(r.k, r.origin, {a: tuple(c) for a, c in r.payload.items()}) for r in gone.collect()] == [(4, 3, {"name": ("d", None), "address": ("x", None)})]
    assert {r.k for r in closed.filter("status = 2").collect()} == {4}


def test_scope(spark):
    rows = spark.sql("SELECT '01' AS prefecture_code, 1 AS institution_type, 1 AS k UNION ALL SELECT '13', 4, 2")
    log = spark.sql("SELECT 1 AS k UNION ALL SELECT 2")
    downloads = spark.sql("SELECT 1 AS category, array('13', '14') AS prefecture_codes UNION ALL SELECT 2, array('01')")
    kept, logged, left = snapshot.prune_out_of_scope(rows, log, downloads, ["13"], [], [], ["k"])
    assert (kept.count(), logged.head().k, left.head().category) == (1, 2, 1)
    with pytest.raises(ValueError, match="99"):
        snapshot.in_scope(rows, ["99"], [])


def test_event_document(spark):
    change = "named_struct('old', '1', 'new', '2')"
    lists = "named_struct('old', '[1,2]', 'new', CAST(NULL AS string))"
    df = spark.sql(f"SELECT 1 AS id, 3 AS event_type, 2 AS origin, date'2024-01-01' AS occurred_on, timestamp'2024-01-02' AS created_at, false AS is_reopening, map('status', {change}, 'founder_name', {change}, 'bureau_code', {change}, 'zz', {change}, 'department_categories', {lists}) AS payload")
    r = events.event_document(df).head()
    assert [c.attribute for c in r.changes] == ["status", "bureau", "department_categories", "zz"] and json.loads(r.changes[0].old) == {"code": "1", "label": "指定中"} and r.is_reopening is None
    assert json.loads(r.changes[1].new)["label"] == "東北厚生局" and [c["label"] for c in json.loads(r.changes[2].old)] == ["内科", "外科"] and r.changes[2].new is None
    assert tuple(r.event_type) == (3, "変更") and tuple(r.origin) == (2, "検知")


def test_search_bounds(spark):
    df = spark.range(10)
    for bad in ((0, 25), (1, 101), (401, 25)):
        with pytest.raises(ValueError):
            search.page(df, *bad)
    assert search.has_reason(spark.sql("SELECT array(named_struct('reason', '新規', 'date', date'2024-01-01')) AS designation_history"), "新規").count() == 1
    rx = spark.sql("SELECT date'2024-01-01' AS e_prescription_started_on UNION ALL SELECT NULL")
    assert search.e_prescribes(rx, True).count() == search.e_prescribes(rx, False).count() == 1
    assert search.has_words(spark.createDataFrame([("ABC病院", "x")], "a string, b string"), "ａbc　X", ["a", "b"], normalized=True).count() == 1
    assert search.has_words(spark.createDataFrame([("ＡＢＣ病院", "x")], "a string, b string"), "abc X", ["a", "b"]).count() == 1


def test_opening_periods(spark):
    e = [("f", 1, "mon", "09:00", "12:00", None, None), ("f", 1, "mon", "12:00", "24:00", None, None), ("f", 1, "tue", "22:00", "02:00", "21:30", "02:00"), ("f", 1, "wed", "09:00", "09:00", None, None), ("f", 1, "holiday", "20:00", "03:00", None, None), ("f", 2, "fri", "10:00", "11:00", None, None)]
    entries = spark.createDataFrame(e, "f string, s int, day string, opens string, closes string, reception_opens string, reception_closes string")
    weekly = spark.createDataFrame([("f", 5)], "f string, day int")
    monthly = spark.createDataFrame([("f", 3, 1), ("f", 3, 5)], "f string, day int, week int")
    got = sorted(tuple(r)[1:] for r in hours.build_periods(entries, ["f"], "s", weekly, monthly).collect())
    assert got == [(1, 32400, 86400, 31), (2, 77400, 86400, 31), (3, 0, 7200, 14), (8, 72000, 86400, 31)]


def test_closures_and_locations(spark):
    df = spark.createDataFrame([("0", "1", "0", "", "1", "年末（改行）"), ("", "", "", "", "", "")], "m string, t string, m1 string, t2 string, h string, o string")
    made = hours.closures({"mon": F.col("m"), "tue": F.col("t")}, {(1, "mon"): F.col("m1"), (1, "tue"): F.lit("0"), (2, "tue"): F.col("t2")}, F.col("h"), F.col("o"))
    a, b = (r[0] for r in df.select(made).collect())
    assert a.weekly == ["mon"] and [tuple(m) for m in a.monthly] == [(1, "tue")] and a.holidays is False and a.other == "年末\n"
    assert b is None or b.weekly == []
    src = spark.createDataFrame([("1", "院", "1", "2", "住所", "35.1", "0.0"), ("", "院", "1", "2", "x", "1", "1")], "ID string, N string, P string, M string, A string, Y string, X string")
    out = hours.locations_from_source(src, {"id": "ID", "name": "N", "prefecture": "P", "municipality": "M", "address": "A", "latitude": "Y", "longitude": "X"}, F.lit(1)).collect()
    assert len(out) == 1 and out[0].municipality_code == "01002" and out[0].longitude is None and out[0].latitude is None and out[0].closures is None
    full = spark.createDataFrame([("1", "医療法人 山田・医院", "13", "101", "千代田区1丁目2番3号", "35.1", "139.1", "ﾔﾏﾀﾞ", "www.a.example", "0", "1", "0")], "ID string, N string, P string, M string, A string, Y string, X string, K string, W string, D string, E string, H string")
    names = {"id": "ID", "name": "N", "prefecture": "P", "municipality": "M", "address": "A", "latitude": "Y", "longitude": "X", "kana": "K", "website": "W", "weekly_mon": "D", "monthly_2_tue": "E", "holiday": "H"}
    r = hours.locations_from_source(full, names, F.lit(1)).head()
    assert (r.name_key, r.address_key, r.name_kana, r.website_url, float(r.latitude)) == ("山田医院", "千代田区1-2-3", "ヤマダ", "http://www.a.example", 35.1)
    assert r.closures.weekly == ["mon"] and r.closures.monthly == [] and r.closures.holidays is True
    runs = hours.not_contiguous(spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 3, "a")], "u string, n int, k string"), "k", "n", ["u"])
    assert [(r.k, r.runs) for r in runs.collect()] == [("a", 2)]
    assert hours.exclude_ids(spark.range(3), spark.createDataFrame([(1,)], "id long"), "id").count() == 2


def test_municipalities(spark):
    m = spark.createDataFrame([("01101", "01", "札幌市中央区"), ("01102", "01", "札幌市北区"), ("01303", "01", "石狩郡当別町"), ("13362", "13", "大島町"), ("13421", "13", "小笠原村"), ("26101", "26", "京都市北区")], "code string, prefecture_code string, name string")
    names = matching.municipality_names(m)
    rows = spark.createDataFrame([(1, "01", "北海道札幌市北区北7条"), (2, "01", "当別町1"), (3, "01", "どこか"), (4, "13", "東京都大島町元町"), (5, "13", "父島小笠原村1"), (6, "26", "京都市北区x")], "id int, prefecture_code string, address string")
    got = {r.id: (r.municipality_code, r.remainder) for r in matching.resolve_municipality(rows, names, ["id"]).collect()}
    assert got == {1: ("01102", "北7条"), 2: ("01303", "1"), 3: (None, None), 4: ("13362", "元町"), 5: ("13421", "1"), 6: ("26101", "x")}


TOWN = "lg_code string, machiaza_id string, oaza_cho string, chome string, chome_number string, koaza string, rsdt_addr_flg string, ablt_date string, ord int"


def registry(spark):
    towns = spark.createDataFrame([
        ("l", "0001001", "青空", "一丁目", "1", "", "1", "", 1), ("l", "0001002", "青空", "二丁目", "2", "", "1", "", 2), ("l", "0002000", "大字緑", "", "", "", "0", "", 3),
        ("l", "0002101", "大字緑", "", "", "字谷", "0", "", 4), ("l", "0003000", "緑町", "", "", "", "0", "", 5), ("l", "0009000", "廃", "", "", "", "0", "2020-01-01", 6), ("l", "0004001", "京", "一丁", "1", "", "1", "", 7),
    ], TOWN)
    return matching.town_spellings(towns)


def test_towns(spark):
    asked = {1: "青空1-2-3", 2: "青空2丁目4", 3: "大字緑字谷5", 4: "緑町7", 5: "緑8", 6: "廃1", 7: "京1丁5", 8: "京9丁5", 9: "通り上る青空1丁目2", 10: "青空5-6", 11: "谷3"}
    rows = spark.createDataFrame([(i, "l", t) for i, t in asked.items()], "id int, lg_code string, remainder string")
    got = {r.id: (r.machiaza_id, r.rest) for r in matching.match_town(rows, registry(spark), ["id"]).collect()}
    assert got == {1: ("0001001", "2-3"), 2: ("0001002", "4"), 3: ("0002101", "5"), 4: ("0003000", "7"), 5: ("0002000", "8"), 7: ("0004001", "5"), 9: ("0001001", "2"), 11: ("0002101", "3")}


def test_geocode(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    at = "rep_lat string, rep_lon string, ord int, ablt_date string"
    homes = frame([("l", "0001001", "02", "003", "", "1", "1", 1, "")], f"lg_code string, machiaza_id string, blk_num string, rsdt_num string, rsdt2_id string, {at}")
    blocks = frame([("l", "0001001", "2", "2", "2", 1, "")], f"lg_code string, machiaza_id string, blk_num string, {at}")
    towns = frame([("l", "0001001", "3", "3", 1, ""), ("l", "0002000", "4", "4", 2, ""), ("l", "0003000", "", "", 3, "")], f"lg_code string, machiaza_id string, {at}")
    parcels = frame([("l", "0002101", "b", "5", "2", ""), ("l", "0002101", "a", "5", "1", "")], "lg_code string, machiaza_id string, prc_id string, prc_num1 string, prc_num2 string, ablt_date string")
    spots = frame([("l", "0002101", "b", "6", "6", 1), ("l", "0002101", "a", "7", "7", 2)], "lg_code string, machiaza_id string, prc_id string, rep_lat string, rep_lon string, ord int")
    reg = {"residences": homes, "blocks": blocks, "towns": towns, "parcels": matching.parcel_positions(parcels, spots)}
    t = [(1, "0001001", True, False, "2-3"), (2, "0001001", True, False, "2-9"), (3, "0001001", True, False, "x"), (4, "0002101", False, True, "5-2"), (5, "0002101", False, True, "5"), (6, "0002101", False, True, "9"), (7, "0003000", False, True, "1")]
    targets = frame([(i, "l", *r) for i, *r in t], "id int, lg_code string, machiaza_id string, residential boolean, parcel boolean, rest string")
    got = {r.id: (r.level, r.lat) for r in matching.geocode(targets, reg, ["id"]).collect()}
    assert got == {1: (1, 1.0), 2: (2, 2.0), 3: (5, 3.0), 4: (3, 6.0), 5: (4, 7.0), 6: (5, 4.0)}


def test_refine_and_store(spark):
    rows = spark.createDataFrame([(1, 1, "m", "a", 35.0, 139.0, 5, "k"), (2, 1, "m", "b", None, None, None, "k"), (3, 4, "m", "c", 35.0, 139.0, 5, "k"), (4, 1, "m", "d", 35.0, 139.0, 1, "k")], "id int, institution_type int, municipality_code string, address string, latitude double, longitude double, geocode_level int, address_key string")
    matches = spark.createDataFrame([(i, 35.01, 139.0, "k" if i != 2 else "z") for i in (1, 2, 3, 4)], "id int, lat double, lon double, address_key string")
    centers = spark.createDataFrame([("m", 35.1, 139.0)], "municipality_code string, lat double, lon double")
    level = lambda df: {r.id: r.geocode_level for r in df.collect()}
    assert level(matching.refine_by_hours_source(rows, matches, centers, "id")) == {1: 6, 2: 6, 3: 6, 4: 1}
    assert level(matching.refine_by_land_source(rows, matches, centers, "id")) == {1: 7, 2: None, 3: 5, 4: 1}
    stored = rows.withColumns({"geocoded_address": F.lit(None).cast("string"), "updated_at": F.lit("2024-01-01").cast("timestamp")})
    assert matching.stale_locations(stored).count() == 4
    found = spark.createDataFrame([(1, "a", 5, 35.0, 139.0), (4, "other", 2, 1.0, 1.0), (2, "b", 3, 2.0, 2.0)], "id int, address string, level int, lat double, lon double")
    out = {r.id: r for r in matching.store_locations(stored, found, "id", "2024-06-01 00:00:00").collect()}
    assert out[1].geocoded_address == "a" and out[1].updated_at.year == 2024 and out[1].updated_at.month == 1
    assert out[2].latitude == 2.0 and out[2].updated_at.month == 6 and out[4].geocoded_address is None
    assert matching.reset_locations(matching.store_locations(stored, found, "id", "2024-06-01 00:00:00"), 7).filter("geocoded_address IS NULL").count() == 3
    kana = stored.withColumns({"medical_info_net_id": F.lit(None).cast("string"), "name_kana": F.lit("ア"), "website_url": F.lit(None).cast("string")})
    m = spark.createDataFrame([(1, "x", "ア", None), (2, "y", "イ", None)], "id int, match_id string, name_kana string, website_url string")
    done = {r.id: r for r in matching.assign_match(kana, m, "id", "2024-06-01 00:00:00").collect()}
    assert done[1].medical_info_net_id == "x" and done[1].updated_at.month == 1 and done[2].updated_at.month == 6


def test_stations(spark):
    prop = "properties struct<N02_003:string,N02_004:string,N02_005:string,N02_005c:string,N02_005g:string>, geometry struct<type:string,coordinates:array<array<double>>>"
    line = lambda *p: ("LineString", [list(map(float, q)) for q in p])
    rows = [(1, ("線", "社", "東京駅", "001", "001"), line((0, 0), (2, 0))), (2, ("線", "社", "東京駅", "001", "001"), line((0, 2), (2, 2))), (3, ("他線", "社", "東京", "002", "001"), line((1, 1))), (4, ("線", "社", "", "003", ""), line((1, 1))), (5, ("線", "社", "新東京", "004", ""), line((5, 5), (5, 5)))]
    points = matching.station_points(spark.createDataFrame(rows, f"ord int, {prop}"))
    got = {r.station_code: (r.group_code, r.latitude, r.longitude) for r in points.collect()}
    assert got == {"001": ("001", 1.0, 1.0), "002": ("001", 1.0, 1.0), "004": ("004", 5.0, 5.0)}
    placed = points.withColumns({"prefecture_code": F.lit("13"), "municipality_code": F.lit("13101")})
    one = matching.find_stations(placed, "東京駅").collect()
    assert [(r.name, len(r.lines)) for r in one] == [("東京駅", 1)]
    assert [r.name for r in matching.find_stations(placed, "新").collect()] == ["新東京"]
    assert matching.find_stations(placed, "東京", "01").count() == 0
    assert geo.SPEEDS["walk"] == 4800
    assert [r[0] for r in spark.createDataFrame([(1000.0,)], "m double").select(geo.travel_minutes(F.col("m"), "walk")).collect()] == [17]


def workbook(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>青</t></r><r><t>空</t></r><rPh><t>あお</t></rPh></si></sst>')
        for i, n in enumerate(names, 1):
            rows = "".join(f'<row r="{k}">' + "".join(f'<c r="{ref}" t="s"><v>0</v></c>' if v is None else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' for ref, v in cells) + "</row>" for k, cells in sheets[n])
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_and_bundles(spark):
    book = workbook({"北海道": [(1, [("A1", None), ("C1", "x")]), (3, [("B3", "y")])], "東京都": [(1, [("A1", "z")])]})
    bundle = io.BytesIO()
    with zipfile.ZipFile(bundle, "w") as z:
        z.writestr("in/book.xlsx", book)
    raw = spark.createDataFrame([("a.xlsx", bytearray(book)), ("b.zip", bytearray(bundle.getvalue()))], "path string, content binary")
    units = files.expand_bundles(raw)
    assert sorted((r.path, r.entry, r.sheet) for r in units.collect()) == [("a.xlsx", None, "北海道"), ("a.xlsx", None, "東京都"), ("b.zip", "in/book.xlsx", "北海道"), ("b.zip", "in/book.xlsx", "東京都")]
    coded = files.assign_prefecture(units, F.col("sheet"), fixed.PREFECTURES)
    assert {r.prefecture_code for r in coded.collect()} == {"01", "13"}
    with pytest.raises(Exception, match="unknown prefecture"):
        files.assign_prefecture(units.withColumn("sheet", F.lit("?")), F.col("sheet"), fixed.PREFECTURES).collect()
    rows = files.scan_workbooks(units.join(raw, "path").withColumn("unit", F.concat_ws("/", "path", "sheet")))
    got = {(r.unit, r.row_no): r.cells for r in rows.collect()}
    assert got[("a.xlsx/北海道", 1)] == ["青空", "", "x"] and got[("b.zip/北海道", 3)] == ["", "y"] and len(got) == 6


def test_zipped_files(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x.csv", "﻿a,b\r\n01,2\r\nbad\r\n3,\r\n")
        z.writestr("UTF-8/S_Station.geojson", json.dumps({"features": [{"properties": {"n": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    raw = spark.createDataFrame([("z", bytearray(data.getvalue()))], "path string, content binary")
    assert sorted((r.row_no, r.a, r.b) for r in files.scan_zip_csv(raw, ["a", "b"]).collect()) == [(1, "01", "2"), (3, "3", "")]
    schema = "properties struct<n:string>, geometry struct<type:string,coordinates:array<double>>"
    assert files.scan_zip_geojson(raw, "_Station.geojson", schema).head().geometry.coordinates == [1.0, 2.0]
    (tmp_path / "p.geojson").write_text(json.dumps({"features": [{"properties": {"P04_001": 1, "P04_002": "院", "P04_003": "東京都大島町1-2"}, "geometry": {"type": "Point", "coordinates": [139.0, 35.0]}}]}))
    land = files.scan_geojson(spark, str(tmp_path / "p.geojson"), "P04_001:int,P04_002:string,P04_003:string", "Point")
    names = matching.municipality_names(spark.createDataFrame([("13361", "13", "大島町")], "code string, prefecture_code string, name string"))
    r = matching.land_locations(land, names, F.lit("13")).head()
    assert (r.municipality_code, r.address_key, r.latitude) == ("13361", "1-2", 35.0)


def test_tables_with_headers(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes("国民の祝日,名称\r\n2026/1/1,元日\r\n2026/1/1,元日２\r\n2026/13/1,x\r\n".encode("cp932"))
    assert [tuple(r) for r in files.read_holidays(spark, str(tmp_path / "h.csv")).collect()] == [(D(2026, 1, 1), "元日２")]
    rows = [(1, ["団体コード", "都道府県", "市区町村", "人口", "", "", "世帯"]), (2, ["", "", "", "男", "女", "計", "計"]), (3, ["011002", "北海道", "札幌市", "1", "2", "1,953", "9"]), (4, ["010006", "北海道", "", "1", "1", "5", "9"]), (5, ["11011", "x", "y", "1", "1", "77", "9"])]
    cells = spark.createDataFrame(rows, "row_no int, cells array<string>")
    assert sorted(tuple(r) for r in files.scan_population(cells).collect()) == [("01100", 1953), ("01101", 77)]
    rx = spark.createDataFrame([(1, ["title"]), (2, ["都道府県", "区分", "コード", "開始日", "リフィル開始"]), (3, ["東京都", "医科", "12345", "46235", ""]), (4, ["東京都", "薬局", "1234567", "2026/8/2", "2026年9月1日"]), (5, ["?", "?", "", "x", ""]), (6, ["北海道", "医科", "7", "46235.5", "2026/8/3 00:00"])], "row_no int, cells array<string>")
    heads = {"prefecture": "都道府県", "category": "区分", "code": "コード", "started_on": "開始日", "refill_started_on": "リフィル"}
    scan = lambda rows: files.scan_e_prescriptions(rows, heads, fixed.PREFECTURES, {"医科": "1", "薬局": "4"})
    got = sorted(tuple(r) for r in scan(rx).collect())
    assert got == [("0110000007", D(2026, 8, 1), D(2026, 8, 3)), ("1310012345", D(2026, 8, 1), None), ("1341234567", D(2026, 8, 2), D(2026, 9, 1))]
    for cells, what in ((["?", "医科", "1", "46235", ""], "prefecture"), (["東京都", "?", "1", "46235", ""], "category"), (["東京都", "医科", "123456789", "46235", ""], "code"), (["東京都", "医科", "1", "soon", ""], "date"), (["東京都", "医科", "1", "", ""], "date"), (["東京都", "医科", "1", "46235", "x"], "date")):
        with pytest.raises(Exception, match=what):
            scan(rx.union(spark.createDataFrame([(9, cells)], rx.schema))).collect()
    with pytest.raises(Exception, match="header"):
        scan(rx.filter("row_no <> 2")).collect()
    with pytest.raises(Exception, match="population"):
        files.scan_population(cells_of := spark.createDataFrame([*rows, (6, ["11012", "x", "y", "1", "1", "n/a", "9"])], "row_no int, cells array<string>")).collect()
    with pytest.raises(Exception, match="population"):
        files.scan_population(cells_of.filter("row_no > 2")).collect()


def test_ledger(spark):
    schema = "id int, bureau_code int, category int, filename string, prefecture_codes array<string>, published_on date, imported_at timestamp, superseded_at timestamp"
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, 1, "old.zip", ["01"], D(2024, 2, 1), t, None), (2, 1, 1, "back.zip", ["02"], D(2024, 2, 1), t, t), (3, 1, 1, "stay.zip", ["03"], D(2024, 2, 1), t, None)]
    link = spark.createDataFrame([(1, 1, "new.zip", ["01"], D(2024, 2, 1)), (1, 1, "back.zip", ["02"], D(2024, 2, 1))], "bureau_code int, category int, filename string, prefecture_codes array<string>, published_on date")
    out = {r.id: r for r in ledger.supersede_replaced(spark.createDataFrame(rows, schema), link, "2024-03-01 00:00:00").collect()}
    assert out[1].superseded_at is not None and out[2].superseded_at is None and out[2].imported_at is None and out[3].superseded_at is None
    df = spark.createDataFrame(rows, schema)
    assert [r.filename for r in ledger.new_links(link, df).collect()] == ["new.zip"]
    assert ledger.due_sources(df, ["bureau_code", "category"]).count() == 0 and ledger.due_sources(df, ["bureau_code", "category"], True).count() == 1
    fresh = df.withColumn("imported_at", F.lit(None).cast("timestamp"))
    assert ledger.mark_imported(fresh, [1], 0, "2024-03-01 00:00:00").filter("imported_at IS NOT NULL").count() == 1
    assert ledger.mark_imported(fresh, [1], 2, "2024-03-01 00:00:00").filter("imported_at IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="fewer"):
        ledger.guard_min_rows(df, 4)
    assert ledger.newer_edition_only(df, df, "published_on").count() == 0 and ledger.newer_edition_only(df, df.limit(0), "published_on").count() == 3
    seed = spark.createDataFrame([("a", "1"), ("z", "9")], "k string, v string")
    upserted = ledger.load_seed(seed, spark.createDataFrame([("a", "2", 1), ("a", "3", 2), ("b", "4", 3)], "k string, v string, ord int"), ["k"])
    assert {r.k: r.v for r in upserted.collect()} == {"a": "3", "b": "4", "z": "9"}
    assert ledger.missing_categories(link, link.limit(0), ["category"]).count() == 1 and ledger.union_editions([seed, seed]).count() == 4


def test_links(spark):
    html = "<p>（令和８年９月１日現在）</p><table><tr><td>医科</td><td><a href='/f/ika.xlsx'>一覧</a></td></tr><tr><td>変更</td><td><a href='x.xlsx'>一覧</a></td></tr></table><table><tr><td>医科</td><td><a href='late.zip'>後</a></td></tr></table>"
    pages = spark.createDataFrame([("b", "https://e.example/a/index.html?x=1", html)], "bureau string, url string, html string")
    rules = spark.createDataFrame([("b", 1, None, "xlsx$", None, "医科", None, True), ("b", 2, "01", "zip$", None, None, "前", False)], "bureau string, category int, prefecture string, href_has string, text_has string, row_has string, unless string, first_table boolean")
    got = sorted((r.category, r.url, r.filename, r.published_on) for r in links.extract_links(pages, rules).collect())
    assert got == [(1, "https://e.example/f/ika.xlsx", "ika.xlsx", D(2026, 9, 1)), (2, "https://e.example/a/late.zip", "late.zip", D(2026, 9, 1))]


def facilities(spark):
    return spark.sql("""SELECT 1 AS id, '13' AS prefecture_code, 1 AS institution_type, '0000001' AS facility_code, 1 AS status, 1 AS bureau_code, '=院' AS name, 'イン' AS name_kana, '13101' AS municipality_code,
      '100-0001' AS postal_code, '千代田' AS address, CAST(35.1 AS decimal(10,6)) AS latitude, CAST(139.1 AS decimal(10,6)) AS longitude, 1 AS geocode_level, '03' AS phone_number, 'http://a.b' AS website_url,
      date'2024-01-01' AS designated_on, array(named_struct('reason', '新規', 'date', date'2024-01-01')) AS designation_history, map('一般', 3) AS bed_counts, array(1, 2) AS department_categories,
      date'2024-01-01' AS e_prescription_started_on, CAST(NULL AS date) AS e_prescription_refill_started_on, timestamp'2024-01-01' AS created_at, timestamp'2024-01-02' AS updated_at, 'x1' AS medical_info_net_id""")


def test_documents_and_export(spark, tmp_path):
    rows = facilities(spark)
    areas = spark.sql("SELECT '13101' AS code, '千代田区' AS name")
    doc = documents.facility_document(rows.withColumn("distance", F.lit(12.6)), areas).head()
    assert tuple(doc.bureau) == (1, "北海道厚生局") and tuple(doc.municipality) == ("13101", "千代田区") and doc.prefecture_code == "13"
    assert doc.location.level.label == "住居" and doc.distance == 13 and [c.label for c in doc.department_categories] == ["内科", "外科"] and "founder_name" not in doc
    assert documents.facility_document(rows.withColumn("geocode_level", F.lit(None).cast("int")), areas.limit(0)).head().location is None
    short = documents.facility_summary(rows).head()
    assert tuple(short) == (1, "=院", "病院", ["内科", "外科"], "東京都千代田", "03", "http://a.b", 35.1, 139.1)
    assert documents.facility_summary(rows.withColumn("geocode_level", F.lit(None).cast("int"))).head().latitude is None
    loc = spark.sql("SELECT 'x1' AS source_id, date'2024-01-01' AS published_on, 'c' AS closures")
    sched = spark.sql("SELECT 'x1' AS source_id, array('内科') AS departments, 's' AS slots")
    assert documents.opening_hours_document(rows, loc, sched).head().hours.schedules[0].departments == ["内科"]
    flat = export.csv_rows(rows, areas, {1: "局"})
    assert flat.columns == list(export.CSV_COLUMNS) and flat.head().name == "'=院" and flat.head().department_categories == "内科|外科"
    path = str(tmp_path / "set")
    export.export_bulk(rows, areas, {1: "局"}, path)
    manifest = export.export_manifest(spark, path, rows, {"prefectures": []})
    assert sorted((f["format"], f["prefecture"], f["records"]) for f in manifest["files"] if f["bytes"] > 100) == [("csv", "13", 1), ("csv_all", None, 1), ("jsonl", "13", 1), ("jsonl_all", None, 1)]
    root = str(tmp_path / "exports")
    sets = [export.export_set(rows, areas, {1: "局"}, root, {"n": n})["set"] for n in range(3)]
    assert export.current_manifest(spark, root)["set"] == sets[-1] and sorted(p.name for p in (tmp_path / "exports" / "sets").iterdir()) == sets[1:]
    assert export.current_manifest(spark, str(tmp_path / "none")) is None
    assert not export.should_export(rows, {"prefectures": []}, manifest) and export.should_export(rows, {"prefectures": ["13"]}, manifest)
    with pytest.raises(ValueError, match="kept"):
        export.should_export(rows.limit(0), {}, None)
    assert spark.read.parquet(export.replace_table(areas, str(tmp_path / "t"), 1)).count() == 1


def test_digests_hold_no_group(spark):
    lines = {1: [f"{i},é\r\n" for i in range(5000)], None: ["x", "y"], 2: ["only"]}
    rows = [(k, i, t) for k, v in lines.items() for i, t in enumerate(v)] + [(3, 0, None)]
    frame = spark.createDataFrame(rows[::-1], "k int, i int, line string").repartition(5)
    out = export.digests(frame, "k", "line", ["i"])
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {r.k: tuple(r)[1:] for r in out.collect()}
    data = {k: "".join(v).encode() for k, v in lines.items()} | {3: b""}
    assert got == {k: (len(lines.get(k, [0])), len(b), hashlib.sha256(b).hexdigest()) for k, b in data.items()}
    assert export.digests(frame.limit(0), "k", "line", ["i"]).count() == 0
    import __spark_entry__

    manifest = __spark_entry__.queries()["manifest"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in manifest._jdf.queryExecution().toString()


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda ts, status, uri: json.dumps({"ts": ts, "status": status, "request": {"remote_ip": "1", "uri": uri}})
    (log / "a.log").write_text("\n".join([line(1704034800.5, 200, "/.env?x"), line(1704034799.0, 404, "/"), "broken", line(1704400000.0, 200, "/")]))
    q = jobs.access_stream(jobs.read_access_stream(spark, str(log)), "1 hour").writeStream.outputMode("complete").format("memory").queryName("acc").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.start), r.status): (r.n, r.probes) for r in spark.table("acc").collect()}
    assert got[("2023-12-31 15:00:00", 200)] == (1, 1) and got[("2023-12-30 15:00:00", 404)] == (1, 0)
    batch = files.scan_access_log(spark, str(log), 1704034799.0, 1704034801.0)
    assert batch.count() == 2
    parts = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 1)], "edition string, part int")
    whole = jobs.complete_editions(parts, spark.createDataFrame([("e1", 2), ("e2", 2)], "edition string, parts int"), ["edition"])
    assert [r.edition for r in whole.collect()] == ["e1"]
    src = tmp_path / "ed"
    parts.write.parquet(str(src))
    seen = []
    s = jobs.snapshot_stream(spark.readStream.schema(parts.schema).parquet(str(src)), lambda df, i: seen.append((i, df.count())), str(tmp_path / "cp"))
    s.awaitTermination(60)
    assert sum(n for _, n in seen) == 3


def test_prefix_joins_are_no_cartesian_products(spark):
    names = spark.createDataFrame([("01", "札幌市", "x")], "prefecture_code string, name string, code string")
    rows = spark.createDataFrame([(1, "01", "札幌市1")], "id int, prefecture_code string, t string")
    plan = matching.longest_prefix(rows, names, ["prefecture_code"], "t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
