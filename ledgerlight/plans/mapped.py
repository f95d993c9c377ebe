"""Queries of sheet rows, texts and tables with headers: the cells are made of customers, orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import records
from ..sources import files
from .base import query, table

WIDE = ("".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F))))
DIGITS = "一二三四五六七八九"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 1 THEN CAST(o_orderdate AS DATE) END AS date FROM orders")
def era_dates(spark, sf_dir):
    day = F.concat(F.lit("平"), F.year("o_orderdate") - 1988, F.lit(". "), F.month("o_orderdate"), F.lit(". "), F.dayofmonth("o_orderdate"))
    cell = F.when(F.col("o_orderkey") % 7 == 0, "未定").when(F.col("o_orderkey") % 7 == 1, "平9. 2.30").otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.era_date(cell).alias("date"))


@query("SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_orderpriority, o_orderkey) AS name FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1")
def holidays_listed(spark, sf_dir):
    line = F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.concat_ws(",", F.date_format("o_orderdate", "yyyy/M/d"), "o_orderpriority"))
    return files.scan_holidays(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), line.alias("value")))


@query("""
WITH b AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey + 100000 AS VARCHAR) ELSE CAST(p_partkey % 90000 + 10000 AS VARCHAR) END AS c, p_size * 1000 + p_partkey AS population FROM part),
s AS (SELECT CASE WHEN length(c) = 5 THEN '0' || c ELSE c END AS six, population FROM b)
SELECT six[1:5] AS code, population FROM s WHERE length(six) = 6 AND six[3:5] <> '000'""")
def population_listed(spark, sf_dir):
    code = F.expr("CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 100000 ELSE p_partkey % 90000 + 10000 END AS STRING)")
    people = F.format_number(F.col("p_size") * 1000 + F.col("p_partkey"), 0)
    body = table(spark, sf_dir, "part").select((F.col("p_partkey") + 3).alias("row_no"), F.array(code, F.lit("x"), F.lit("y"), F.lit("1"), F.lit("2"), people, F.lit("9")).alias("cells"))
    head = [(1, ["団体コード", "都道府県", "市区町村", "人口", "", "", "世帯"]), (2, ["", "", "", "男", "女", "計", "計"])]
    return files.scan_population(spark.createDataFrame(head, "row_no long, cells array<string>").unionByName(body))


@query("""
SELECT lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE '4' END || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS code,
  DATE '1899-12-30' + CAST(46235 + s_suppkey % 300 AS INTEGER) AS started_on, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1899-12-30' + CAST(46300 + s_suppkey % 300 AS INTEGER) END AS refill_started_on
FROM supplier WHERE s_suppkey % 13 <> 0""")
def e_prescriptions_listed(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("n", (F.col("s_suppkey") % 300).cast("int"))
    day = lambda base: F.date_add(F.lit("1899-12-30").cast("date"), F.col("n") + base)
    start = F.when(F.col("s_suppkey") % 5 == 0, F.date_format(day(46235), "yyyy/M/d 00:00")).when(F.col("s_suppkey") % 3 == 0, F.concat((F.col("n") + 46235).cast("string"), F.lit(".5"))).otherwise((F.col("n") + 46235).cast("string"))
    refill = F.when(F.col("s_suppkey") % 4 == 0, F.date_format(day(46300), "yyyy-M-d")).otherwise("")
    code = F.when(F.col("s_suppkey") % 13 == 0, "").otherwise(F.col("s_suppkey").cast("string"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "medical, any").otherwise("pharmacy")
    body = rows.select((F.col("s_suppkey") + 3).alias("row_no"), F.array(F.concat(F.lit("NATION_"), "s_nationkey"), kind, code, start, refill).alias("cells"))
    head = spark.createDataFrame([(1, ["list"]), (2, ["area", "kind of office", "code", "since", "refills since"])], "row_no long, cells array<string>")
    heads = {"prefecture": "area", "category": "kind", "code": "code", "started_on": "since", "refill_started_on": "refills"}
    return files.scan_e_prescriptions(head.unionByName(body), heads, {f"{k + 1:02d}": f"NATION_{k}" for k in range(25)}, {"medical": "1", "pharmacy": "4"})


def sheet(spark, sf_dir, broken: bool = False):
    """Three rows of cells for each customer; units are thousands of customers."""
    rows = table(spark, sf_dir, "customer").withColumn("code", F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    cut = F.concat_ws(",", F.substring("code", 1, 2), F.substring("code", 3, 4), F.substring("code", 7, 1))
    address = F.concat(F.lit("〒060－0001"), "c_mktsegment", F.col("c_custkey").cast("string"))
    if broken:
        cut = F.when(F.col("c_custkey") % 10 == 0, "12").otherwise(cut)
        address = F.when(F.col("c_custkey") % 9 == 0, "nowhere").otherwise(address)
    number = lambda n: (F.col("c_custkey") % n).cast("string")
    blank = F.lit("")
    first = F.array(
        F.lit("1"), cut, F.concat("c_name", F.lit(chr(0xE061)), F.lit(chr(0xF000))), address, F.concat(F.lit("0"), number(100), F.lit("("), number(1000), F.lit(")1234")),
        F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("F"), number(77))), F.lit("A"), F.concat(F.lit("平"), F.col("c_custkey") % 20 + 2, F.lit(". 3. 1")),
        F.concat(F.lit("療養　　"), number(50)), F.when(F.col("c_custkey") % 2 == 0, "病院").otherwise("診療所"),
    )
    second = F.array(*[blank] * 7, F.lit("新規"), F.concat(F.lit("一般　 "), number(30), F.lit("　 一般"), number(7)), F.lit("現存"))
    third = F.array(*[blank] * 7, F.lit("令5. 4. 1"), F.lit("内　小児科"), F.when(F.col("c_custkey") % 5 == 0, "休止").otherwise(""))
    listed = rows.select(F.expr("CAST(c_custkey DIV 1000 AS STRING)").alias("unit"), "c_custkey", F.posexplode(F.array(first, second, third)).alias("at", "cells"))
    return listed.select("unit", (F.col("c_custkey") * 3 + F.col("at")).alias("row_no"), "cells")


def mapped(spark, sf_dir, broken: bool = False):
    return records.map_records(records.group_records(sheet(spark, sf_dir, broken)), F.lit(1))


CODE_SQL = "lpad(CAST(c_custkey AS VARCHAR), 7, '0')"


@query(f"""
SELECT {CODE_SQL} AS facility_code, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS institution_type, CAST(CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS status,
  c_name || '土〓' AS name, '060-0001' AS postal_code, c_mktsegment || c_custkey AS address, '0' || c_custkey % 100 || '-' || c_custkey % 1000 || '-1234' AS phone_number,
  CASE WHEN c_custkey % 2 = 1 THEN 'F' || c_custkey % 77 END AS founder_name, 'A' AS administrator_name FROM customer""")
def mapped_records(spark, sf_dir):
    good, _ = records.split_errors(mapped(spark, sf_dir))
    return good.select("facility_code", "institution_type", "status", "name", "postal_code", "address", "phone_number", "founder_name", "administrator_name")


@query(f"SELECT {CODE_SQL} AS facility_code, make_date(1990 + c_custkey % 20, 3, 1) AS designated_on, '新規' AS reason, DATE '2023-04-01' AS reason_date, 1 AS reasons FROM customer")
def mapped_designations(spark, sf_dir):
    h = F.col("designation_history")
    return mapped(spark, sf_dir).select("facility_code", "designated_on", h[0]["reason"].alias("reason"), h[0]["date"].alias("reason_date"), F.size(h).alias("reasons"))


@query(f"SELECT {CODE_SQL} AS facility_code, CAST(c_custkey % 50 AS INTEGER) AS care, CAST(c_custkey % 30 + c_custkey % 7 AS INTEGER) AS general, '1,3' AS departments FROM customer")
def mapped_beds(spark, sf_dir):
    beds = F.col("bed_counts")
    return mapped(spark, sf_dir).select("facility_code", beds["療養"].alias("care"), beds["一般"].alias("general"), F.array_join(F.transform("department_categories", lambda c: c.cast("string")), ",").alias("departments"))


@query("""
SELECT c_custkey * 3 AS row_no, CASE WHEN c_custkey % 90 = 0 THEN 'facility code; address' WHEN c_custkey % 10 = 0 THEN 'facility code' ELSE 'address' END AS error FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 9 = 0""")
def mapping_errors(spark, sf_dir):
    _, bad = records.split_errors(mapped(spark, sf_dir, broken=True), fail=False)
    return bad.select("row_no", F.col("_error").alias("error"))


@query("SELECT c_custkey, lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || CASE c_custkey % 4 WHEN 2 THEN '3' WHEN 3 THEN '4' ELSE '1' END || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS code FROM customer")
def institution_codes(spark, sf_dir):
    pad = lambda c, n: F.lpad(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), n, "0")
    code = records.institution_code(pad(F.col("c_nationkey") + 1, 2), F.col("c_custkey") % 4 + 1, pad("c_custkey", 7))
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"))


@query("SELECT c_custkey, upper(c_name) AS plain, c_custkey % 3 = 0 AS changed FROM customer")
def recomputed(spark, sf_dir):
    stored = F.when(F.col("c_custkey") % 3 == 0, "stale").otherwise(F.upper("c_name")).alias("plain")
    out = records.recompute_derived(table(spark, sf_dir, "customer").select("c_custkey", "c_name", stored), {"plain": F.upper("c_name")})
    return out.select("c_custkey", "plain", F.col("_changed").alias("changed"))


@query("""
SELECT c_custkey, c_name || '高' AS plain, c_custkey || '-' || c_nationkey || 'ビルー' AS address, c_mktsegment || c_custkey || 'ケ丘' AS station,
  c_custkey || '-' || c_nationkey || (c_custkey % 9 + 1) || '丁目ヶ' AS matching FROM customer""")
def normal_forms(spark, sf_dir):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    kanji = F.element_at(F.array(*[F.lit(c) for c in DIGITS]), (F.col("c_custkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.normalize_text(F.concat(F.translate("c_name", *WIDE), F.lit("髙"))).alias("plain"),
        text.normalize_address(F.concat(key, F.lit("ー"), nation, F.lit("ビルー"))).alias("address"),
        text.normalize_station(F.concat("c_mktsegment", F.lit("　"), key, F.lit(" ヶ丘"))).alias("station"),
        text.normalize_for_matching(F.concat(key, F.lit("‐"), nation, kanji, F.lit("丁目ケ"))).alias("matching"),
    )


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS normalized_sha256 FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("normalized_sha256"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '院' WHEN 1 THEN c_mktsegment || '皮膚科' ELSE '医療法人青空会' END AS name_key FROM customer")
def name_keys(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("医療法人社団 青空会 "), "c_name", F.lit("・院"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("(医)青空会 "), "c_mktsegment", F.lit("皮フ科"))).otherwise("医療法人青空会")
    return table(spark, sf_dir, "customer").select("c_custkey", text.name_key(name).alias("name_key"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE '札幌市北' || (c_nationkey + 1) || '条' || (c_nationkey + 1) || '-' || c_custkey || '-' || (c_custkey % 9 + 1) END AS address_key,
  CAST(c_custkey AS VARCHAR) AS first, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS second FROM customer""")
def address_keys(spark, sf_dir):
    key, nation = F.col("c_custkey").cast("string"), (F.col("c_nationkey") + 1).cast("string")
    whole = F.concat(F.lit("北海道札幌市大字北"), nation, F.lit("条"), nation, F.lit("丁目"), key, F.lit("番地の"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("号 ビル3F"))
    address = F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise(whole)
    house = F.concat(F.lit("00"), key, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("番地の0"), F.col("c_nationkey").cast("string"), F.lit("号"))).otherwise("番地 x"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.address_key(address).alias("address_key"), text.house_numbers(house).alias("n"))
    return rows.select("c_custkey", "address_key", "n.first", "n.second")


@query("""
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'http://' || regexp_replace(url, '^https?://', '') ELSE url END AS url,
  CASE WHEN page_id % 5 > 0 THEN 'アオ ' || page_id END AS reading FROM pages""")
def clean_urls(spark, sf_dir):
    bare = F.regexp_replace("url", "^https?://", "")
    shout = F.concat(F.upper(F.regexp_extract("url", "^https?", 0)), F.lit("://"), bare)
    url = F.when(F.col("page_id") % 7 == 0, "mailto:nobody").when(F.col("page_id") % 3 == 1, bare).when(F.col("page_id") % 3 == 2, shout).otherwise(F.col("url"))
    kana = F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.concat(F.lit("　ｱｵ　"), F.col("page_id").cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "pages").select("page_id", text.clean_url(url).alias("url"), text.kana_reading(kana).alias("reading"))
