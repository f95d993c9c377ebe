"""Queries of facilities as they are served, and of weekly hours; facilities are customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import BUREAUS, CATEGORIES, EVENT_TYPES, LEVELS, ORIGINS, PREFECTURES, STATUSES, TYPES
from ..operators import documents, events, hours, search
from .base import query, rows_of, table


def facilities(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "lpad(CAST(c_nationkey + 1 AS STRING), 2, '0') AS prefecture_code", "CAST(c_custkey % 4 + 1 AS INT) AS institution_type",
        "lpad(CAST(c_custkey AS STRING), 7, '0') AS facility_code", "CAST(c_custkey % 3 + 1 AS INT) AS status", "CAST(c_custkey % 8 + 1 AS INT) AS bureau_code",
        "c_name AS name", "CAST(NULL AS STRING) AS name_kana", "CASE WHEN c_custkey % 5 > 0 THEN CAST(c_nationkey AS STRING) END AS municipality_code", "'100-0001' AS postal_code",
        "c_mktsegment AS address", "CAST(CASE WHEN c_custkey % 6 > 0 THEN 35 + c_custkey % 100 / 100 END AS DECIMAL(10,6)) AS latitude",
        "CAST(139 + c_custkey % 50 / 100 AS DECIMAL(10,6)) AS longitude", "CAST(CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 7 + 1 END AS INT) AS geocode_level",
        "CAST(c_custkey AS STRING) AS phone_number", "concat('http://a.example/', c_custkey) AS website_url", "date_add(DATE'2020-01-01', CAST(c_custkey % 365 AS INT)) AS designated_on",
        "array(named_struct('reason', c_mktsegment, 'date', DATE'2020-01-01')) AS designation_history", "map('general', c_nationkey) AS bed_counts",
        "array(CAST(c_custkey % 26 + 1 AS INT), CAST((c_custkey + 5) % 26 + 1 AS INT)) AS department_categories", "CASE WHEN c_custkey % 3 = 0 THEN DATE'2026-08-01' END AS e_prescription_started_on",
        "CAST(NULL AS DATE) AS e_prescription_refill_started_on", "TIMESTAMP'2024-01-01 00:00:00' AS created_at", "TIMESTAMP'2024-01-02 00:00:00' AS updated_at", "CAST(c_custkey % 500 AS STRING) AS medical_info_net_id",
    )


def municipalities(spark, sf_dir):
    return table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS STRING) AS code", "n_name AS name")


LABELS_SQL = f"""
WITH t AS (SELECT * FROM {rows_of(TYPES, "x")}), s AS (SELECT * FROM {rows_of(STATUSES, "x")}), b AS (SELECT * FROM {rows_of(BUREAUS, "x")}), p AS (SELECT * FROM {rows_of(PREFECTURES, "x")}),
l AS (SELECT * FROM {rows_of(LEVELS, "x")}), g AS (SELECT * FROM {rows_of(CATEGORIES, "x")}), e AS (SELECT * FROM {rows_of(EVENT_TYPES, "x")}), o AS (SELECT * FROM {rows_of(ORIGINS, "x")}),
f AS (SELECT *, lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS pref, c_custkey % 4 + 1 AS kind, c_custkey % 3 + 1 AS state, c_custkey % 8 + 1 AS bureau,
  CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 7 + 1 END AS level, c_custkey % 26 + 1 AS d1, (c_custkey + 5) % 26 + 1 AS d2 FROM customer)
"""


@query(LABELS_SQL + "SELECT c_custkey AS id, t.label AS type, s.label AS state, p.label AS prefecture FROM f JOIN t ON t.code = kind JOIN s ON s.code = state JOIN p ON p.code = pref")
def labels_of_codes(spark, sf_dir):
    named = documents.with_labels(facilities(spark, sf_dir), {"institution_type": TYPES, "status": STATUSES, "prefecture_code": PREFECTURES})
    return named.select("id", F.col("institution_type.label").alias("type"), F.col("status.label").alias("state"), F.col("prefecture_code.label").alias("prefecture"))


@query(LABELS_SQL + """
SELECT c_custkey AS id, pref || CASE kind WHEN 3 THEN '3' WHEN 4 THEN '4' ELSE '1' END || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS medical_institution_code, t.label AS type, s.label AS state, b.label AS bureau, pref AS prefecture_code,
  p.label AS prefecture, CASE WHEN c_custkey % 5 > 0 THEN n_name END AS municipality, l.label AS level, CASE WHEN l.label IS NOT NULL THEN 35 + c_custkey % 100 / 100.0 END AS latitude,
  g1.label || ',' || g2.label AS departments, CASE WHEN c_custkey % 3 = 0 THEN DATE '2026-08-01' END AS started_on
FROM f JOIN t ON t.code = kind JOIN s ON s.code = state JOIN b ON b.code = bureau JOIN p ON p.code = pref JOIN nation ON n_nationkey = c_nationkey LEFT JOIN l ON l.code = level JOIN g g1 ON g1.code = d1 JOIN g g2 ON g2.code = d2""")
def facility_documents(spark, sf_dir):
    served = documents.facility_document(facilities(spark, sf_dir), municipalities(spark, sf_dir))
    label = lambda c, n: F.col(f"{c}.label").alias(n)
    return served.select(
        "id", "medical_institution_code", label("institution_type", "type"), label("status", "state"), label("bureau", "bureau"), "prefecture_code", label("prefecture", "prefecture"), label("municipality", "municipality"),
        label("location.level", "level"), F.col("location.latitude").alias("latitude"), F.array_join(F.transform("department_categories", lambda c: c["label"]), ",").alias("departments"), F.col("e_prescription.started_on").alias("started_on"),
    )


@query(LABELS_SQL + """
SELECT c_custkey AS id, c_name AS name, t.label AS type, g1.label || ',' || g2.label AS departments, p.label || c_mktsegment AS address, CAST(c_custkey AS VARCHAR) AS phone_number, 'http://a.example/' || c_custkey AS website_url,
  CASE WHEN level IS NOT NULL THEN 35 + c_custkey % 100 / 100.0 END AS latitude, CASE WHEN level IS NOT NULL THEN 139 + c_custkey % 50 / 100.0 END AS longitude
FROM f JOIN t ON t.code = kind JOIN p ON p.code = pref JOIN g g1 ON g1.code = d1 JOIN g g2 ON g2.code = d2""")
def facility_summaries(spark, sf_dir):
    return documents.facility_summary(facilities(spark, sf_dir)).withColumn("departments", F.array_join("departments", ","))


@query(LABELS_SQL + """
, v AS (SELECT event_id, CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 1 END AS kind, event_id % 3 + 1 AS origin, user_id FROM events)
SELECT event_id AS id, e.label AS event_type, o.label AS origin, CASE WHEN kind = 1 THEN user_id % 2 = 0 END AS is_reopening,
  CASE WHEN kind = 3 THEN 'status,bureau,department_categories,zz' END AS attributes, CASE WHEN kind = 3 THEN s.label END AS old_state, CASE WHEN kind = 3 THEN b.label END AS new_bureau, CASE WHEN kind = 3 THEN g.label END AS department
FROM v JOIN e ON e.code = kind JOIN o ON o.code = origin JOIN s ON s.code = user_id % 3 + 1 JOIN b ON b.code = user_id % 8 + 1 JOIN g ON g.code = user_id % 26 + 1""")
def event_documents(spark, sf_dir):
    change = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    user = F.col("user_id")
    code = lambda n: (user % n + 1).cast("string")
    listed = F.concat(F.lit("["), code(26), F.lit("]"))
    payload = F.create_map(F.lit("zz"), change(F.lit("1"), F.lit("2")), F.lit("bureau_code"), change(F.lit("1"), code(8)), F.lit("founder_name"), change(F.lit("a"), F.lit("b")), F.lit("department_categories"), change(F.lit(None).cast("string"), listed), F.lit("status"), change(code(3), F.lit("1")))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 3).otherwise(1).alias("event_type"), (F.col("event_id") % 3 + 1).cast("int").alias("origin"),
        F.to_date("ts").alias("occurred_on"), F.col("ts").alias("created_at"), (user % 2 == 0).alias("is_reopening"), payload.alias("payload"),
    )
    served = events.event_document(rows)
    field = lambda i, side: F.get("changes", F.lit(i))[side]
    return served.select(
        "id", F.col("event_type.label").alias("event_type"), F.col("origin.label").alias("origin"), "is_reopening", F.array_join(F.transform("changes", lambda c: c["attribute"]), ",").alias("attributes"),
        F.get_json_object(field(0, "old"), "$.label").alias("old_state"), F.get_json_object(field(1, "new"), "$.label").alias("new_bureau"), F.get_json_object(field(2, "new"), "$[0].label").alias("department"),
    )


@query("""
WITH l AS (SELECT s_suppkey, 'closed ' || s_nationkey AS closures FROM supplier WHERE s_suppkey % 4 > 0),
d AS (SELECT l_suppkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT c_custkey AS id, closures, CAST(CASE WHEN l.s_suppkey IS NOT NULL THEN coalesce(n, 0) END AS INTEGER) AS schedules FROM customer LEFT JOIN l ON l.s_suppkey = c_custkey % 500 LEFT JOIN d ON d.l_suppkey = c_custkey % 500""")
def opening_hours_documents(spark, sf_dir):
    places = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 > 0").selectExpr("CAST(s_suppkey AS STRING) AS source_id", "DATE'2024-01-01' AS published_on", "concat('closed ', s_nationkey) AS closures")
    listed = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct().selectExpr("CAST(l_suppkey AS STRING) AS source_id", "array(CAST(l_linenumber AS STRING)) AS departments", "'s' AS slots")
    served = documents.opening_hours_document(facilities(spark, sf_dir), places, listed)
    return served.select("id", F.col("hours.closures").alias("closures"), F.when(F.col("hours").isNotNull(), F.size(F.coalesce("hours.schedules", F.array()))).alias("schedules"))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def designated_for(spark, sf_dir):
    return search.has_reason(facilities(spark, sf_dir), "BUILDING").select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0")
def e_prescribing(spark, sf_dir):
    return search.e_prescribes(facilities(spark, sf_dir), True).select("id")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS source_id, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS municipality_code, s_name || '院' AS name_key, s_suppkey || '-' || s_nationkey AS address_key,
  CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 THEN 35 + s_suppkey % 7 END AS latitude, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 THEN 139 + s_suppkey % 5 END AS longitude,
  CASE WHEN s_suppkey % 2 = 0 THEN 'ア' || s_suppkey END AS name_kana, CASE WHEN s_suppkey % 2 = 0 THEN 'http://www.s' || s_suppkey || '.example' END AS website_url, CASE WHEN s_suppkey % 4 = 0 THEN 'mon' ELSE '' END AS closed
FROM supplier WHERE s_suppkey % 11 > 0""")
def source_locations(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "CAST(CASE WHEN s_suppkey % 11 > 0 THEN s_suppkey END AS STRING) AS i", "concat('医療法人社団 青空会 ', s_name, '・院') AS n", "CAST(s_nationkey AS STRING) AS p", "CAST(s_suppkey % 1000 AS STRING) AS m",
        "concat(s_suppkey, '番地', s_nationkey, '号') AS a", "CAST(CASE WHEN s_suppkey % 3 > 0 THEN 35 + s_suppkey % 7 ELSE 0 END AS STRING) AS y", "CASE WHEN s_suppkey % 5 > 0 THEN CAST(139 + s_suppkey % 5 AS STRING) ELSE '0.0' END AS x",
        "CASE WHEN s_suppkey % 2 = 0 THEN concat('ｱ', s_suppkey, ' ') ELSE ' ' END AS k", "CASE WHEN s_suppkey % 2 = 0 THEN concat('www.s', s_suppkey, '.example') ELSE 'x' END AS w",
        "CASE WHEN s_suppkey % 4 = 0 THEN '0' ELSE '1' END AS d", "'1' AS h",
    )
    names = {"id": "i", "name": "n", "prefecture": "p", "municipality": "m", "address": "a", "latitude": "y", "longitude": "x", "kana": "k", "website": "w", "weekly_mon": "d", "holiday": "h"}
    found = hours.locations_from_source(rows, names, F.lit(1))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return found.select("source_id", "municipality_code", "name_key", "address_key", whole("latitude"), whole("longitude"), "name_kana", "website_url", F.array_join("closures.weekly", ",").alias("closed"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'mon' ELSE '' END AS weekly, CASE WHEN s_suppkey % 3 <> 0 THEN '' WHEN s_suppkey % 2 = 0 THEN '2tue' ELSE '1mon,2tue' END AS monthly,
  CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS holidays, CASE WHEN s_suppkey % 5 = 0 THEN 'a' || chr(10) || s_suppkey END AS other FROM supplier WHERE s_suppkey % 7 <> 0""")
def closures_listed(spark, sf_dir):
    flag = lambda e: F.when(F.expr("s_suppkey % 7 = 0"), "").otherwise(F.expr(e))
    third = flag("CASE WHEN s_suppkey % 3 = 0 THEN '0' ELSE '1' END")
    made = hours.closures(
        {"mon": flag("CASE WHEN s_suppkey % 2 = 0 THEN '0' ELSE '1' END"), "tue": flag("'1'")}, {(1, "mon"): third, (2, "tue"): third},
        flag("CASE s_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '' END"), flag("CASE WHEN s_suppkey % 5 = 0 THEN concat('a（改行）', s_suppkey) ELSE ' ' END"),
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", made.alias("c")).filter("c IS NOT NULL")
    monthly = F.array_join(F.transform("c.monthly", lambda m: F.concat(m["week"].cast("string"), m["day"])), ",")
    return rows.select("s_suppkey", F.array_join("c.weekly", ",").alias("weekly"), monthly.alias("monthly"), "c.holidays", "c.other")


@query("""
WITH k AS (SELECT s_suppkey, i FROM supplier, (SELECT unnest([1, 2, 3]) AS i))
SELECT s_suppkey, CAST(i AS INTEGER) AS day, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 480 ELSE 540 END AS INTEGER) AS opens, CAST(720 + s_suppkey % 60 AS INTEGER) AS closes FROM k WHERE i < 3
UNION ALL SELECT s_suppkey, 3, 540, CAST(720 + s_suppkey % 60 AS INTEGER) FROM k WHERE i = 3""")
def opening_windows(spark, sf_dir):
    days = F.explode(F.array(F.struct(F.lit("mon").alias("day"), F.lit(1).alias("i")), F.struct(F.lit("tue").alias("day"), F.lit(2).alias("i")), F.struct(F.lit("wed").alias("day"), F.lit(3).alias("i"))))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", days.alias("d")).select("s_suppkey", "d.*")
    closes = F.concat(F.lit("12:"), F.lpad((F.col("s_suppkey") % 60).cast("string"), 2, "0"))
    reception = (F.col("s_suppkey") % 2 == 0) & (F.col("i") < 3)
    entries = rows.select("s_suppkey", F.lit(1).alias("schedule"), "day", F.lit("09:00").alias("opens"), closes.alias("closes"), F.when(reception, "08:00").alias("reception_opens"), F.when(reception, closes).alias("reception_closes"))
    return hours.opening_windows(entries, ["s_suppkey"], "schedule")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def excluded(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_nationkey < 5").selectExpr("c_custkey AS o_custkey")
    return hours.exclude_ids(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


@query("""
WITH n AS (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS fresh FROM orders)
SELECT o_custkey, o_orderstatus, CAST(sum(fresh) AS BIGINT) AS runs FROM n GROUP BY ALL HAVING sum(fresh) > 1""")
def scattered_keys(spark, sf_dir):
    return hours.not_contiguous(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", ["o_custkey"])
