"""Queries of places: municipalities, towns, positions, matches and stations, made of customers, parts, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from .base import query, scratch, table

AT = "2024-06-01 00:00:00"


@query("""
WITH f AS (SELECT CAST(c_nationkey AS VARCHAR) AS prefecture_code, CASE c_custkey % 3 WHEN 0 THEN '石郡' || c_mktsegment || c_custkey % 50 || '町' WHEN 1 THEN '京市' || c_mktsegment || c_custkey % 50 || '区' ELSE c_mktsegment || c_custkey % 50 || '町' END AS name, c_custkey AS code FROM customer),
s AS (SELECT prefecture_code, coalesce(nullif(regexp_extract(name, '^.+?郡(.+[町村])$', 1), ''), nullif(regexp_extract(name, '^.+?市(.+区)$', 1), '')) AS name, code FROM f),
u AS (SELECT prefecture_code, name, min(code) AS code FROM s WHERE name IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
SELECT * FROM f UNION ALL SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.prefecture_code = u.prefecture_code AND f.name = u.name)""")
def municipality_names(spark, sf_dir):
    own = F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("石郡"), own, F.lit("町"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("京市"), own, F.lit("区"))).otherwise(F.concat(own, F.lit("町")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("prefecture_code"), name.alias("name"), F.col("c_custkey").alias("code"))
    return matching.municipality_names(rows)


@query("""
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS municipality_code, c_custkey || '-1' AS remainder FROM customer WHERE c_custkey % 9 <> 0
UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 9 = 0""")
def resolved_municipalities(spark, sf_dir):
    names = table(spark, sf_dir, "nation").selectExpr("'13' AS prefecture_code", "concat(n_name, '市') AS name", "CAST(n_nationkey AS STRING) AS code")
    inner = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit("市"), F.col("c_custkey").cast("string"), F.lit("-1"))
    address = F.when(F.col("c_custkey") % 9 == 0, "どこか").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("東京都"), inner)).when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("大島"), inner)).otherwise(inner)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("13").alias("prefecture_code"), address.alias("address"))
    return matching.resolve_municipality(rows, names, ["c_custkey"]).select("c_custkey", "municipality_code", "remainder")


@query("""
SELECT c_custkey, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS machiaza_id, p_partkey % 2 = 0 AS residential, CASE WHEN p_partkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '1-' || c_nationkey END AS rest
FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 10 <> 7""")
def matched_towns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    town = F.concat(F.lit("町名"), F.col("p_partkey").cast("string"), F.lit("町"))
    block = lambda v: F.when(F.col("p_partkey") % 2 == 0, v).otherwise("")
    towns = part.select(
        (F.col("p_size") % 10).cast("string").alias("lg_code"), F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("machiaza_id"), F.concat(F.lit("大字"), town).alias("oaza_cho"), block("一丁目").alias("chome"),
        block("1").alias("chome_number"), F.lit("").alias("koaza"), F.when(F.col("p_partkey") % 2 == 0, "1").otherwise("0").alias("rsdt_addr_flg"), F.lit("").alias("ablt_date"), F.col("p_partkey").alias("ord"),
    )
    rest = F.concat(F.when(F.col("c_custkey") % 10 == 7, F.lit("無い")).otherwise(F.when(F.col("c_custkey") % 10 == 3, F.lit("大字")).otherwise("")), town, F.lit("1-"), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").join(part, F.col("c_custkey") == F.col("p_partkey")).select("c_custkey", (F.col("p_size") % 10).cast("string").alias("lg_code"), rest.alias("remainder"))
    path = scratch(spark, "spellings")  # they are made once, for all rows that ask
    matching.town_spellings(towns).write.parquet(path)
    return matching.match_town(rows, spark.read.parquet(path), ["c_custkey"]).select("c_custkey", "machiaza_id", "residential", "rest")


@query("""
WITH k AS (SELECT c_custkey AS k, c_custkey % 4 AS kind, CASE WHEN c_custkey % 10 = 9 THEN 'town' WHEN c_custkey % 4 = 0 THEN 'home' WHEN c_custkey % 4 = 1 THEN 'block' WHEN c_custkey % 4 = 2 THEN 'parcel' ELSE 'base' END AS found FROM customer),
l AS (SELECT *, CASE found WHEN 'home' THEN 1 WHEN 'block' THEN 2 WHEN 'parcel' THEN 3 WHEN 'base' THEN 4 WHEN 'town' THEN 5 END AS level, CASE WHEN found = 'town' AND k % 8 = 7 THEN k // 1000 * 1000 ELSE k END AS of FROM k)
SELECT k AS c_custkey, CAST(level AS INTEGER) AS level, CAST(of % 90 + level / 10.0 AS DOUBLE) AS lat, CAST(of % 180 AS DOUBLE) AS lon FROM l""")
def geocoded(spark, sf_dir):
    base = table(spark, sf_dir, "customer").withColumn("machiaza_id", F.lpad(F.col("c_custkey").cast("string"), 7, "0")).withColumns({"lg_code": F.lit("1"), "ablt_date": F.lit("")})
    one, two = F.col("c_custkey") % 5 + 1, F.col("c_custkey") % 3 + 1
    kind = F.col("c_custkey") % 4
    at = lambda rows, level: rows.withColumns({"rep_lat": F.concat((F.col("c_custkey") % 90).cast("string"), F.lit(f".{level}")), "rep_lon": (F.col("c_custkey") % 180).cast("string"), "ord": F.col("c_custkey")})
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    homes = at(base.filter(kind == 0), 1).withColumns({"blk_num": pad(one), "rsdt_num": pad(two), "rsdt2_id": F.lit("")})
    blocks = at(base.filter(kind < 2), 2).withColumns({"blk_num": pad(one)})
    parcels = base.filter(kind > 1).withColumns({"prc_id": F.lit("a"), "prc_num1": pad(one), "prc_num2": pad(F.when(kind == 2, two).otherwise(two + 1))})
    spots = at(base.filter(kind == 2), 3).unionByName(at(base.filter(kind == 3), 4)).withColumn("prc_id", F.lit("a"))
    registry = {"residences": homes, "blocks": blocks, "parcels": matching.parcel_positions(parcels, spots), "towns": at(base.filter("c_custkey % 8 <> 7"), 5)}
    rest = F.when(F.col("c_custkey") % 10 == 9, "x").otherwise(F.concat_ws("-", one.cast("string"), two.cast("string")))
    targets = base.select("c_custkey", "lg_code", "machiaza_id", (kind < 2).alias("residential"), (kind > 1).alias("parcel"), rest.alias("rest"))
    return matching.geocode(targets, registry, ["c_custkey"])


@query("""
WITH p AS (SELECT o_orderstatus AS lg_code, CAST(o_custkey AS VARCHAR) AS machiaza_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS prc_id, CAST(o_orderkey % 3 AS VARCHAR) AS first, o_orderkey % 90 AS lat FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 11 > 0)
SELECT lg_code, machiaza_id, first, CAST(arg_min(lat, prc_id) AS DOUBLE) AS lat FROM p GROUP BY ALL""")
def parcel_bases(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderstatus AS lg_code", "CAST(o_custkey AS STRING) AS machiaza_id", "lpad(CAST(o_orderkey AS STRING), 12, '0') AS prc_id", "concat('0', o_orderkey % 3) AS prc_num1", "CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS STRING) ELSE '' END AS prc_num2",
        "CASE WHEN o_orderkey % 5 > 0 THEN '' ELSE '2020-01-01' END AS ablt_date", "CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey % 90 AS STRING) ELSE '' END AS rep_lat", "'1' AS rep_lon", "o_orderkey AS ord",
    )
    positions = rows.select("lg_code", "machiaza_id", "prc_id", "rep_lat", "rep_lon", "ord")
    based = matching.parcel_base(matching.parcel_positions(rows.drop("rep_lat", "rep_lon", "ord"), positions))
    return based.select("lg_code", "machiaza_id", "first", F.col("p.lat").alias("lat"))


METRES = "2 * 6371000 * asin(sqrt(least(1.0, power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2))))"
REFINE_SQL = f"""
WITH r AS (SELECT c_custkey AS id, c_custkey % 4 + 1 AS kind, c_nationkey AS area, c_mktsegment AS street, CASE WHEN c_custkey % 6 > 0 THEN 35 + c_custkey * 37 % 1000 / 2000.0 END AS y, CASE WHEN c_custkey % 6 > 0 THEN 139 + c_custkey * 91 % 1000 / 2000.0 END AS x,
  CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 7 + 1 END AS level, 35 + c_custkey * 37 % 1000 / 2000.0 + c_custkey % 9 / 100.0 AS my, 139 + c_custkey * 91 % 1000 / 2000.0 AS mx, CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE c_mktsegment END AS mstreet, c_custkey % 2 = 0 AS matched FROM customer),
d AS (SELECT *, CASE WHEN y IS NOT NULL THEN {METRES.format(a="my", b="y", c="mx", d="x")} END AS town, CASE WHEN area < 20 THEN {METRES.format(a="my", b="35.25", c="mx", d="139.25")} END AS centre FROM r)
"""


def refining(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CAST(c_custkey % 4 + 1 AS INT) AS institution_type", "c_nationkey AS municipality_code", "c_mktsegment AS address_key", "CASE WHEN c_custkey % 6 > 0 THEN 35 + c_custkey * 37 % 1000 / 2000.0D END AS latitude",
        "CASE WHEN c_custkey % 6 > 0 THEN 139 + c_custkey * 91 % 1000 / 2000.0D END AS longitude", "CAST(CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 7 + 1 END AS INT) AS geocode_level",
    )
    matches = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "35 + c_custkey * 37 % 1000 / 2000.0D + c_custkey % 9 / 100.0D AS lat", "139 + c_custkey * 91 % 1000 / 2000.0D AS lon", "CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE c_mktsegment END AS address_key")
    centers = table(spark, sf_dir, "nation").filter("n_nationkey < 20").selectExpr("n_nationkey AS municipality_code", "35.25D AS lat", "139.25D AS lon")
    return rows, matches, centers


@query(REFINE_SQL + """
SELECT id, CAST(CASE WHEN take THEN 6 ELSE level END AS INTEGER) AS geocode_level, round(CASE WHEN take THEN my ELSE y END, 6) AS latitude
FROM (SELECT *, matched AND (level IS NULL OR level = 5) AND coalesce(CASE WHEN y IS NOT NULL THEN town <= 2000 ELSE centre <= 30000 END, false) AS take FROM d)""")
def refined_by_hours(spark, sf_dir):
    return matching.refine_by_hours_source(*refining(spark, sf_dir), "id").select("id", "geocode_level", F.round("latitude", 6).alias("latitude"))


@query(REFINE_SQL + """
SELECT id, CAST(CASE WHEN take THEN 7 ELSE level END AS INTEGER) AS geocode_level, round(CASE WHEN take THEN my ELSE y END, 6) AS latitude
FROM (SELECT *, matched AND kind <> 4 AND street = mstreet AND (level IS NULL OR level = 5) AND coalesce(CASE WHEN y IS NOT NULL THEN town <= 10000 ELSE centre <= 30000 END, false) AS take FROM d)""")
def refined_by_land(spark, sf_dir):
    return matching.refine_by_land_source(*refining(spark, sf_dir), "id").select("id", "geocode_level", F.round("latitude", 6).alias("latitude"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey END AS medical_info_net_id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name_kana, CASE WHEN c_custkey % 6 = 0 THEN 'w' END AS website_url,
  CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 2 = 0 ELSE NOT (c_custkey % 2 = 0 AND c_custkey % 6 = 0) END AS moved FROM customer""")
def assigned_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "'x' AS medical_info_net_id", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name_kana", "CASE WHEN c_custkey % 2 = 0 THEN 'w' END AS website_url", "TIMESTAMP'2024-01-01 00:00:00' AS updated_at")
    matches = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey AS id", "concat('m', c_custkey) AS match_id", "c_name AS name_kana", "CASE WHEN c_custkey % 6 = 0 THEN 'w' END AS website_url")
    out = matching.assign_match(rows, matches, "id", AT)
    return out.select("id", "medical_info_net_id", "name_kana", "website_url", (F.col("updated_at") == F.lit(AT).cast("timestamp")).alias("moved"))


def located(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_mktsegment AS address", "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'old' ELSE c_mktsegment END AS geocoded_address", "CAST(35.5 AS DECIMAL(10,6)) AS latitude", "CAST(139.5 AS DECIMAL(10,6)) AS longitude",
        "CAST(c_custkey % 7 + 1 AS INT) AS geocode_level", "TIMESTAMP'2024-01-01 00:00:00' AS updated_at",
    )


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def stale_locations(spark, sf_dir):
    return matching.stale_locations(located(spark, sf_dir)).select("id")


@query("""
WITH s AS (SELECT c_custkey AS id, c_custkey % 3 = 0 AND c_custkey % 4 > 0 AS here, c_custkey % 7 + 1 AS level, CASE WHEN c_custkey % 2 = 0 THEN 35.5 ELSE 36.0 END AS lat, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'old' ELSE c_mktsegment END AS before, c_mktsegment FROM customer)
SELECT id, CAST(CASE WHEN here THEN 2 ELSE level END AS INTEGER) AS geocode_level, CAST(CASE WHEN here THEN lat ELSE 35.5 END AS DOUBLE) AS latitude, CASE WHEN here THEN c_mktsegment ELSE before END AS geocoded_address, here AND (lat <> 35.5 OR level <> 2) AS moved FROM s""")
def stored_locations(spark, sf_dir):
    found = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE 'elsewhere' END AS address", "2 AS level", "CASE WHEN c_custkey % 2 = 0 THEN 35.5D ELSE 36.0D END AS lat", "139.5D AS lon")
    out = matching.store_locations(located(spark, sf_dir), found, "id", AT)
    return out.select("id", "geocode_level", F.col("latitude").cast("double").alias("latitude"), "geocoded_address", (F.col("updated_at") == F.lit(AT).cast("timestamp")).alias("moved"))


@query("SELECT s_name AS name, CAST(s_nationkey AS VARCHAR) AS municipality_code, s_suppkey || '-2' AS address_key, CAST(35 + s_suppkey % 7 AS DOUBLE) AS latitude, CAST(s_suppkey % 3 + 1 AS INTEGER) AS institution_type FROM supplier WHERE s_suppkey % 9 > 0")
def land_locations(spark, sf_dir):
    names = table(spark, sf_dir, "nation").selectExpr("'13' AS prefecture_code", "concat(n_name, '市') AS name", "CAST(n_nationkey AS STRING) AS code")
    address = F.when(F.col("s_suppkey") % 9 == 0, "どこか").otherwise(F.concat(F.lit("東京都NATION_"), F.col("s_nationkey").cast("string"), F.lit("市"), F.col("s_suppkey").cast("string"), F.lit("番地2号")))
    properties = F.struct((F.col("s_suppkey") % 3 + 1).alias("P04_001"), F.col("s_name").alias("P04_002"), address.alias("P04_003"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.lit(139.0), (35 + F.col("s_suppkey") % 7).cast("double")).alias("coordinates"))
    features = table(spark, sf_dir, "supplier").select(properties.alias("properties"), geometry.alias("geometry"))
    return matching.land_locations(features, names, F.lit("13")).select("name", "municipality_code", "address_key", "latitude", "institution_type")


@query("""
WITH r AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS station_code, o_custkey, o_orderkey % 100 + 1 AS x, o_orderkey % 50 AS y FROM orders WHERE o_custkey % 10 > 0)
SELECT station_code, CASE WHEN o_custkey % 2 = 0 THEN station_code ELSE 'g' || o_custkey END AS group_code, 'S ヶ' || o_custkey AS name, 'Sケ' || o_custkey AS name_normalized, 'line ' || arg_min(o_orderkey % 7, o_orderkey) AS line_name,
  round(avg(y), 6) AS latitude, round(avg(x), 6) AS longitude FROM r GROUP BY station_code, o_custkey""")
def station_points(spark, sf_dir):
    name = F.when(F.col("o_custkey") % 10 > 0, F.concat(F.lit("S ヶ"), F.col("o_custkey").cast("string"))).otherwise("")
    properties = F.struct(
        F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("N02_005c"), name.alias("N02_005"), F.concat(F.lit("line "), (F.col("o_orderkey") % 7).cast("string")).alias("N02_003"), F.lit("op").alias("N02_004"),
        F.when(F.col("o_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("g"), F.col("o_custkey").cast("string"))).alias("N02_005g"),
    )
    x, y = (F.col("o_orderkey") % 100).cast("double"), (F.col("o_orderkey") % 50).cast("double")
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(F.array(x, y), F.array(x + 2, y)).alias("coordinates"))
    features = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), properties.alias("properties"), geometry.alias("geometry"))
    return matching.station_points(features).select("station_code", "group_code", "name", "name_normalized", "line_name", "latitude", "longitude")


STATIONS_SQL = """
WITH s AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS station_code, c_custkey // 3 AS group_code, 'S' || c_custkey // 5 AS name, c_nationkey, CAST(c_custkey % 50 AS DOUBLE) AS y, 'op/' || c_mktsegment AS line FROM customer)
"""
GROUPS_SQL = "SELECT group_code, arg_min(name, station_code) AS name, arg_min(c_nationkey, station_code) AS municipality_code, round(avg(y), 6) AS latitude, string_agg(line, ',' ORDER BY station_code) AS lines FROM {rows} GROUP BY group_code"


def stations(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "lpad(CAST(c_custkey AS STRING), 9, '0') AS station_code", "c_custkey DIV 3 AS group_code", "concat('S', c_custkey DIV 5) AS name", "concat('S', c_custkey DIV 5) AS name_normalized", "'13' AS prefecture_code", "c_nationkey AS municipality_code",
        "CAST(c_custkey % 50 AS DOUBLE) AS latitude", "1.0D AS longitude", "'op' AS operator_name", "c_mktsegment AS line_name",
    )


def _flat(groups):
    lines = F.array_join(F.transform("lines", lambda x: F.concat_ws("/", x["operator"], x["line"])), ",")
    return groups.select("group_code", "name", "municipality_code", "latitude", lines.alias("lines"))


@query(STATIONS_SQL + GROUPS_SQL.format(rows="s"))
def station_groups(spark, sf_dir):
    return _flat(matching.station_groups(stations(spark, sf_dir)))


@query(STATIONS_SQL + GROUPS_SQL.format(rows="s WHERE name = 'S10'"))
def stations_found(spark, sf_dir):
    return _flat(matching.find_stations(stations(spark, sf_dir), "S １０駅"))
