"""The operators bound to the driver's tables, each beside its DuckDB SQL.

The driver's tables hold no facilities, so keys, dates and texts of orders,
customers, events, pages and so on stand in for them; every query reads its
whole tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import access_log, events, export, hours, matching, records, search, snapshot, stats, versions
from ..sources import ledger, links
from ..streaming import jobs
from .base import QUERIES, SQL, query, scratch, table

__all__ = ["QUERIES", "SQL"]


# ---- statistics


@query("""
WITH spine AS (SELECT strftime(m, '%Y-%m') AS month FROM generate_series(DATE '1995-01-01', DATE '1999-12-01', INTERVAL 1 MONTH) t(m)),
n AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT spine.month, CAST(coalesce(n, 0) AS BIGINT) AS count FROM spine LEFT JOIN n ON spine.month = n.month
""")
def stats_month(spark, sf_dir):
    rows = search.filter_facilities(table(spark, sf_dir, "orders"), o_orderstatus="F")
    return stats.count_by_month(rows, "o_orderdate", "1995-01", "1999-12")


@query("""
WITH c AS (SELECT c_nationkey AS code, count(*) AS count FROM customer GROUP BY 1),
p AS (SELECT s_nationkey AS code, count(*) AS population FROM supplier GROUP BY 1)
SELECT c.code, n_name AS name, count, population, round(count * 10000 / population, 2) AS per_10000
FROM c LEFT JOIN nation ON n_nationkey = c.code LEFT JOIN p ON p.code = c.code
""")
def stats_area(spark, sf_dir):
    areas = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS code", "n_name AS name")
    people = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("code")).agg(F.count("*").alias("population"))
    return stats.count_by_area(table(spark, sf_dir, "customer"), "c_nationkey", areas, people)


@query("SELECT category, count(*) AS count FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS category FROM part) GROUP BY 1")
def stats_category(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("categories"))
    return stats.count_by_category(rows, "categories")


@query("SELECT count(*) AS total, max(o_orderdate) AS population_as_of FROM orders")
def stats_total(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return stats.totals(orders, orders.select(F.col("o_orderdate").alias("as_of")))


@query("""
WITH spine AS (SELECT strftime(m, '%Y-%m') AS month FROM generate_series(DATE '2023-11-01', DATE '2024-03-01', INTERVAL 1 MONTH) t(m)),
n AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT spine.month, CAST(coalesce(n, 0) AS BIGINT) AS count FROM spine LEFT JOIN n ON spine.month = n.month
""")
def event_stats_month(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("occurred_on", F.col("ts"))
    return stats.events_by_month(rows, "2023-11", "2024-03")


@query("""
SELECT c_nationkey AS code, count(*) AS count, n_name AS name
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL
""")
def event_stats_area(spark, sf_dir):
    placed = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_nationkey AS municipality_code")
    areas = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS code", "n_name AS name")
    return stats.events_by_area(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id"), placed, ["id"], areas)


@query("""
SELECT l AS level, CAST(coalesce(n, 0) AS BIGINT) AS count FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, NULL]) AS l)
LEFT JOIN (SELECT CASE WHEN l_linenumber < 7 THEN l_linenumber END AS found, count(*) AS n FROM lineitem GROUP BY 1) ON l IS NOT DISTINCT FROM found
""")
def level_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("level", F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")))
    return stats.level_report(rows, "level", [1, 2, 3, 4, 5, 6, 7])


# ---- snapshot comparison: edition A lacks every tenth order, B others, and some priorities changed

# Edition B also holds every fourth order twice; the later row counts.
LAYOUT = snapshot.Layout(key=("o_orderkey",), attributes=("o_orderpriority", "o_totalprice"), order="row_no", described=("o_orderpriority",))
SCOPED = replace(LAYOUT, key=(*LAYOUT.completeness, "o_orderkey"))
SEEN = "2024-02-01 00:00:00"
EDITIONS_SQL = """
WITH base AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus AS institution_type, CAST(o_custkey % 5 AS VARCHAR) AS prefecture_code FROM orders),
a AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS status FROM base WHERE o_orderkey % 10 <> 0),
b AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority), 1 AS status FROM base
      WHERE o_orderkey % 10 <> 1 AND NOT (institution_type = 'P' AND prefecture_code = '3')),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NULL AS fresh, b.o_orderkey IS NULL AS missing, a.status AS old_status,
      a.o_orderpriority AS old_p, b.o_orderpriority AS new_p, coalesce(a.institution_type, b.institution_type) AS institution_type,
      coalesce(a.prefecture_code, b.prefecture_code) AS prefecture_code, (a.status <> b.status) AS moved
      FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
c AS (SELECT *, CASE WHEN missing THEN 'missing' WHEN fresh THEN 'created' WHEN old_status = 2 THEN 'reopened' WHEN old_p <> new_p OR moved THEN 'updated' ELSE 'unchanged' END AS outcome FROM j)
"""


def editions(spark, sf_dir):
    base = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus AS institution_type", "CAST(o_custkey % 5 AS STRING) AS prefecture_code")
    a = base.filter("o_orderkey % 10 <> 0").withColumn("status", F.when(F.col("o_orderkey") % 11 == 0, 2).otherwise(1))
    b = base.filter("o_orderkey % 10 <> 1 AND NOT (institution_type = 'P' AND prefecture_code = '3')").withColumn("status", F.lit(1))
    b = b.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "changed").otherwise(F.col("o_orderpriority"))).withColumn("row_no", F.lit(2))
    b = b.unionByName(b.filter("o_orderkey % 4 = 0").withColumns({"o_orderpriority": F.lit("earlier"), "row_no": F.lit(1)}))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    master = a.withColumns({"last_seen_download": F.lit(1).cast("long"), "created_at": at, "updated_at": at})
    return master, b


@query(EDITIONS_SQL + "SELECT outcome, count(*) AS n FROM c GROUP BY 1")
def snapshot_counters(spark, sf_dir):
    return snapshot.run_counters(snapshot.compare(*editions(spark, sf_dir), LAYOUT))


@query(EDITIONS_SQL + """
SELECT o_orderkey, outcome, CASE WHEN outcome IN ('updated', 'reopened', 'unchanged') AND old_p <> new_p THEN old_p END AS old_priority,
CASE WHEN outcome IN ('updated', 'reopened', 'unchanged') AND old_p <> new_p THEN new_p END AS new_priority FROM c""")
def snapshot_diff(spark, sf_dir):
    compared = snapshot.compare(*editions(spark, sf_dir), LAYOUT)
    change = F.col("changes")["o_orderpriority"]
    return compared.select("o_orderkey", "outcome", change["old"].alias("old_priority"), change["new"].alias("new_priority"))


@query(EDITIONS_SQL + """
SELECT o_orderkey, CASE WHEN outcome = 'updated' THEN 3 ELSE 1 END AS event_type, 2 AS origin, CASE WHEN outcome <> 'updated' OR old_p <> new_p THEN 'o_orderpriority' ELSE 'status' END AS attributes,
CASE WHEN outcome = 'updated' AND old_p <> new_p THEN old_p END AS old_value, CASE WHEN outcome <> 'updated' OR old_p <> new_p THEN new_p END AS new_value
FROM c WHERE outcome IN ('created', 'reopened', 'updated')""")
def snapshot_events(spark, sf_dir):
    master, incoming = editions(spark, sf_dir)
    _, logged = snapshot.apply_snapshot(master, incoming, 2, "2024-02-01", SEEN, LAYOUT)
    told = F.col("payload")["o_orderpriority"]
    return logged.select("o_orderkey", "event_type", "origin", F.array_join(F.map_keys("payload"), ",").alias("attributes"), told["old"].alias("old_value"), told["new"].alias("new_value"))


@query(EDITIONS_SQL + """
SELECT o_orderkey, 2 AS origin, old_p AS old_value FROM c WHERE missing AND old_status <> 2 AND NOT (institution_type = 'P' AND prefecture_code = '3')""")
def snapshot_closures(spark, sf_dir):
    master, incoming = editions(spark, sf_dir)
    after, _ = snapshot.apply_snapshot(master, incoming, 2, "2024-02-01", SEEN, LAYOUT)
    _, closed = snapshot.reconcile_closures(after, incoming, 2, "2024-02-01", SEEN, LAYOUT)
    return closed.select("o_orderkey", "origin", F.col("payload")["o_orderpriority"]["old"].alias("old_value"))


MASTER_SQL = """
SELECT o_orderkey, CASE WHEN missing AND NOT (institution_type = 'P' AND prefecture_code = '3') THEN 2 WHEN missing THEN old_status ELSE 1 END AS status,
CASE WHEN missing THEN old_p ELSE new_p END AS o_orderpriority, CAST(CASE WHEN missing THEN 1 ELSE 2 END AS BIGINT) AS last_seen_download FROM c"""


def master_of(spark, sf_dir):
    """The first edition as a master by scope, with the second edition."""
    first, incoming = editions(spark, sf_dir)
    master = versions.Master(spark, scratch(spark, "master"), SCOPED, first.schema)
    master.create(first)
    return master, incoming


@query(EDITIONS_SQL + MASTER_SQL)
def snapshot_master(spark, sf_dir):
    """The edition meets only the scopes that it is about; the others stay as they were written."""
    master, incoming = master_of(spark, sf_dir)
    master.apply(1, incoming, 2, "2024-02-01", SEEN)
    return master.read().select("o_orderkey", "status", "o_orderpriority", "last_seen_download")


@query(EDITIONS_SQL + MASTER_SQL)
def snapshot_streamed(spark, sf_dir):
    """The edition arrives as a stream, half of it before and half after the job was stopped and started again."""
    master, incoming = master_of(spark, sf_dir)
    parts = incoming.withColumns({"download_id": F.lit(2).cast("long"), "published_on": F.lit("2024-02-01").cast("date"), "part": (F.col("o_orderkey") % 2).cast("int")})
    expected = spark.sql("SELECT CAST(2 AS long) AS download_id, 2 AS parts")
    for part in (0, 1):
        parts.filter(F.col("part") == part).write.mode("append").parquet(f"{master.root}/inbox")
        stream = spark.readStream.schema(parts.schema).parquet(f"{master.root}/inbox")
        jobs.run_snapshots(stream, expected, master, SEEN, f"{master.root}/checkpoint").awaitTermination()
    return master.read().select("o_orderkey", "status", "o_orderpriority", "last_seen_download")


@query(EDITIONS_SQL + "SELECT o_orderkey, 'gone' AS side FROM c WHERE missing UNION ALL SELECT o_orderkey, 'new' FROM c WHERE fresh")
def snapshot_keys(spark, sf_dir):
    return snapshot.appeared_and_gone(*editions(spark, sf_dir), ["o_orderkey"])


@query("""
WITH l AS (SELECT DISTINCT o_orderpriority AS category, o_orderstatus AS bureau_code, strftime(o_orderdate, '%Y-%m') AS edition FROM orders),
f AS (SELECT category, bureau_code, min(edition) AS edition, true AS earliest FROM l GROUP BY ALL)
SELECT CASE WHEN earliest AND o_orderkey % 2 = 0 THEN 1 WHEN earliest THEN 3 ELSE 2 END AS origin, count(*) AS n
FROM orders LEFT JOIN f ON category = o_orderpriority AND bureau_code = o_orderstatus AND edition = strftime(o_orderdate, '%Y-%m') GROUP BY 1
""")
def backfill_origin(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    download = F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM"))
    rows = orders.select(download.alias("download_id"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(3).alias("event_type"))
    downloads = orders.select(download.alias("id"), F.col("o_orderstatus").alias("bureau_code"), F.col("o_orderpriority").alias("category"), F.date_format("o_orderdate", "yyyy-MM").alias("published_on")).distinct()
    return snapshot.backfill_origin(rows, downloads).groupBy("origin").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, n_name AS started, CASE WHEN n_name IS NOT NULL THEN 2 ELSE 1 END AS updated_at FROM customer LEFT JOIN nation ON n_nationkey = c_custkey
""")
def enrich_by_code(spark, sf_dir):
    master = table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("string").alias("started"), F.lit(1).alias("updated_at"))
    listed = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS code", "n_name AS started")
    return snapshot.enrich_by_code(master, listed, F.col("c_custkey"), ["started"], 2)[0]


@query("""
SELECT (SELECT count(*) FROM nation) AS listed, count(*) AS matched, count(*) FILTER (n_name LIKE '%1%') AS changed FROM customer JOIN nation ON n_nationkey = c_custkey""")
def enrich_counters(spark, sf_dir):
    """Counters that are observed while the new master is written."""
    started = F.when(F.col("n_name").contains("1"), F.lit("earlier")).otherwise(F.col("n_name")).alias("started")
    master = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_custkey") == F.col("n_nationkey"), "left").select("c_custkey", started, F.lit(1).alias("updated_at"))
    listed = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS code", "n_name AS started")
    after, counters = snapshot.enrich_observed(master, listed, F.col("c_custkey"), ["started"], 2)
    after.write.parquet(scratch(spark, "enriched"))
    found = counters.get
    return spark.createDataFrame([(found["listed"], found["matched"], found["changed"])], "listed long, matched long, changed long")


@query(EDITIONS_SQL + "SELECT outcome, count(*) AS n FROM c GROUP BY 1")
def snapshot_observed(spark, sf_dir):
    """Outcomes that are counted while the comparison is written."""
    compared, counters = snapshot.observed_outcomes(snapshot.compare(*editions(spark, sf_dir), LAYOUT))
    compared.select("o_orderkey", "outcome").write.parquet(scratch(spark, "compared"))
    return spark.createDataFrame([(o, n) for o, n in counters.get.items() if n], "outcome string, n long")


@query("SELECT 'customer' AS name, count(*) AS n, CAST(max(c_custkey) AS VARCHAR) AS last FROM customer UNION ALL SELECT 'part', count(*), CAST(max(p_partkey) AS VARCHAR) FROM part")
def change_fingerprint(spark, sf_dir):
    return snapshot.change_fingerprint({"customer": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "updated_at"), "part": table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "updated_at")})


# ---- events


@query("""
SELECT event_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS is_reopening FROM events
""")
def event_reopening(spark, sf_dir):
    rows = events.is_reopening(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "error", "event_id")
    return rows.select("event_id", "is_reopening")


@query("""
SELECT event_id AS id, CAST(ts AS DATE) AS occurred_on, user_id FROM events
WHERE event_type = 'purchase' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)
""")
def event_feed(spark, sf_dir):
    code = F.when(F.col("event_type") == "purchase", 3).otherwise(1)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), code.alias("event_type"), F.lit(2).alias("origin"), F.to_date("ts").alias("occurred_on"), "user_id")
    wanted = table(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    found = events.filter_events(rows, 3, "2024-01-05", "2024-01-20", entities=wanted, key=["user_id"])
    return events.newest_first(found).select("id", "occurred_on", "user_id")


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type = 'view' AND json_extract_string(props, '$.k') IS NOT NULL AND user_id % 2 = 0)")
def event_visible(spark, sf_dir):
    base = table(spark, sf_dir, "events")
    change = F.struct(F.lit("a").alias("old"), F.get_json_object("props", "$.k").alias("new"))
    name = F.when(F.col("user_id") % 2 == 0, "founder_name").otherwise("name")
    rows = base.select("event_id", F.col("event_type").alias("kind"), F.when(F.col("event_type") == "view", 3).otherwise(1).alias("event_type"), F.create_map(name, change).alias("payload"))
    return events.drop_hidden_only_updates(rows).select("event_id", F.col("kind").alias("event_type"))


# ---- search


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'")
def filtered(spark, sf_dir):
    rows = search.filter_facilities(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None)
    return search.in_dates(rows, "o_orderdate", "1996-01-01", "1997-06-30").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def category_members(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("department_categories", F.split("p_name", " "))
    return search.has_category(rows, "ring").select("p_partkey")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 150")
def offset_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return search.page(rows, 4, 50, "-o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-03-01', 700) ORDER BY o_orderdate, o_orderkey LIMIT 100")
def keyset_page(spark, sf_dir):
    from datetime import datetime

    rows = table(spark, sf_dir, "orders")
    return search.page_after(rows, (datetime(1998, 3, 1), 700), 100, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-03-01', 700) ORDER BY o_orderdate, o_orderkey LIMIT 100")
def keyset_page_ordered(spark, sf_dir):
    """The page from a table that is laid out in the order of pages: row groups before the cursor are skipped by their statistics."""
    from datetime import datetime

    path = scratch(spark, "ordered")
    search.write_ordered(table(spark, sf_dir, "orders"), path, "o_orderdate", "o_orderkey")
    return search.page_after(spark.read.parquet(path), (datetime(1998, 3, 1), 700), 100, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) AND (contains(lower(p_name), 'd#1') OR contains(lower(p_brand), 'd#1'))")
def word_search_indexed(spark, sf_dir):
    """Words looked up by their pairs of characters; only blocks with a proposed row are read."""
    path = scratch(spark, "words")
    search.write_word_index(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand"], path)
    return search.indexed_words(spark, path, " RING　d#1 ", "p_partkey", ["p_name", "p_brand"]).select("p_partkey")


@query("SELECT CAST(least(count(*), 10001) AS BIGINT) AS total, count(*) >= 10001 AS is_capped FROM lineitem WHERE l_quantity > 10")
def capped_count(spark, sf_dir):
    return search.capped_count(table(spark, sf_dir, "lineitem").filter("l_quantity > 10"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def top_k(spark, sf_dir):
    return search.top_k(table(spark, sf_dir, "events"), "user_id", 20)


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(source), 'the')) AND (contains(lower(text), 'src3') OR contains(lower(source), 'src3'))")
def word_search(spark, sf_dir):
    return search.has_words(table(spark, sf_dir, "documents"), " THE　Ｓrc3 ", ["text", "source"], normalized=True).select("doc_id")


PLACES_SQL = "SELECT c_custkey AS id, 35 + (c_custkey * 37 % 1000) / 2000.0 AS lat, 139 + (c_custkey * 91 % 1000) / 2000.0 AS lon FROM customer"
DISTANCE_SQL = "2 * 6371000 * asin(sqrt(least(1.0, power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2))))"


def places(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "35 + (c_custkey * 37 % 1000) / 2000.0D AS lat", "139 + (c_custkey * 91 % 1000) / 2000.0D AS lon", "c_nationkey AS area")


@query(f"SELECT id, CAST(round(d) AS BIGINT) AS distance FROM (SELECT id, {DISTANCE_SQL.format(a='lat', b='35.25', c='lon', d='139.25')} AS d FROM ({PLACES_SQL})) WHERE d <= 20000")
def nearby(spark, sf_dir):
    found = search.nearby(places(spark, sf_dir), 35.25, 139.25, 20_000, ("lat", "lon"))
    return found.select("id", F.round("distance").cast("long").alias("distance"))


@query(f"""
WITH p AS (SELECT *, c_nationkey AS area FROM ({PLACES_SQL}) x JOIN customer ON c_custkey = id),
s AS (SELECT s_suppkey, 35 + (s_suppkey * 53 % 1000) / 2000.0 AS y, 139 + (s_suppkey * 17 % 1000) / 2000.0 AS x FROM supplier),
m AS (SELECT s_suppkey, id, area, row_number() OVER (PARTITION BY s_suppkey ORDER BY {DISTANCE_SQL.format(a='y', b='lat', c='x', d='lon')}, id) AS n FROM s JOIN p ON abs(y - lat) <= 0.03 AND abs(x - lon) <= 0.03)
SELECT s.s_suppkey, area, id FROM s LEFT JOIN m ON s.s_suppkey = m.s_suppkey AND n = 1""")
def nearest_area(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "35 + (s_suppkey * 53 % 1000) / 2000.0D AS lat", "139 + (s_suppkey * 17 % 1000) / 2000.0D AS lon")
    near = places(spark, sf_dir).withColumn("nearest_id", F.col("id"))
    return matching.nearest(points, near, ["s_suppkey"], ["area", "nearest_id"]).select("s_suppkey", "area", F.col("nearest_id").alias("id"))


@query(f"SELECT c_nationkey AS municipality_code, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM ({PLACES_SQL}) JOIN customer ON id = c_custkey WHERE id % 7 < 4 GROUP BY 1 HAVING count(*) >= 5")
def municipality_centers(spark, sf_dir):
    rows = places(spark, sf_dir).selectExpr("lat AS latitude", "lon AS longitude", "CAST(id % 7 + 1 AS INT) AS geocode_level", "area AS municipality_code")
    return matching.municipality_centers(rows).select("municipality_code", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, 139 + l_quantity / 100 AS lon, 35 + l_discount AS lat, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
e AS (SELECT a.l_orderkey, a.n, a.lon AS x, a.lat AS y, b.lon AS x2, b.lat AS y2, sqrt(pow((b.lon - a.lon) * cos(radians(f.lat)), 2) + pow(b.lat - a.lat, 2)) AS d
      FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND b.n = a.n + 1 JOIN p f ON f.l_orderkey = a.l_orderkey AND f.n = 1),
s AS (SELECT *, sum(d) OVER (PARTITION BY l_orderkey) / 2 - coalesce(sum(d) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM e),
h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS k FROM s WHERE d > 0 AND rest <= d)
SELECT f.l_orderkey, round(coalesce(x + (x2 - x) * rest / d, f.lon), 5) AS lon, round(coalesce(y + (y2 - y) * rest / d, f.lat), 5) AS lat
FROM p f LEFT JOIN h ON h.l_orderkey = f.l_orderkey AND k = 1 WHERE f.n = 1
""")
def line_middles(spark, sf_dir):
    point = F.array((139 + F.col("l_quantity") / 100), (35 + F.col("l_discount")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", point.alias("p")))).alias("ps"))
    middle = geo.line_middle(F.transform("ps", lambda p: p["p"]))
    return rows.select("l_orderkey", middle.alias("m")).select("l_orderkey", F.round("m.lon", 5).alias("lon"), F.round("m.lat", 5).alias("lat"))


# ---- hours: every supplier has three periods a week derived from its key; holidays are the days of large orders

PERIODS_SQL = """
WITH k AS (SELECT s_suppkey, i FROM supplier, (SELECT unnest([0, 1, 2]) AS i)),
p AS (SELECT s_suppkey, CAST((s_suppkey + i * 3) % 8 + 1 AS INTEGER) AS day, CAST((s_suppkey * 37 + i * 400) % 1380 * 60 AS INTEGER) AS opens,
      CAST(least((s_suppkey * 37 + i * 400) % 1380 * 60 + 21600, 86400) AS INTEGER) AS closes, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 21 ELSE 31 END AS INTEGER) AS weeks FROM k),
holidays AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 450000)
"""


def periods(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    start = "(s_suppkey * 37 + i * 400) % 1380 * 60"
    return keys.selectExpr("s_suppkey", "CAST((s_suppkey + i * 3) % 8 + 1 AS INT) AS day", f"CAST({start} AS INT) AS opens", f"CAST(least({start} + 21600, 86400) AS INT) AS closes", "CASE WHEN s_suppkey % 4 = 0 THEN 21 ELSE 31 END AS weeks")


def holidays(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select(F.to_date("o_orderdate").alias("date")).distinct()


@query(PERIODS_SQL + """
SELECT DISTINCT s_suppkey FROM p WHERE day = CASE WHEN DATE '1997-05-29' IN (SELECT date FROM holidays) THEN 8 ELSE 4 END AND opens <= 41400 AND 41400 < closes AND (weeks & 16) <> 0""")
def open_at(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    return hours.open_at(rows, ["s_suppkey"], periods(spark, sf_dir), holidays(spark, sf_dir), "1997-05-29 02:30:00")


ARRIVALS_SQL = PERIODS_SQL + """,
a AS (SELECT s_suppkey, TIMESTAMP '1997-05-29 12:00:00' + to_minutes(CAST(ceil(s_suppkey * 400 % 90000 * 78 / 20000.0) AS BIGINT)) AS arrival FROM supplier),
l AS (SELECT *, arrival + INTERVAL 9 HOUR AS loc FROM a),
d AS (SELECT *, CAST(loc AS DATE) + o AS date, o, epoch(loc) - epoch(CAST(loc AS DATE)) AS t FROM l, (SELECT unnest([0, 1]) AS o)),
r AS (SELECT d.s_suppkey, arrival, t, opens + o * 86400 AS opens, closes + o * 86400 AS closes FROM d JOIN p ON d.s_suppkey = p.s_suppkey
      AND p.day = CASE WHEN d.date IN (SELECT date FROM holidays) THEN 8 ELSE isodow(d.date) END AND (weeks & CAST(pow(2, floor((day(d.date) - 1) / 7)) AS INTEGER)) <> 0)
"""


def arriving(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 400 % 90000).cast("double").alias("metres"))
    return hours.arrivals(rows, "1997-05-29 12:00:00", "metres", "car").select("s_suppkey", "arrival")


@query(ARRIVALS_SQL + "SELECT DISTINCT s_suppkey, arrival FROM r WHERE opens <= t + 3600 AND closes > t")
def arrival_window(spark, sf_dir):
    return hours.arrival_window(arriving(spark, sf_dir), ["s_suppkey"], periods(spark, sf_dir), holidays(spark, sf_dir), 60)


@query(ARRIVALS_SQL + """,
n AS (SELECT *, CASE WHEN opens > max(closes) OVER (PARTITION BY s_suppkey ORDER BY opens, closes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY s_suppkey ORDER BY opens, closes ROWS UNBOUNDED PRECEDING) AS island FROM n),
m AS (SELECT s_suppkey, arrival, t, island, min(opens) AS opens, max(closes) AS closes FROM i GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY opens) AS k FROM m WHERE closes > t AND opens <= t + 3600)
SELECT s_suppkey, arrival, CASE WHEN opens > t THEN arrival + to_seconds(CAST(opens - t AS BIGINT)) END AS opens_at, arrival + to_seconds(CAST(closes - t AS BIGINT)) AS open_until FROM f WHERE k = 1""")
def arrival_hours(spark, sf_dir):
    return hours.arrival_hours(arriving(spark, sf_dir), ["s_suppkey"], periods(spark, sf_dir), holidays(spark, sf_dir), 60)


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 450000 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def holidays_between(spark, sf_dir):
    return hours.holidays_between(holidays(spark, sf_dir), "1997-01-01", "1998-12-31")


WINDOWS_SQL = "SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 8 + 1 AS INTEGER) AS day, CAST(l_partkey * 7 % 1440 AS INTEGER) AS opens, CAST((l_partkey * 7 + l_quantity * 25) % 1440 AS INTEGER) AS closes FROM lineitem"


def windows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_linenumber % 8 + 1 AS INT) AS day", "CAST(l_partkey * 7 % 1440 AS INT) AS opens", "CAST((l_partkey * 7 + l_quantity * 25) % 1440 AS INT) AS closes")


SPLIT_SQL = f"""
WITH w AS ({WINDOWS_SQL}),
s AS (SELECT l_orderkey, l_linenumber, day, opens, CASE WHEN closes > opens THEN closes ELSE 1440 END AS closes FROM w WHERE closes <> opens
      UNION ALL SELECT l_orderkey, l_linenumber, day % 7 + 1, 0, closes FROM w WHERE closes < opens AND closes > 0 AND day <> 8)
"""


@query(SPLIT_SQL + "SELECT * FROM s")
def split_overnight(spark, sf_dir):
    return hours.split_overnight(windows(spark, sf_dir))


@query(SPLIT_SQL + """
SELECT l_orderkey, l_linenumber, s.day, opens, closes, CAST(31 & ~coalesce(mask, 0) AS INTEGER) AS weeks FROM s
LEFT JOIN (SELECT o_orderkey, CAST(o_custkey % 8 + 1 AS INTEGER) AS day, bit_or(CAST(pow(2, o_custkey % 5) AS INTEGER)) AS mask FROM orders GROUP BY ALL) m ON m.o_orderkey = l_orderkey AND m.day = s.day
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l_orderkey AND o.o_orderkey % 8 + 1 = s.day)""")
def apply_closures(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    weekly = orders.selectExpr("o_orderkey AS l_orderkey", "CAST(o_orderkey % 8 + 1 AS INT) AS day")
    monthly = orders.selectExpr("o_orderkey AS l_orderkey", "CAST(o_custkey % 8 + 1 AS INT) AS day", "CAST(o_custkey % 5 + 1 AS INT) AS week")
    return hours.apply_closures(hours.split_overnight(windows(spark, sf_dir)), ["l_orderkey"], weekly, monthly).select("l_orderkey", "l_linenumber", "day", "opens", "closes", "weeks")


@query(SPLIT_SQL + """,
n AS (SELECT *, CASE WHEN opens > max(closes) OVER (PARTITION BY l_orderkey, day ORDER BY opens, closes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey, day ORDER BY opens, closes ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT l_orderkey, day, min(opens) AS opens, max(closes) AS closes FROM i GROUP BY l_orderkey, day, island""")
def merge_intervals(spark, sf_dir):
    return hours.merge_intervals(hours.split_overnight(windows(spark, sf_dir)), ["l_orderkey", "day"])


UNPIVOT_SQL = """
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, printf('%02d:%02d', CAST(l_quantity % 26 AS INTEGER), CAST(l_partkey % 60 AS INTEGER)) AS a, printf('%02d:%02d', CAST(l_suppkey % 24 AS INTEGER), 30) AS b FROM lineitem),
u AS (SELECT *, 'mon' AS day, CASE WHEN l_quantity % 26 <= 24 THEN a END AS opens, b AS closes FROM w
      UNION ALL SELECT *, 'tue' AS day, CASE WHEN l_quantity % 26 <= 24 THEN a END AS opens, NULL AS closes FROM w)
"""


def wide_hours(spark, sf_dir):
    two = lambda n: F.lpad((F.col("l_quantity") % 26).cast("int").cast("string"), 2, "0") if n == "a" else F.lpad((F.col("l_suppkey") % 24).cast("string"), 2, "0")
    opens = F.concat_ws(":", two("a"), F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0"))
    closes = F.concat_ws(":", two("b"), F.lit("30"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", opens.alias("月_s"), closes.alias("月_e"), opens.alias("火_s"), F.lit("bad").alias("火_e"))


DAYS = {"月": "mon", "火": "tue"}


@query(UNPIVOT_SQL + "SELECT l_orderkey, l_linenumber, l_partkey, day, opens, closes FROM u WHERE opens IS NOT NULL OR closes IS NOT NULL")
def unpivot_hours(spark, sf_dir):
    return hours.unpivot_hours(wide_hours(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey"], {"opens": "s", "closes": "e"}, DAYS)


@query("""
WITH s AS (SELECT l_suppkey, l_linenumber, string_agg(CAST(CAST(l_quantity % 3 AS INTEGER) AS VARCHAR), ',' ORDER BY l_orderkey, l_partkey, l_quantity % 3) AS slots FROM lineitem GROUP BY ALL)
SELECT l_suppkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS departments, count(*) AS n FROM s GROUP BY l_suppkey, slots
""")
def equal_schedules(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.struct("l_orderkey", "l_partkey"))
    grouped = hours.group_equal_schedules(rows, ["l_suppkey"], "l_linenumber", F.struct((F.col("l_quantity") % 3).cast("int").alias("q")), "ord")
    return grouped.select("l_suppkey", F.array_join(F.transform("departments", lambda d: d.cast("string")), ",").alias("departments"), F.size("departments").cast("long").alias("n"))


# ---- matching and texts


@query("""
WITH l AS (SELECT p_partkey, p_brand, p_type, p_name AS name, CAST(p_size % 5 AS VARCHAR) AS addr FROM part),
r AS (SELECT p_partkey AS id, p_brand, p_type, CASE WHEN p_partkey % 6 = 0 THEN 'new ' || p_name ELSE p_name END AS name, CAST(p_size % 5 AS VARCHAR) AS addr FROM part WHERE p_partkey % 3 <> 1),
n AS (SELECT l.p_partkey, count(*) AS n, min(r.id) AS one, count(*) FILTER (r.addr = l.addr) AS m, min(r.id) FILTER (r.addr = l.addr) AS same FROM l JOIN r USING (p_brand, p_type, name) GROUP BY 1),
a AS (SELECT p_partkey, CASE WHEN n = 1 THEN one WHEN m = 1 THEN same END AS match_id, (n = 1 OR m > 0) AS ended FROM n),
b AS (SELECT l.p_partkey, count(*) AS n, min(r.id) AS match_id FROM l JOIN r ON l.p_brand = r.p_brand AND l.p_type = r.p_type AND l.addr = r.addr
      WHERE l.p_partkey NOT IN (SELECT p_partkey FROM a WHERE ended) AND length(l.name) >= 3 AND length(r.name) >= 3 AND (contains(r.name, l.name) OR contains(l.name, r.name)) GROUP BY 1)
SELECT p_partkey, match_id FROM a WHERE match_id IS NOT NULL UNION ALL SELECT p_partkey, match_id FROM b WHERE n = 1
""")
def entity_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    address = (F.col("p_size") % 5).cast("string").alias("address_key")
    left = part.select("p_partkey", "p_brand", "p_type", F.col("p_name").alias("name_key"), address)
    name = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("new "), "p_name")).otherwise(F.col("p_name"))
    right = part.filter("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", name.alias("name_key"), address)
    return matching.match_entities(left, right, "p_partkey", ["p_brand", "p_type"])


@query("""
WITH names AS (SELECT lang, w AS name, min(doc_id) AS code FROM (SELECT lang, doc_id, string_split(text, ' ')[1] AS w FROM documents UNION ALL SELECT lang, doc_id, array_to_string(string_split(text, ' ')[1:2], ' ') FROM documents) WHERE w <> '' GROUP BY ALL),
m AS (SELECT d.doc_id, n.code, length(n.name) AS n, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(n.name) DESC, n.code DESC) AS k FROM documents d JOIN names n ON d.lang = n.lang AND starts_with(d.text, n.name))
SELECT doc_id, code, n FROM m WHERE k = 1
""")
def longest_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    begins = F.explode(F.array(F.substring_index("text", " ", 1), F.substring_index("text", " ", 2)))
    names = docs.select("lang", "doc_id", begins.alias("name")).filter("name <> ''").groupBy("lang", "name").agg(F.min("doc_id").alias("code"))
    return matching.prefix_matches(docs, names, ["lang"], "text", ["doc_id"]).select("doc_id", "code", F.col("n").cast("long").alias("n"))


@query("""
WITH r AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS record FROM conversations)
SELECT conv_id, CAST(record AS INTEGER) AS record, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM r WHERE record > 0 GROUP BY ALL
""")
def group_records(spark, sf_dir):
    rows = records.record_numbers(table(spark, sf_dir, "conversations"), F.col("role") == "user", ["conv_id"], ["turn"])
    return rows.groupBy("conv_id", "record").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h FROM pages),
u AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS n FROM a)
SELECT u.page_id, CAST(n AS INTEGER) AS n, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN replace(href, '&amp;', '&')
 WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || replace(href, '&amp;', '&')
 WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(href, '&amp;', '&')
 ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/]*(?:/.*)?/)', 1) || replace(href, '&amp;', '&') END AS url
FROM u JOIN pages ON pages.page_id = u.page_id
""")
def page_links(spark, sf_dir):
    return links.anchors(table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "n", "href", "url")


@query("""
WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents),
c AS (SELECT doc_id, CASE WHEN contains(token, 'tion') THEN 3 WHEN contains(token, 'ment') THEN 7 WHEN contains(token, 'ung') THEN 2 WHEN contains(token, 'the') THEN 1 WHEN contains(token, 'an') THEN 9 END AS category FROM t)
SELECT category, count(*) AS count FROM (SELECT DISTINCT doc_id, category FROM c WHERE category IS NOT NULL) GROUP BY 1
""")
def marker_classify(spark, sf_dir):
    from ..functions.text import category_of

    markers = [("tion", 3), ("ment", 7), ("ung", 2), ("the", 1), ("an", 9)]
    found = F.array_distinct(F.filter(F.transform(F.split("text", " "), lambda t: category_of(t, markers)), lambda c: c.isNotNull()))
    return stats.count_by_category(table(spark, sf_dir, "documents").select(found.alias("categories")), "categories")


# ---- access log: status from the value, address from the user, path from the type


def log_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    status = F.when(F.col("value") > 100, 404).when(F.col("value") > 60, 429).when(F.col("value") > 50, 500).otherwise(200)
    uri = F.concat(F.lit("/"), F.when(F.col("user_id") % 13 == 0, F.lit(".env")).otherwise(F.col("event_type")), F.lit("?k="), F.get_json_object("props", "$.k"))
    request = F.struct(F.col("user_id").cast("string").alias("remote_ip"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("client_ip"), uri.alias("uri"))
    return rows.select(status.alias("status"), request.alias("request"))


LOG_SQL = """
WITH e AS (SELECT CASE WHEN value > 100 THEN 404 WHEN value > 60 THEN 429 WHEN value > 50 THEN 500 ELSE 200 END AS status,
  CASE WHEN user_id % 2 = 0 THEN 'c' || user_id ELSE CAST(user_id AS VARCHAR) END AS ip, '/' || CASE WHEN user_id % 13 = 0 THEN '.env' ELSE event_type END AS path FROM events),
s AS (SELECT 'total' AS kind, NULL AS key, count(*) AS n, count(*) FILTER (status = 429) AS limited FROM e
  UNION ALL SELECT 'server_errors', NULL, count(*) FILTER (status >= 500), 0 FROM e
  UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*), count(*) FILTER (status = 429) FROM e GROUP BY status
  UNION ALL SELECT 'ip', ip, count(*), count(*) FILTER (status = 429) FROM e GROUP BY ip
  UNION ALL SELECT 'scanner', ip, count(*), 0 FROM e WHERE path = '/.env' GROUP BY ip
  UNION ALL SELECT 'missed', path, count(*), 0 FROM e WHERE status = 404 GROUP BY path)
"""


@query(LOG_SQL + "SELECT * FROM s")
def access_summary(spark, sf_dir):
    return access_log.access_summary(access_log.requests(log_entries(spark, sf_dir)))


@query(LOG_SQL + """
SELECT 'rate_limited' AS finding, key, n FROM s WHERE kind = 'status' AND key = '429' AND n >= 50 UNION ALL SELECT 'not_found', key, n FROM s WHERE kind = 'status' AND key = '404' AND n >= 200
UNION ALL SELECT 'scanner', key, n FROM s WHERE kind = 'scanner' AND n >= 10 UNION ALL SELECT 'busy', key, n FROM s WHERE kind = 'ip' AND n >= 3000""")
def access_alerts(spark, sf_dir):
    return access_log.access_alerts(access_log.access_summary(access_log.requests(log_entries(spark, sf_dir))))


@query(LOG_SQL + "SELECT key, n FROM s WHERE kind = 'ip' ORDER BY n DESC, key LIMIT 10")
def access_top(spark, sf_dir):
    summary = access_log.access_summary(access_log.requests(log_entries(spark, sf_dir)))
    return access_log.top_of(summary, "ip", 10).select("key", "n")


# ---- ledger and export


def downloads(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderstatus", F.trunc("o_orderdate", "month").alias("published_on"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderdate")).alias("superseded_at"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate")).alias("imported_at"))


CURRENT_SQL = """
WITH l AS (SELECT o_orderkey AS id, o_orderpriority, o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS published_on, o_orderkey % 4 > 0 AS imported FROM orders WHERE o_orderkey % 9 <> 0),
c AS (SELECT *, max(published_on) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS newest FROM l)
"""


@query(CURRENT_SQL + "SELECT id, o_orderpriority, o_orderstatus, published_on FROM c WHERE published_on = newest")
def current_editions(spark, sf_dir):
    return ledger.current_editions(downloads(spark, sf_dir), ["o_orderpriority", "o_orderstatus"]).select("id", "o_orderpriority", "o_orderstatus", "published_on")


@query(CURRENT_SQL + """,
s AS (SELECT o_orderpriority, o_orderstatus, max(published_on) AS d, bool_and(imported) AS imported FROM c WHERE published_on = newest GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus))
SELECT g.o_orderpriority, g.o_orderstatus, array_to_string(list_filter([CASE WHEN d IS NULL THEN 'missing' END, CASE WHEN NOT imported THEN 'not imported' END, CASE WHEN DATE '2001-09-01' - d > 45 THEN 'stale' END], lambda x: x IS NOT NULL), ',') AS problems
FROM g LEFT JOIN s USING (o_orderpriority, o_orderstatus) WHERE d IS NULL OR NOT imported OR DATE '2001-09-01' - d > 45""")
def freshness(spark, sf_dir):
    source = ["o_orderpriority", "o_orderstatus"]
    grid = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().withColumn("o_orderstatus", F.explode(F.array(*[F.lit(s) for s in "FOPX"])))
    return ledger.freshness_report(ledger.current_editions(downloads(spark, sf_dir), source), grid, source, "2001-09-01")


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS published_on, count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1)
SELECT max(published_on) AS published_on FROM d WHERE n = 3""")
def newest_complete(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("published_on"), F.col("o_orderpriority").alias("dataset"))
    return ledger.newest_complete(files, ["1-URGENT", "2-HIGH", "5-LOW"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def new_links(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledger.new_links(table(spark, sf_dir, "orders"), known, ("o_orderkey",)).select("o_orderkey", "o_orderpriority")


@query("""
SELECT c_custkey, CASE WHEN regexp_matches(t, '^[=+@-]') THEN '''' || t ELSE t END AS label, n_name AS nation
FROM (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-' || c_name ELSE c_name END AS t FROM customer) JOIN nation ON n_nationkey = c_nationkey""")
def export_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("="), "c_name")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("-"), "c_name")).otherwise(F.col("c_name"))
    named = rows.select("c_custkey", "c_nationkey", text.alias("label")).join(table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS nation"), "c_nationkey")
    return export.safe_text(named.select("c_custkey", "label", "nation"))


@query("""
SELECT c_nationkey, part, count(*) AS records, CAST(sum(octet_length(encode(line))) AS BIGINT) AS bytes, sha256(string_agg(line, '' ORDER BY c_custkey)) AS sha256
FROM (SELECT c_nationkey, c_custkey // 1000 AS part, c_custkey, c_custkey || ',' || c_name || ',' || c_mktsegment || chr(13) || chr(10) AS line FROM customer) GROUP BY 1, 2""")
def manifest(spark, sf_dir):
    line = F.concat(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), F.lit("\r\n"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.expr("c_custkey DIV 1000").alias("part"), "c_custkey", line.alias("line"))
    return export.digests(rows, ["c_nationkey", "part"], "line", ["c_custkey", "line"])


from . import mapped, moved, placed, served  # noqa: E402, F401  (they register further queries)
