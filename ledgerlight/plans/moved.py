"""Queries of sources, the ledger, exports and streams; files are made of the given tables in bounded pieces."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import export, snapshot
from ..sources import files, ledger, links
from ..streaming import jobs
from .base import query, scratch, table
from .served import LABELS_SQL, facilities, municipalities

#: Rows of a table that make one file.
PIECE = 500


# ---- links and files


@query(r"""
WITH a AS (SELECT page_id % 3 AS bureau, page_id, url AS base, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href FROM pages),
u AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN replace(href, '&amp;', '&') WHEN starts_with(href, '//') THEN regexp_extract(base, '^([a-z]+:)', 1) || replace(href, '&amp;', '&')
  WHEN starts_with(href, '/') THEN regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || replace(href, '&amp;', '&') ELSE regexp_extract(regexp_replace(base, '[?#].*$', ''), '^([a-z]+://[^/]*(?:/.*)?/)', 1) || replace(href, '&amp;', '&') END AS url FROM a)
SELECT DISTINCT bureau, CAST(bureau + 1 AS INTEGER) AS category, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS filename, make_date(2019 + page_id % 7, page_id % 12 + 1, page_id % 28 + 1) AS published_on
FROM u WHERE CASE bureau WHEN 0 THEN regexp_matches(href, '^/[a-m]') WHEN 1 THEN NOT regexp_matches(href, 'the') ELSE regexp_matches(href, 'on$') AND NOT regexp_matches(href, 'a') END""")
def published_links(spark, sf_dir):
    date = F.concat(F.lit("<p>令和"), F.col("page_id") % 7 + 1, F.lit("年"), F.col("page_id") % 12 + 1, F.lit("月"), F.col("page_id") % 28 + 1, F.lit("日現在</p>"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("bureau"), "url", F.concat(date, "html").alias("html"))
    rules = spark.createDataFrame(
        [(0, 1, None, "^/[a-m]", None, None, None, False), (1, 2, None, None, None, None, "^[^ ]*the", False), (2, 3, None, "on$", None, None, "^[^ ]*a", False)],
        "bureau long, category int, prefecture string, href_has string, text_has string, row_has string, unless string, first_table boolean",
    )
    return links.extract_links(pages, rules).select("bureau", "category", "url", "filename", "published_on")


def zipped(rows, key: str, make, kind: str = "string"):
    """(path, content): a zip for each piece of ``PIECE`` keys, by ``make`` from its rows in order."""
    pieces = rows.withColumn("piece", F.expr(f"{key} DIV {PIECE}"))

    def build(piece: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [f"{piece['piece'].iloc[0]}.zip"], "content": [make(piece.sort_values(key))]})

    return pieces.groupBy("piece").applyInPandas(build, "path string, content binary")


def csv_zip(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        lines = ["id,name,nation", *(f'{i},"{n}, x",{c}' if i % 6 else f"{i},short" for i, n, c in zip(rows["c_custkey"], rows["c_name"], rows["c_nationkey"], strict=True))]
        z.writestr("list.csv", "﻿" + "\r\n".join(lines) + "\r\n")
    return out.getvalue()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ', x' AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_custkey % 6 > 0")
def zipped_csv(spark, sf_dir):
    raw = zipped(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", csv_zip)
    return files.scan_zip_csv(raw, ["id", "name", "nation"]).select("id", "name", "nation")


def workbook(rows: pd.DataFrame) -> bytes:
    """A workbook of two sheets, even and odd keys, each row its key, an empty cell and its name."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="even" sheetId="1" r:id="rId1"/><sheet name="odd" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{n}</t></si>" for n in rows["s_name"]) + "</sst>")
        numbered = list(enumerate(zip(rows["s_suppkey"], rows["s_name"], strict=True)))
        for side in (0, 1):
            own = [(n, k) for n, (k, _) in numbered if k % 2 == side]
            cells = "".join(f'<row r="{i}"><c r="A{i}"><v>{k}</v></c><c r="C{i}" t="s"><v>{n}</v></c></row>' for i, (n, k) in enumerate(own, 1))
            z.writestr(f"xl/worksheets/sheet{side + 1}.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def bundle(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("in/book.xlsx", workbook(rows))
        z.writestr("in/readme.txt", "none")
    return out.getvalue()


def books(spark, sf_dir):
    path = scratch(spark, "books")
    zipped(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", bundle).write.parquet(path)
    return spark.read.parquet(path)


@query(f"SELECT DISTINCT s_suppkey // {PIECE} || '.zip' AS path, 'in/book.xlsx' AS entry, sheet FROM supplier, (SELECT unnest(['even', 'odd']) AS sheet)")
def bundled_sheets(spark, sf_dir):
    return files.expand_bundles(books(spark, sf_dir))


@query(f"""
SELECT s_suppkey // {PIECE} || '.zip/' || CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS unit, CAST(row_number() OVER (PARTITION BY s_suppkey // {PIECE}, s_suppkey % 2 ORDER BY s_suppkey) AS INTEGER) AS row_no, s_suppkey || '||' || s_name AS cells FROM supplier""")
def sheet_cells(spark, sf_dir):
    raw = books(spark, sf_dir)
    units = files.expand_bundles(raw).join(raw, "path").withColumn("unit", F.concat_ws("/", "path", "sheet"))
    return files.scan_workbooks(units).select("unit", "row_no", F.array_join("cells", "|").alias("cells"))


@query("SELECT s_name AS name, CAST(s_nationkey AS INTEGER) AS kind, CASE WHEN s_suppkey % 5 > 0 THEN CAST(139 + s_suppkey % 7 AS DOUBLE) END AS lon, CAST(35 AS DOUBLE) AS lat FROM supplier")
def geojson_points(spark, sf_dir):
    path = scratch(spark, "geojson")
    properties = F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("kind"))
    lon = F.when(F.col("s_suppkey") % 5 > 0, (139 + F.col("s_suppkey") % 7).cast("double"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, F.lit(35.0)).alias("coordinates")).alias("geometry"))
    pieces = table(spark, sf_dir, "supplier").groupBy(F.expr(f"s_suppkey DIV {PIECE}").alias("piece")).agg(F.collect_list(feature).alias("features"))
    pieces.select("piece", F.to_json(F.struct("features")).alias("value")).repartition("piece").write.partitionBy("piece").text(path)  # a file for each piece
    read = files.scan_geojson(spark, path, "name:string,kind:int", "Point")
    return read.select("properties.name", "properties.kind", F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"))


def log_lines(spark, sf_dir, where: str = "true", path: str | None = None) -> str:
    """Events as lines of an access log; the folder they are in."""
    path = path or scratch(spark, "log")
    request = F.struct(F.col("user_id").cast("string").alias("remote_ip"), F.concat(F.lit("/"), F.when(F.col("user_id") % 13 == 0, ".env").otherwise(F.col("event_type")), F.lit("?q")).alias("uri"))
    status = F.when(F.col("value") > 100, 404).when(F.col("value") > 60, 429).otherwise(200)
    line = F.to_json(F.struct((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), status.alias("status"), F.col("event_id").cast("string").alias("msg"), request.alias("request")))
    rows = table(spark, sf_dir, "events").filter(where)
    rows.select(F.when(F.col("event_id") % 17 == 0, "broken").otherwise(line).alias("value")).write.mode("append").text(path, compression="gzip")
    return path


@query("""
SELECT CAST(event_id AS VARCHAR) AS msg, CAST(CASE WHEN value > 100 THEN 404 WHEN value > 60 THEN 429 ELSE 200 END AS INTEGER) AS status, CAST(user_id AS VARCHAR) AS remote_ip
FROM events WHERE event_id % 17 > 0 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
def access_log_entries(spark, sf_dir):
    found = files.scan_access_log(spark, log_lines(spark, sf_dir), 1704412800.0, 1705708800.0)
    return found.select("msg", "status", "request.remote_ip")


@query("""
WITH e AS (SELECT CASE WHEN value > 100 THEN 404 WHEN value > 60 THEN 429 ELSE 200 END AS status, user_id % 13 = 0 AS probe, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM events WHERE event_id % 17 > 0)
SELECT day, CAST(status AS INTEGER) AS status, count(*) AS n, count(*) FILTER (probe) AS probes FROM e GROUP BY ALL""")
def access_days(spark, sf_dir):
    """The stream of the log, run over what there is and read back."""
    out, name = scratch(spark, "days"), "access_days"
    counted = jobs.access_stream(jobs.read_access_stream(spark, log_lines(spark, sf_dir)))
    kept = counted.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out))
    kept.option("checkpointLocation", scratch(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.to_date(F.from_utc_timestamp("start", "Asia/Tokyo")).alias("day"), "status", "n", "probes")


@query("""
WITH e AS (SELECT CASE WHEN value > 100 THEN 404 WHEN value > 60 THEN 429 ELSE 200 END AS status, user_id % 13 = 0 AS probe, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, ts, event_id % 7 = 3 AS second FROM events WHERE event_id % 17 > 0),
w AS (SELECT max(ts) FILTER (NOT second) - INTERVAL 1 DAY AS one, max(ts) - INTERVAL 1 DAY AS two FROM e),
d AS (SELECT e.*, day + INTERVAL 15 HOUR <= one AS before, day + INTERVAL 15 HOUR <= two AS closed FROM e, w)
SELECT 'day' AS kind, day, CAST(status AS INTEGER) AS status, count(*) AS n, count(*) FILTER (probe) AS probes FROM d WHERE closed AND NOT (second AND before) GROUP BY ALL
UNION ALL SELECT 'late', NULL, NULL, count(*), NULL FROM d WHERE second AND before""")
def access_days_closed(spark, sf_dir):
    """The log arrives in two parts, the second after the first closed its days; each day is written once, and what is late is counted."""
    root = scratch(spark, "days-closed")
    late = 0
    for where in ("event_id % 7 <> 3", "event_id % 7 = 3"):
        stream = jobs.read_access_stream(spark, log_lines(spark, sf_dir, where, f"{root}/log"))
        late += jobs.run_access_days(stream, f"{root}/days", f"{root}/checkpoint")["late"]
    days = spark.read.parquet(f"{root}/days").select(F.lit("day").alias("kind"), F.to_date(F.from_utc_timestamp("start", "Asia/Tokyo")).alias("day"), "status", "n", "probes")
    return days.unionByName(spark.createDataFrame([("late", None, None, late, None)], "kind string, day date, status int, n long, probes long"))


# ---- the ledger


def ledger_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey % 8 AS bureau_code", "o_orderpriority AS category", "concat('f', o_orderkey) AS filename", "array(CAST(o_custkey % 5 AS STRING), o_orderstatus) AS prefecture_codes", "CAST(o_orderdate AS DATE) AS published_on",
        "TIMESTAMP'2024-01-01 00:00:00' AS imported_at", "CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP'2024-01-01 00:00:00' END AS superseded_at",
    )


@query("""
WITH l AS (SELECT o_orderkey, o_custkey % 8 AS b, o_orderpriority AS c, CAST(o_orderdate AS DATE) AS d, o_custkey % 5 || o_orderstatus AS covers, o_orderkey % 4 = 0 AS marked FROM orders),
k AS (SELECT *, o_orderkey % 6 = 0 AS same FROM l WHERE o_orderkey % 3 = 0)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 AND marked THEN false WHEN o_orderkey % 6 <> 0 AND NOT marked AND EXISTS (SELECT 1 FROM k WHERE k.b = l.b AND k.c = l.c AND k.d = l.d AND k.covers = l.covers) THEN true ELSE marked END AS superseded,
  NOT (o_orderkey % 6 = 0 AND marked) AS imported FROM l""")
def superseded(spark, sf_dir):
    linked = ledger_rows(spark, sf_dir).filter("id % 3 = 0").withColumn("filename", F.when(F.col("id") % 6 == 0, F.col("filename")).otherwise(F.concat(F.lit("new"), "filename")))
    out = ledger.supersede_replaced(ledger_rows(spark, sf_dir), linked.select("bureau_code", "category", "filename", "prefecture_codes", "published_on"), "2024-03-01 00:00:00")
    return out.select("id", F.col("superseded_at").isNotNull().alias("superseded"), F.col("imported_at").isNotNull().alias("imported"))


@query("SELECT o_orderkey AS id, o_orderkey IN (1, 2, 3, 500) OR o_orderkey % 2 = 0 AS imported FROM orders")
def marked_imported(spark, sf_dir):
    rows = ledger_rows(spark, sf_dir).withColumn("imported_at", F.when(F.col("id") % 2 == 0, F.col("imported_at")))
    return ledger.mark_imported(rows, [1, 2, 3, 500], 0, "2024-03-01 00:00:00").select("id", F.col("imported_at").isNotNull().alias("imported"))


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS label FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0)
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), arg_max(c_name, c_custkey) FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_nationkey""")
def seeded(spark, sf_dir):
    kept = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS STRING) AS code", "n_name AS label")
    rows = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").selectExpr("CAST(c_nationkey AS STRING) AS code", "c_name AS label", "c_custkey AS ord")
    return ledger.load_seed(kept, rows, ["code"])


@query("SELECT s_suppkey, s_name FROM supplier")
def guarded(spark, sf_dir):
    return ledger.guard_min_rows(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), 1)


@query("SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderkey % 50 = 0 AND o_orderdate < TIMESTAMP '1997-01-01')")
def newer_editions(spark, sf_dir):
    rows = ledger_rows(spark, sf_dir).select("id", F.col("published_on").alias("as_of"))
    return ledger.newer_edition_only(rows, rows.filter("id % 50 = 0 AND as_of < DATE'1997-01-01'")).select("id")


@query("""
SELECT b AS bureau_code, c AS category FROM (SELECT DISTINCT o_custkey % 50 AS b, o_orderpriority AS c FROM orders)
WHERE (b, c) NOT IN (SELECT (o_custkey % 50, o_orderpriority) FROM orders WHERE o_orderkey % 7 = 0)""")
def missing_categories(spark, sf_dir):
    rows = ledger_rows(spark, sf_dir).drop("bureau_code").join(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 50 AS bureau_code"), "id")
    return ledger.missing_categories(rows, rows.filter("id % 7 = 0"), ["bureau_code", "category"])


@query("SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT CAST(s_suppkey AS BIGINT), s_name, NULL FROM supplier")
def united_editions(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    return ledger.union_editions([a, table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name")])


# ---- snapshots


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 3 ELSE 2 END AS origin, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 3 END AS event_type FROM orders""")
def snapshot_origins(spark, sf_dir):
    """Every third order is new; the others change, every fifth against a row last seen in the same edition."""
    base = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderpriority AS v", "1 AS status", "o_orderstatus AS institution_type", "'1' AS prefecture_code")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    master = base.filter("k % 3 > 0").withColumns({"last_seen_download": F.when(F.col("k") % 5 == 0, 7).otherwise(6).cast("long"), "created_at": at, "updated_at": at})
    downloads = spark.sql("SELECT CAST(7 AS long) AS id, date'2024-02-01' AS published_on, CAST(NULL AS timestamp) AS superseded_at UNION ALL SELECT 6, date'2024-01-01', NULL")
    layout = snapshot.Layout(key=("k",), attributes=("v",))
    _, logged = snapshot.apply_snapshot(master, base.withColumn("v", F.lit("new")), 8, "2024-02-01", "2024-02-02 00:00:00", layout, downloads)
    return logged.select("k", "origin", "event_type")


@query("SELECT batches, orders FROM (SELECT count(*) AS orders FROM orders), (SELECT 1 AS batches)")
def snapshot_batches(spark, sf_dir):
    """Editions that arrive as a stream are handed over whole, each batch once."""
    out = scratch(spark, "batches")
    rows = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parquet*")
    stream = jobs.snapshot_stream(rows, lambda df, i: df.groupBy().count().withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}"), scratch(spark, "batches-checkpoint"))
    stream.awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").cast("int").alias("batches"), F.sum("count").alias("orders"))


@query("""
WITH f AS (SELECT c_custkey AS k, c_nationkey + 1 AS p, c_custkey % 4 + 1 AS t FROM customer)
SELECT 'facility' AS kind, k FROM f WHERE p IN (13, 14) AND t IN (1, 4) UNION ALL SELECT 'event', o_orderkey FROM orders JOIN f ON k = o_custkey WHERE p IN (13, 14) AND t IN (1, 4)
UNION ALL SELECT 'download', o_orderkey FROM orders WHERE (o_custkey % 20 IN (13, 14) OR o_orderkey % 9 = 0) AND o_orderkey % 3 + 1 IN (1, 2)""")
def in_scope(spark, sf_dir):
    rows = facilities(spark, sf_dir).select("id", "prefecture_code", "institution_type")
    orders = table(spark, sf_dir, "orders")
    log = orders.selectExpr("o_custkey AS id", "o_orderkey")
    downloads = orders.selectExpr("o_orderkey", "CAST(o_orderkey % 3 + 1 AS INT) AS category", "array(lpad(CAST(o_custkey % 20 AS STRING), 2, '0'), CASE WHEN o_orderkey % 9 = 0 THEN '14' ELSE '47' END) AS prefecture_codes")
    kept, logged, left = snapshot.prune_out_of_scope(rows, log, downloads, ["13", "14"], [1, 4], [1, 2], ["id"])
    kind = lambda df, name, key: df.select(F.lit(name).alias("kind"), F.col(key).alias("k"))
    return kind(kept, "facility", "id").unionByName(kind(logged, "event", "o_orderkey")).unionByName(kind(left, "download", "o_orderkey"))


# ---- exports


@query(LABELS_SQL + """
SELECT CAST(c_custkey AS VARCHAR) AS id, pref || CASE kind WHEN 3 THEN '3' WHEN 4 THEN '4' ELSE '1' END || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS medical_institution_code, t.label AS institution_type, b.label AS bureau, CASE WHEN c_custkey % 5 > 0 THEN n_name END AS municipality,
  d1 || '|' || d2 AS department_category_codes, pref AS area FROM f JOIN t ON t.code = kind JOIN b ON b.code = bureau JOIN nation ON n_nationkey = c_nationkey""")
def exported(spark, sf_dir):
    """The current export set, read back from its files by area."""
    from ..functions.fixed import BUREAUS

    root = scratch(spark, "export")
    made = export.export_set(facilities(spark, sf_dir), municipalities(spark, sf_dir), BUREAUS, root, {})
    assert export.current_manifest(spark, root)["set"] == made["set"]
    schema = ", ".join(f"`{c}` string" for c in export.CSV_COLUMNS) + ", area string"
    read = spark.read.schema(schema).options(header=True, escape='"', lineSep="\r\n").csv(f"{root}/sets/{made['set']}/csv")
    return read.select("id", "medical_institution_code", "institution_type", "bureau", "municipality", "department_category_codes", "area")


@query("""
SELECT 'csv' AS format, lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS prefecture, count(*) AS records FROM customer GROUP BY 2 UNION ALL SELECT 'jsonl', lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0'), count(*) FROM customer GROUP BY 2
UNION ALL SELECT 'csv_all', NULL, count(*) FROM customer UNION ALL SELECT 'jsonl_all', NULL, count(*) FROM customer""")
def export_manifest(spark, sf_dir):
    from ..functions.fixed import BUREAUS

    path, rows = scratch(spark, "export"), facilities(spark, sf_dir)
    export.export_bulk(rows, municipalities(spark, sf_dir), BUREAUS, path)
    listed = export.export_manifest(spark, path, rows, {})["files"]
    return spark.createDataFrame([(f["format"], f["prefecture"], f["records"]) for f in listed], "format string, prefecture string, records long").distinct()


@query("""
SELECT format, prefecture, records, true AS same FROM (SELECT 'csv' AS format, lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS prefecture, count(*) AS records FROM customer GROUP BY 2
UNION ALL SELECT 'jsonl', lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0'), count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'csv_all', NULL, count(*) FROM customer UNION ALL SELECT 'jsonl_all', NULL, count(*) FROM customer)""")
def export_digests(spark, sf_dir):
    """Bytes and digests of the manifest, read in pieces, against those of the whole files."""
    from ..functions.fixed import BUREAUS

    path, rows = scratch(spark, "export"), facilities(spark, sf_dir)
    export.export_bulk(rows, municipalities(spark, sf_dir), BUREAUS, path)
    listed = export.described_files(spark, path, chunk=1000)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    told = listed.join(whole.select("path", F.length("content").alias("size"), F.sha2("content", 256).alias("digest")), "path", "full")
    same = F.coalesce((F.col("bytes") == F.col("size")) & (F.col("sha256") == F.col("digest")), F.lit(False))
    counts = rows.groupBy(F.col("prefecture_code").alias("prefecture")).agg(F.count("*").alias("records")).unionByName(rows.agg(F.count("*").alias("records")).select(F.lit(None).cast("string").alias("prefecture"), "records"))
    return told.groupBy("format", "prefecture").agg(F.bool_and(same).alias("same")).join(counts.withColumnRenamed("prefecture", "_p"), F.col("prefecture").eqNullSafe(F.col("_p"))).select("format", "prefecture", "records", "same")


@query("""
SELECT what, due FROM (VALUES ('first', true), ('same', false), ('other scope', true)) AS t(what, due) UNION ALL SELECT 'newer', max(c_custkey) >= 0 FROM customer""")
def exports_due(spark, sf_dir):
    rows = facilities(spark, sf_dir)
    current = {"data_updated_at": rows.agg(F.max("updated_at").cast("string")).head()[0], "scope": {}}
    later = rows.withColumn("updated_at", F.expr("updated_at + INTERVAL 1 DAY"))
    due = [("first", export.should_export(rows, {}, None)), ("same", export.should_export(rows, {}, current)), ("other scope", export.should_export(rows, {"x": 1}, current)), ("newer", export.should_export(later, {}, current))]
    return spark.createDataFrame(due, "what string, due boolean")


@query("SELECT c_custkey, c_name FROM customer")
def replaced_table(spark, sf_dir):
    return spark.read.parquet(export.replace_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), scratch(spark, "table"), 1))
