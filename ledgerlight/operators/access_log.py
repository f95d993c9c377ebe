"""Summaries of web access logs, and what in them calls for attention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import scanner_path

# From how many requests on a finding is told.
THRESHOLDS = {"rate_limited": 50, "not_found": 200, "scanner": 10, "busy": 3000}


def requests(log: DataFrame) -> DataFrame:
    """(status, ip, path, scanner) of log entries (ts, status, request)."""
    ip = F.coalesce("request.client_ip", "request.remote_ip", F.lit("-"))
    uri = F.coalesce("request.uri", F.lit("-"))
    before = F.substring_index(uri, "?", 1)
    path = F.when(before == "", uri).otherwise(before)
    return log.select("status", ip.alias("ip"), path.alias("path")).withColumn("scanner", scanner_path(F.col("path")))


def access_summary(entries: DataFrame) -> DataFrame:
    """(kind, key, n, limited): totals, counts by status and ip, missed paths, scanners by ip.

    One pass over grouping sets of status, ip and path; keys are shown as text.
    """
    cube = entries.groupingSets([[], ["status"], ["ip"], ["path"]], "status", "ip", "path").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == 429).alias("limited"),
        F.count_if(F.col("status") == 404).alias("missed"),
        F.count_if("scanner").alias("probes"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.grouping_id().alias("g"),
    )
    rows = F.array(
        F.when(F.col("g") == 7, F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("n"), F.col("limited"))),
        F.when(F.col("g") == 7, F.struct(F.lit("server_errors").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("errors").alias("n"), F.lit(0).cast("long").alias("limited"))),
        F.when(F.col("g") == 3, F.struct(F.lit("status").alias("kind"), F.col("status").cast("string").alias("key"), F.col("n"), F.col("limited"))),
        F.when(F.col("g") == 5, F.struct(F.lit("ip").alias("kind"), F.col("ip").alias("key"), F.col("n"), F.col("limited"))),
        F.when((F.col("g") == 5) & (F.col("probes") > 0), F.struct(F.lit("scanner").alias("kind"), F.col("ip").alias("key"), F.col("probes").alias("n"), F.lit(0).cast("long").alias("limited"))),
        F.when((F.col("g") == 6) & (F.col("missed") > 0), F.struct(F.lit("missed").alias("kind"), F.col("path").alias("key"), F.col("missed").alias("n"), F.lit(0).cast("long").alias("limited"))),
    )
    return cube.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def top_of(summary: DataFrame, kind: str, k: int) -> DataFrame:
    return summary.filter(F.col("kind") == kind).orderBy(F.desc("n"), F.asc("key")).limit(k)


def access_alerts(summary: DataFrame, thresholds: dict[str, int] = THRESHOLDS) -> DataFrame:
    """(finding, key, n): totals of refused and missed requests, and ips that probe or send much, at their thresholds."""
    pick = lambda finding, where, least: summary.filter(where & (F.col("n") >= least)).select(F.lit(finding).alias("finding"), "key", "n")
    limited = pick("rate_limited", (F.col("kind") == "status") & (F.col("key") == "429"), thresholds["rate_limited"])
    missed = pick("not_found", (F.col("kind") == "status") & (F.col("key") == "404"), thresholds["not_found"])
    probes = pick("scanner", F.col("kind") == "scanner", thresholds["scanner"])
    busy = pick("busy", F.col("kind") == "ip", thresholds["busy"])
    return limited.unionByName(missed).unionByName(probes).unionByName(busy)
