"""Streams: daily counters of access logs, and editions compared as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import scanner_path
from ..operators.versions import Master
from ..sources.files import LOG

#: A batch applies fewer than 2^STEPS editions; its steps follow those of the batch before.
STEPS = 16


def read_access_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).json(path)


def access_stream(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(start, status, n, probes) by day of Tokyo, which begins at 15:00 UTC."""
    timed = log.filter("ts IS NOT NULL AND status IS NOT NULL").withColumn("at", F.timestamp_millis((F.col("ts") * 1000).cast("long")))
    uri = F.substring_index(F.coalesce("request.uri", F.lit("-")), "?", 1)
    marked = timed.withColumn("scanner", scanner_path(uri)).withWatermark("at", late).observe("arrived", F.count("*").alias("n"))
    counted = marked.groupBy(F.window("at", "1 day", startTime="15 hours"), "status").agg(F.sum(F.lit(1)).alias("n"), F.count_if("scanner").alias("probes"))
    return counted.select(F.col("window.start").alias("start"), "status", "n", "probes")


def open_entries(spark: SparkSession, checkpoint: str) -> int:
    """How many entries the days hold that are not closed yet, from the state that the last batch left."""
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    if not commits.getFileSystem(spark._jsc.hadoopConfiguration()).exists(commits):
        return 0
    state = spark.read.format("statestore").load(checkpoint)
    return state.agg(F.sum("value.sum")).head()[0] or 0


def run_access_days(log: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> dict[str, int]:
    """Runs over the entries that have arrived; a day goes to ``path`` once, when no entry of it is awaited any more.

    Returns how many entries of this run arrived, were closed with their day,
    are held in open days, and came too late for their day, which are those that
    are in no day: arrived + held before - closed - held now.
    """
    spark = log.sparkSession
    before = open_entries(spark, checkpoint)
    days = access_stream(log, late).observe("closed", F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    query = days.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    seen: dict[int, dict[str, int]] = {}

    def note() -> None:
        for p in query.recentProgress:
            found = {name: row["n"] or 0 for name, row in p.observedMetrics.items()}
            if found:
                seen[p.batchId] = found

    while not query.awaitTermination(1):
        note()
    note()
    total = lambda name: sum(p.get(name, 0) for p in seen.values())
    held = open_entries(spark, checkpoint)
    return {"arrived": total("arrived"), "closed": total("closed"), "held": held, "late": total("arrived") + before - total("closed") - held}


def complete_editions(files: DataFrame, expected: DataFrame, edition: list[str]) -> DataFrame:
    """Editions of which as many parts arrived as are expected."""
    have = files.groupBy(*edition).agg(F.count_distinct("part").alias("have"))
    return have.join(expected, edition).filter("have = parts").select(*edition)


def run_snapshots(parts: DataFrame, expected: DataFrame, master: Master, seen_at, checkpoint: str):
    """Compares editions with the master as their parts arrive; ``parts`` is a stream of rows with download_id, published_on and part.

    ``expected`` (download_id, parts) says when an edition is whole; rows of
    others wait in ``waiting/n``, which also commits batch n.  A batch that is
    run again after a failure skips the editions that it committed, goes on
    with the others, and does nothing if all of it was done.  What batches before
    the last one left waiting is removed.
    """
    store = master.root

    def apply(batch: DataFrame, n: int) -> None:
        if master.is_whole(f"waiting/{n}"):
            return
        spark = batch.sparkSession
        before = spark.read.schema(batch.schema).parquet(f"{store}/waiting/{n - 1}") if n else batch.limit(0)
        batch.unionByName(before).write.mode("overwrite").parquet(f"{store}/arrived/{n}")
        arrived = spark.read.schema(batch.schema).parquet(f"{store}/arrived/{n}")
        dates = arrived.groupBy("download_id").agg(F.min("published_on").alias("published_on"))
        whole = complete_editions(arrived, expected, ["download_id"]).join(dates, "download_id")
        done = whole.orderBy("published_on", "download_id").collect()  # a row for each edition of this batch
        for at, e in enumerate(done, 1):
            rows = arrived.filter(F.col("download_id") == e["download_id"])
            master.apply((n << STEPS) + at, rows, e["download_id"], e["published_on"], seen_at)
        rest = arrived.filter(~F.col("download_id").isin([e["download_id"] for e in done])) if done else arrived
        rest.write.mode("overwrite").parquet(f"{store}/waiting/{n}")
        master.remove(f"arrived/{n}")
        if n > 1:
            master.remove(f"waiting/{n - 2}")

    return snapshot_stream(parts, apply, checkpoint)


def snapshot_stream(editions: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``apply(edition rows, batch id)`` for each micro-batch of whole editions; batch ids make its writes repeatable."""
    return editions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
