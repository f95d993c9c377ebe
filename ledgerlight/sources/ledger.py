"""The ledger of downloads: editions, links, guards, and when a report is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_DAYS = 45


def current_editions(ledger: DataFrame, source: list[str], edition: str = "published_on", superseded: str | None = "superseded_at") -> DataFrame:
    """Rows of the newest edition of each source that is not superseded; several can be current at once."""
    live = ledger.filter(F.col(superseded).isNull()) if superseded else ledger
    newest = live.groupBy(*source).agg(F.max(edition).alias("_last")).select(*[F.col(c).alias(f"_{c}") for c in source], "_last")
    same = F.col(edition) == F.col("_last")
    for c in source:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return live.join(newest, same, "left_semi")  # a row for each source, so no source falls to one task


def new_links(links: DataFrame, ledger: DataFrame, key: tuple[str, ...] = ("bureau_code", "category", "filename", "published_on")) -> DataFrame:
    return links.join(ledger.select(*key), list(key), "left_anti")


def supersede_replaced(ledger: DataFrame, links: DataFrame, at) -> DataFrame:
    """The ledger with files marked that a link of the same date and prefectures replaced, and marks taken from those linked again.

    A file linked again is to be imported again.
    """
    source, covers = ["bureau_code", "category", "published_on"], F.array_join(F.array_sort("prefecture_codes"), ",")
    linked = links.select(*source, "filename", covers.alias("_covers"))
    here = linked.select(*source, "filename").distinct().withColumn("_linked", F.lit(True))
    other = linked.select(*source, "_covers").distinct().withColumn("_covered", F.lit(True))
    both = ledger.withColumn("_covers", covers).join(here, [*source, "filename"], "left").join(other, [*source, "_covers"], "left")
    back = F.col("_linked") & F.col("superseded_at").isNotNull()
    gone = F.col("_linked").isNull() & F.coalesce("_covered", F.lit(False)) & F.col("superseded_at").isNull()
    kinds = dict(ledger.dtypes)
    marked = F.when(back, F.lit(None)).when(gone, F.lit(at)).otherwise(F.col("superseded_at")).cast(kinds["superseded_at"])
    imported = F.when(back, F.lit(None)).otherwise(F.col("imported_at")).cast(kinds["imported_at"])
    return both.withColumns({"imported_at": imported, "superseded_at": marked}).select(*ledger.columns)


def mark_imported(ledger: DataFrame, downloads: list[int], skipped: int, at) -> DataFrame:
    """Sets the time of import for a run's downloads, if it skipped no row."""
    if skipped:
        return ledger
    return ledger.withColumn("imported_at", F.when(F.col("id").isin(downloads), F.lit(at)).otherwise(F.col("imported_at")).cast(dict(ledger.dtypes)["imported_at"]))


def due_sources(ledger: DataFrame, source: list[str], force: bool = False) -> DataFrame:
    """Sources of which a current download is not imported yet (all, if forced)."""
    current = current_editions(ledger, source).groupBy(*source).agg(F.bool_and(F.col("imported_at").isNotNull()).alias("done"))
    return current.filter(F.lit(force) | ~F.col("done")).select(*source)


def guard_min_rows(rows: DataFrame, least: int) -> DataFrame:
    """The rows, or an error if they are fewer than a source always has."""
    n = rows.limit(least).count() if least else 0
    if n < least:
        raise ValueError(f"{n} rows are fewer than {least}; the table is kept as it is")
    return rows


def newer_edition_only(rows: DataFrame, current: DataFrame, edition: str = "as_of", force: bool = False) -> DataFrame:
    """The rows if their edition is newer than the current one, else none."""
    last = current.agg(F.max(edition).alias("_last"))
    return rows.crossJoin(F.broadcast(last)).filter(F.lit(force) | F.col("_last").isNull() | (F.col(edition) > F.col("_last"))).drop("_last")  # one row


def newest_complete(files: DataFrame, required: list[str], date: str = "published_on", dataset: str = "dataset") -> DataFrame:
    """(date) the newest date for which every required file exists."""
    whole = files.filter(F.col(dataset).isin(required)).groupBy(date).agg(F.count_distinct(dataset).alias("n")).filter(F.col("n") == len(required))
    return whole.agg(F.max(date).alias(date))


def freshness_report(current: DataFrame, grid: DataFrame, source: list[str], today, days: int = STALE_DAYS) -> DataFrame:
    """(source, problems) of sources that are missing, not imported, or older than so many days."""
    state = current.groupBy(*source).agg(F.max("published_on").alias("published_on"), F.bool_and(F.col("imported_at").isNotNull()).alias("imported"))
    both = grid.join(state, source, "left")
    age = F.datediff(F.lit(today).cast("date"), "published_on")
    problems = F.array_compact(F.array(F.when(F.col("published_on").isNull(), "missing"), F.when(~F.col("imported"), "not imported"), F.when(age > days, "stale")))
    return both.select(*source, F.array_join(problems, ",").alias("problems")).filter("problems <> ''")


def missing_categories(expected: DataFrame, found: DataFrame, source: list[str]) -> DataFrame:
    return expected.select(*source).distinct().join(found.select(*source), source, "left_anti")


def union_editions(editions: list[DataFrame]) -> DataFrame:
    out = editions[0]
    for e in editions[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def load_seed(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows upserted by key, the last of equal keys; rows that are not listed any more remain."""
    values = [c for c in table.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "ord").alias("v")).select(*key, "v.*").select(*table.columns)
    return table.join(last.select(*key), key, "left_anti").select(*table.columns).unionByName(last)
