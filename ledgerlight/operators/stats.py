"""Counts by month, area and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_MONTHS = 60


def month_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """``month`` from first to last (both YYYY-MM), without gaps."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}-01', date'{last}-01', interval 1 month)")).alias("at")).select(F.date_format("at", "yyyy-MM").alias("month"))


def count_by_month(rows: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """(month, count) for every month of the range, oldest first; months without rows count 0."""
    spine = month_spine(rows.sparkSession, first, last)
    months = (int(last[:4]) - int(first[:4])) * 12 + int(last[5:]) - int(first[5:]) + 1
    if not 1 <= months <= MOST_MONTHS:
        raise ValueError(f"1 to {MOST_MONTHS} months can be counted")
    until = F.add_months(F.lit(f"{last}-01").cast("date"), 1)
    inside = rows.filter((F.col(date) >= F.lit(f"{first}-01").cast("timestamp")) & (F.col(date) < until.cast("timestamp")))
    counted = inside.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    joined = spine.join(counted, "month", "left")
    return joined.select("month", F.coalesce("n", F.lit(0)).cast("long").alias("count")).orderBy("month")


def count_by_area(rows: DataFrame, code: str, areas: DataFrame, population: DataFrame) -> DataFrame:
    """(code, name, count, population, per_10000), largest first; ``areas`` (code, name), ``population`` (code, population).

    Rows without a code are one group; the rate is null where the population is
    unknown or 0.
    """
    counted = rows.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("count"))
    joined = counted.join(areas.select("code", "name"), "code", "left").join(population.select("code", "population"), "code", "left")
    rate = F.when(F.col("population") > 0, F.round(F.col("count") * 10000 / F.col("population"), 2))
    return joined.withColumn("per_10000", rate).orderBy(F.desc("count"), F.asc_nulls_first("code"))


def count_by_category(rows: DataFrame, categories: str = "department_categories") -> DataFrame:
    """(category, count): a row counts in each of its categories."""
    return rows.select(F.explode(categories).alias("category")).groupBy("category").agg(F.count("*").alias("count")).orderBy("category")


def totals(rows: DataFrame, population: DataFrame) -> DataFrame:
    """(total, population_as_of)."""
    return rows.agg(F.count("*").alias("total")).crossJoin(population.agg(F.max("as_of").alias("population_as_of")))


def events_by_month(events: DataFrame, first: str, last: str) -> DataFrame:
    return count_by_month(events, "occurred_on", first, last)


def events_by_area(events: DataFrame, facilities: DataFrame, key: list[str], areas: DataFrame) -> DataFrame:
    """(code, name, count) of events by the municipality of their facility, largest first."""
    placed = events.join(facilities.select(*key, F.col("municipality_code").alias("code")), key)
    counted = placed.groupBy("code").agg(F.count("*").alias("count")).join(areas.select("code", "name"), "code", "left")
    return counted.orderBy(F.desc("count"), F.asc_nulls_first("code"))


def level_report(rows: DataFrame, level: str, levels: list[int]) -> DataFrame:
    """(level, count) for every level and for null, also where nothing counts."""
    spark = rows.sparkSession
    spine = spark.createDataFrame([(v,) for v in [*levels, None]], "level int")
    counted = rows.groupBy(F.col(level).cast("int").alias("found")).agg(F.count("*").alias("n"))
    return spine.join(counted, F.col("level").eqNullSafe(F.col("found")), "left").select("level", F.coalesce("n", F.lit(0)).alias("count"))
