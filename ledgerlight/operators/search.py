"""Filters, order and pages of searches."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine, in_box
from ..functions.text import search_words


def filter_facilities(rows: DataFrame, **equal) -> DataFrame:
    """Rows equal in all given columns; a list means any of it, a missing or empty value no filter."""
    for column, value in equal.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.filter(F.col(column).isin(*value)) if value else rows
        elif value is not None and value != "":
            rows = rows.filter(F.col(column) == value)
    return rows


def has_category(rows: DataFrame, category: int) -> DataFrame:
    return rows.filter(F.array_contains("department_categories", category))


def has_reason(rows: DataFrame, reason: str) -> DataFrame:
    return rows.filter(F.exists("designation_history", lambda h: h["reason"] == reason))


def in_dates(rows: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Both ends belong to the range."""
    rows = rows.filter(F.col(column) >= F.lit(since)) if since else rows
    return rows.filter(F.col(column) <= F.lit(until)) if until else rows


def e_prescribes(rows: DataFrame, wanted: bool) -> DataFrame:
    started = F.col("e_prescription_started_on")
    return rows.filter(started.isNotNull() if wanted else started.isNull())


def has_words(rows: DataFrame, query: str, columns: list[str], most: int = 5, normalized: bool = False) -> DataFrame:
    """Rows in which each word of the query is part of one of the columns, whatever its case and width.

    Columns that hold normalized text (NFKC, as facilities carry it beside the
    text) are searched as they are; others by a collation, which costs more.
    """
    for word in search_words(query, most):
        hit = F.lit(False)
        for c in columns:
            if normalized:
                hit = hit | F.contains(F.lower(c), F.lit(unicodedata.normalize("NFKC", word).lower()))
            else:
                hit = hit | F.contains(F.collate(F.col(c), "UNICODE_CI"), F.collate(F.lit(word), "UNICODE_CI"))
        rows = rows.filter(hit)
    return rows


#: Lengths of the runs of characters by which words are looked up.
GRAMS = (1, 2)


def grams_of(text: Column) -> Column:
    """The distinct runs of one and of two characters of a text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.concat(chars, pairs))


def write_word_index(rows: DataFrame, key: str, columns: list[str], path: str, blocks: int = 64) -> None:
    """Writes ``rows`` in blocks, and postings (gram, block, key) in the order of grams, for ``indexed_words``.

    ``columns`` hold normalized text.  Postings are as many as the texts have
    distinct pairs of characters: for names and addresses, not for long texts.
    """
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block")
    rows.select("*", block).hint("rebalance", "_block").write.mode("overwrite").partitionBy("_block").parquet(f"{path}/rows")
    texts = F.flatten(F.array(*[grams_of(F.lower(F.coalesce(c, F.lit("")))) for c in columns]))
    postings = rows.select(F.col(key), block, F.explode(F.array_distinct(texts)).alias("gram"))
    postings.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/grams")


def indexed_words(spark: SparkSession, path: str, query: str, key: str, columns: list[str], most: int = 5) -> DataFrame:
    """The rows of a word index in which each word of the query is part of one of the columns.

    Rows that have all runs of characters of the words are proposed by the
    postings, whose filter reaches the scan; only blocks with a proposed row are
    read, and each proposed row is looked at for the words themselves.
    """
    words = [unicodedata.normalize("NFKC", w).lower() for w in search_words(query, most)]
    grams = sorted({w[i : i + n] for w in words for n in GRAMS for i in range(len(w) - n + 1) if n == min(max(GRAMS), len(w))})
    stored = spark.read.parquet(f"{path}/rows")
    if not grams:
        return stored.drop("_block")
    proposed = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(grams)).groupBy("_block", key).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    blocks = [r["_block"] for r in proposed.select("_block").distinct().collect()]  # no more than there are blocks
    near = stored.filter(F.col("_block").isin(blocks)).join(proposed.select("_block", key), ["_block", key], "left_semi")
    return has_words(near, query, columns, most, normalized=True).drop("_block")


def nearby(rows: DataFrame, lat: float, lon: float, metres: float = 1000, at: tuple[str, str] = ("latitude", "longitude")) -> DataFrame:
    """Rows within a radius, with ``distance``; the box around it comes first."""
    y, x = F.col(at[0]), F.col(at[1])
    boxed = rows.filter(in_box(y, x, lat, lon, metres))
    return boxed.withColumn("distance", haversine(y, x, F.lit(lat), F.lit(lon))).filter(F.col("distance") <= metres)


def _order(by: str, unique: str) -> list[Column]:
    down, name = by.startswith("-"), by.lstrip("-")
    first = F.desc_nulls_last(name) if down else F.asc_nulls_first(name)
    return [first] if name == unique else [first, F.asc(unique)]


def sort_facilities(rows: DataFrame, by: str = "id", unique: str = "id") -> DataFrame:
    """By a column, ``-`` in front for falling, nulls lowest; the unique column breaks ties."""
    return rows.orderBy(*_order(by, unique))


def page(rows: DataFrame, number: int = 1, per_page: int = 25, by: str = "id", unique: str = "id", deepest: int = 10_000, most: int = 100) -> DataFrame:
    if not 1 <= per_page <= most or number < 1 or number * per_page > deepest:
        raise ValueError("the page is out of bounds")
    return sort_facilities(rows, by, unique).offset((number - 1) * per_page).limit(per_page)


def after_cursor(by: str, unique: str, cursor: tuple) -> Column:
    """Whether a row comes after a cursor (values of ``by`` and the unique column), nulls first.

    The bound on ``by`` alone stands in front, as a condition that scans can take.
    """
    if by == unique:
        return F.col(unique) > F.lit(cursor[-1])
    first, last = F.lit(cursor[0]), F.lit(cursor[1])
    if cursor[0] is None:
        return F.col(by).isNotNull() | (F.col(unique) > last)
    return (F.col(by) >= first) & ((F.col(by) > first) | (F.col(unique) > last))


def page_after(rows: DataFrame, cursor: tuple | None, per_page: int = 25, by: str = "id", unique: str = "id") -> DataFrame:
    """The rows after a cursor, which is the last row's values of ``by`` and the unique column."""
    if cursor is not None:
        rows = rows.filter(after_cursor(by, unique, cursor))
    return rows.orderBy(*dict.fromkeys([by, unique])).limit(per_page)


def write_ordered(rows: DataFrame, path: str, by: str, unique: str, group_bytes: int = 8 << 20) -> None:
    """Writes rows in the order of pages: files of ranges, each in order, so that a page's bound skips all row groups before it by their statistics.

    Times are written as microseconds, as the older form of them has no statistics.
    """
    conf, form = rows.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    order = [F.asc_nulls_first(c) for c in dict.fromkeys([by, unique])]
    before = conf.get(form)
    conf.set(form, "TIMESTAMP_MICROS")
    try:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)
    finally:
        conf.set(form, before)


def capped_count(rows: DataFrame, cap: int = 10_001) -> DataFrame:
    """(total, is_capped): counting stops at the cap."""
    counted = rows.select(F.lit(1).alias("one")).limit(cap).agg(F.count("one").alias("total"))
    return counted.withColumn("is_capped", F.col("total") >= cap)


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k commonest values of a column with their counts, ties by value."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)
