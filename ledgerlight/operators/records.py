"""Records of several sheet rows, and their mapping to typed rows.

Input rows are (unit, row_no, cells); a record is the run of rows from one with
digits in its first cell to the next such row of the same unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CATEGORY_TYPES, CLINIC, DENTAL, DENTISTRY, HOSPITAL, PHARMACY, SUSPENDED, TYPE_DIGITS, ACTIVE
from ..functions.text import category_of, era_date, replace_private_use


def record_numbers(rows: DataFrame, start: Column, unit: list[str], order: list[str]) -> DataFrame:
    """Rows with ``record``, the number of starts so far in the unit; rows before the first start go."""
    upto = Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("record", F.sum(F.when(start, 1).otherwise(0)).over(upto).cast("int")).filter("record > 0")


def group_records(rows: DataFrame) -> DataFrame:
    """(unit, record, row_no, cells): one row per record, ``cells`` an array of its rows' cells in order."""
    started = record_numbers(rows, F.get("cells", F.lit(0)).rlike("^[0-9]+$"), ["unit"], ["row_no"])
    held = F.array_sort(F.collect_list(F.struct("row_no", "cells")))
    return started.groupBy("unit", "record").agg(F.min("row_no").alias("row_no"), held.alias("held")).select(
        "unit", "record", "row_no", F.transform("held", lambda h: h["cells"]).alias("cells")
    )


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")


def column_of(cells: Column, at: int) -> Column:
    """The trimmed values of one column over the record's rows; missing cells are empty."""
    return F.transform(cells, lambda r: _trim(F.coalesce(F.get(r, F.lit(at)), F.lit(""))))


def designation(values: Column) -> Column:
    """struct<designated_on, history>: the first value's date, then reasons and dates paired as they follow each other."""
    filled = F.filter(values, lambda v: v != "")
    rest = F.slice(filled, 2, F.greatest(F.size(filled) - 1, F.lit(0)))
    label = lambda v: era_date(v).isNull()

    def entry(v: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(rest, i - 1))
        after = F.get(rest, i + 1)
        reason = F.when(before.isNotNull() & label(before), before)
        dated = F.struct(reason.alias("reason"), era_date(v).alias("date"))
        alone = F.struct(v.alias("reason"), F.lit(None).cast("date").alias("date"))
        return F.when(~label(v), dated).when(after.isNull() | label(after), alone)

    history = F.filter(F.transform(rest, entry), lambda e: e.isNotNull())
    return F.struct(F.when(F.size(filled) > 0, era_date(F.get(filled, F.lit(0)))).alias("designated_on"), history.alias("history"))


def beds_and_departments(values: Column) -> Column:
    """struct<beds map, tokens>: lines with a digit give bed counts by label, summed; the others department names."""
    lines = F.filter(F.transform(values, lambda v: F.filter(F.transform(F.split(v, "　"), _trim), lambda t: t != "")), lambda ts: F.size(ts) > 0)
    counted = lambda ts: F.exists(ts, lambda t: t.rlike("[0-9]"))
    number = lambda t: t.rlike("^[0-9]+$")
    both = r"^([^0-9]+?)\s*([0-9]+)$"

    def pairs(ts: Column) -> Column:
        def pair(t: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ts, i - 1))
            waits = before.isNotNull() & ~number(before) & ~before.rlike(both)
            entry = lambda k, n: F.struct(k.alias("label"), n.cast("int").alias("n"))
            return F.when(number(t), F.when(waits, entry(before, t))).when(
                t.rlike(both), entry(F.regexp_extract(t, both, 1), F.regexp_extract(t, both, 2))
            )

        return F.filter(F.transform(ts, pair), lambda e: e.isNotNull())

    found = F.flatten(F.transform(F.filter(lines, counted), pairs))
    labels = F.array_distinct(F.transform(found, lambda e: e["label"]))
    total = lambda k: F.aggregate(F.filter(found, lambda e: e["label"] == k), F.lit(0), lambda s, e: s + e["n"])
    beds = F.map_from_arrays(labels, F.transform(labels, total))
    return F.struct(beds.alias("beds"), F.flatten(F.filter(lines, lambda ts: ~counted(ts))).alias("tokens"))


def categories_of(tokens: Column) -> Column:
    """The sorted distinct categories of the tokens; a token without marker has none."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: category_of(t)), lambda c: c.isNotNull())))


def institution_code(prefecture: Column, kind: Column, code: Column) -> Column:
    digit = F.lit(None).cast("string")
    for t, d in TYPE_DIGITS.items():
        digit = F.when(kind == t, d).otherwise(digit)
    return F.concat(prefecture, digit, code)


def map_records(records: DataFrame, category: Column) -> DataFrame:
    """Typed rows of grouped records; ``_error`` says what keeps a row from being whole, and is null else.

    ``category`` is the list's (1 medical, 2 dental, 3 pharmacy), a column of
    the records or a literal.
    """
    clean = F.transform("cells", lambda r: F.transform(r, lambda c: replace_private_use(F.coalesce(c, F.lit("")))))
    base = records.withColumn("cells", clean).withColumn("category", category)
    first = lambda i: F.get(column_of(F.col("cells"), i), F.lit(0))
    postal = r"^〒([0-9]{3})－([0-9]{4})(.*)$"
    code = F.regexp_replace(first(1), "[^0-9]", "")
    phone = F.regexp_replace(F.regexp_replace(first(4), r"^([0-9]+)\(([0-9]+)\)([0-9]+)$", "$1-$2-$3"), "-{2,}", "-")
    states = column_of(F.col("cells"), 9)
    typed = F.filter(states, lambda v: v.rlike("病院|診療所|薬局"))
    last = F.get(F.reverse(typed), F.lit(0))
    label = F.when(last.contains("病院"), "病院").when(last.contains("診療所"), "診療所").when(last.contains("薬局"), "薬局")
    kind = (
        F.when(F.col("category") == 2, DENTAL)
        .when(F.col("category") == 3, PHARMACY)
        .when(label == "病院", HOSPITAL)
        .when(label == "診療所", CLINIC)
    )
    dated = designation(column_of(F.col("cells"), 7))
    beds = beds_and_departments(column_of(F.col("cells"), 8))
    step = base.withColumns({"_dated": dated, "_beds": beds, "_type": kind, "_code": code})
    tokens = F.col("_beds.tokens")
    none = F.array().cast("array<int>")
    departments = (
        F.when(F.col("category") == 2, F.when(F.size(tokens) > 0, F.array(F.lit(DENTISTRY))).otherwise(none))
        .when(F.col("category") == 3, none)
        .otherwise(categories_of(tokens))
    )
    first_date = F.get(F.filter(column_of(F.col("cells"), 7), lambda v: v != ""), F.lit(0))
    error = F.concat_ws(
        "; ",
        F.when(F.length("_code") != 7, "facility code"),
        F.when(~first(3).rlike(postal), "address"),
        F.when(F.col("_type").isNull(), "institution type"),
        F.when(first_date.isNotNull() & F.col("_dated.designated_on").isNull(), "designation date"),
    )
    return step.select(
        "unit",
        "row_no",
        F.col("_code").alias("facility_code"),
        F.col("_type").alias("institution_type"),
        F.when(F.exists(states, lambda v: v == "休止"), SUSPENDED).otherwise(ACTIVE).alias("status"),
        first(2).alias("name"),
        F.concat_ws("-", F.regexp_extract(first(3), postal, 1), F.regexp_extract(first(3), postal, 2)).alias("postal_code"),
        _trim(F.regexp_extract(first(3), postal, 3)).alias("address"),
        F.nullif(phone, F.lit("")).alias("phone_number"),
        F.nullif(first(5), F.lit("")).alias("founder_name"),
        F.nullif(first(6), F.lit("")).alias("administrator_name"),
        F.col("_dated.designated_on").alias("designated_on"),
        F.col("_dated.history").alias("designation_history"),
        F.col("_beds.beds").alias("bed_counts"),
        departments.alias("department_categories"),
        F.nullif(error, F.lit("")).alias("_error"),
    )


def split_errors(mapped: DataFrame, fail: bool = True) -> tuple[DataFrame, DataFrame]:
    """(whole rows, rows with an error); with ``fail`` the first error ends the job that reads the whole rows."""
    good = mapped.filter("_error IS NULL").drop("_error")
    bad = mapped.filter("_error IS NOT NULL")
    if fail:
        checked = mapped.withColumn("_stop", F.when(F.col("_error").isNotNull(), F.raise_error(F.concat_ws(": ", F.col("unit").cast("string"), F.col("row_no").cast("string"), "_error"))))
        good = checked.filter("_stop IS NULL").drop("_stop", "_error")
    return good, bad


def types_of_category(category: int) -> tuple[int, ...]:
    return CATEGORY_TYPES[category]


def recompute_derived(facilities: DataFrame, derive: dict[str, Column]) -> DataFrame:
    """Derived columns anew, without touching ``updated_at``; ``_changed`` marks rows in which one differs."""
    fresh = facilities.select("*", *[c.alias(f"_new_{k}") for k, c in derive.items()])
    changed = F.lit(False)
    for k in derive:
        changed = changed | ~F.col(k).eqNullSafe(F.col(f"_new_{k}"))
    marked = fresh.withColumn("_changed", changed)
    return marked.withColumns({k: F.col(f"_new_{k}") for k in derive}).drop(*[f"_new_{k}" for k in derive])
