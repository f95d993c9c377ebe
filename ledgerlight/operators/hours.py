"""Weekly opening hours: from wide source rows to merged periods, and questions about moments and arrivals.

Times of day are seconds (24:00 is 86400) or, while periods are built, minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ALL_WEEKS, DAY_NUMBERS, DAYS, HOLIDAY
from ..functions.geo import travel_minutes
from ..functions.text import address_key, clean_url, kana_reading, name_key

ZONE = "Asia/Tokyo"
DAY_SECONDS = 86_400


def clock(value: Column) -> Column:
    """A time of day HH:MM up to 24:59; null for all else."""
    return F.when(value.rlike("^([01][0-9]|2[0-4]):[0-5][0-9]$"), value)


def minutes(value: Column) -> Column:
    parts = F.split(value, ":")
    return F.get(parts, F.lit(0)).cast("int") * 60 + F.get(parts, F.lit(1)).cast("int")


def locations_from_source(rows: DataFrame, columns: dict[str, str], institution_type: Column, variants: dict[str, str] | None = None) -> DataFrame:
    """Typed locations of a source's rows, with keys for matching, reading, website and closures; rows without id, name or codes go.

    ``columns`` gives the source's names of id, name, prefecture, municipality,
    address, latitude, longitude, and where it has them kana, website, and
    holiday, other, and the flags ``weekly_<day>`` and ``monthly_<week>_<day>``.
    A position is null unless both of its numbers are there and not 0.
    """
    at = lambda n: F.col(f"`{columns[n]}`") if n in columns else F.lit(None).cast("string")
    number = lambda n: F.coalesce(at(n).try_cast("double"), F.lit(0.0))
    placed = (number("latitude") != 0.0) & (number("longitude") != 0.0)
    place = lambda n: F.when(placed, at(n).try_cast("decimal(10,6)"))
    code = F.concat(*[F.when(F.length(at(n)) < w, F.lpad(at(n), w, "0")).otherwise(at(n)) for n, w in (("prefecture", 2), ("municipality", 3))])
    weekly = {n.removeprefix("weekly_"): at(n) for n in columns if n.startswith("weekly_")}
    monthly = {(int(n.split("_")[1]), n.split("_")[2]): at(n) for n in columns if n.startswith("monthly_")}
    whole = F.lit(True)
    for n in ("id", "name", "prefecture", "municipality"):
        whole = whole & (F.coalesce(at(n), F.lit("")) != "")
    return rows.filter(whole).select(
        at("id").alias("source_id"), institution_type.alias("institution_type"), code.alias("municipality_code"), at("name").alias("name"),
        at("address").alias("address"), place("latitude").alias("latitude"), place("longitude").alias("longitude"),
        name_key(at("name"), variants).alias("name_key"), address_key(F.coalesce(at("address"), F.lit("")), variants).alias("address_key"),
        kana_reading(at("kana")).alias("name_kana"), clean_url(at("website")).alias("website_url"),
        closures(weekly, monthly, at("holiday"), at("other")).alias("closures"),
    )


def unpivot_hours(rows: DataFrame, key: list[str], kinds: dict[str, str], days: dict[str, str] | None = None) -> DataFrame:
    """One row per key and day with a time: (key, day, and each of ``kinds``); source columns are named day_suffix.

    ``kinds`` maps each output column to its source suffix; times that are none
    become null, and days without any time go.
    """
    entries = []
    for prefix, day in (days or DAYS).items():
        values = [clock(F.col(f"`{prefix}_{suffix}`")).alias(name) if f"{prefix}_{suffix}" in rows.columns else F.lit(None).cast("string").alias(name) for name, suffix in kinds.items()]
        entries.append(F.struct(F.lit(day).alias("day"), *values))
    long = rows.select(*key, F.explode(F.array(*entries)).alias("e")).select(*key, "e.*")
    return long.filter(F.coalesce(*[F.col(n) for n in kinds]).isNotNull())


def group_equal_schedules(slots: DataFrame, key: list[str], department: str, slot: Column, order: str) -> DataFrame:
    """(key, slots, departments): departments of one key with the same list of slots together."""
    listed = slots.groupBy(*key, department).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), slot.alias("slot")))).alias("_slots"))
    text = F.to_json(F.transform("_slots", lambda s: s["slot"]))
    return listed.withColumn("slots", text).groupBy(*key, "slots").agg(F.array_sort(F.collect_list(department)).alias("departments"))


def closures(weekly: dict[str, Column], monthly: dict[tuple[int, str], Column], holiday: Column, other: Column) -> Column:
    """struct<weekly, monthly, holidays, other> from flags (1 open, 0 closed); null if nothing is given."""
    none = "array<struct<week:int,day:string,flag:string>>"
    closed = F.filter(F.array(*[F.struct(F.lit(0).alias("week"), F.lit(d).alias("day"), c.alias("flag")) for d, c in weekly.items()]).cast(none), lambda e: e["flag"] == "0")
    days = F.transform(closed, lambda e: e["day"])
    nth = F.filter(
        F.array(*[F.struct(F.lit(w).alias("week"), F.lit(d).alias("day"), c.alias("flag")) for (w, d), c in monthly.items()]).cast(none),
        lambda e: (e["flag"] == "0") & ~F.array_contains(days, e["day"]),
    )
    text = F.trim(F.coalesce(other, F.lit("")))
    flags = F.concat_ws("", F.lit(""), *[F.coalesce(c, F.lit("")) for c in (*weekly.values(), *monthly.values())])
    made = F.struct(
        days.alias("weekly"),
        F.transform(nth, lambda e: F.struct(e["week"].alias("week"), e["day"].alias("day"))).alias("monthly"),
        F.when(holiday == "0", True).when(holiday == "1", False).alias("holidays"),
        F.nullif(F.replace(text, F.lit("（改行）"), F.lit("\n")), F.lit("")).alias("other"),
    )
    given = (flags != "") | (F.coalesce(holiday, F.lit("")) != "") | (text != "")
    return F.when(given, made)


def day_number(day: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in DAY_NUMBERS.items():
        out = F.when(day == name, n).otherwise(out)
    return out


def opening_windows(entries: DataFrame, key: list[str], schedule: str) -> DataFrame:
    """(key, day, opens, closes) in minutes: of each schedule and day the reception times if there are any, else the hours."""
    pair = lambda a, b, r: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(minutes(F.col(a)).alias("opens"), minutes(F.col(b)).alias("closes"), F.lit(r).alias("reception")))
    both = F.filter(F.array(pair("reception_opens", "reception_closes", 1), pair("opens", "closes", 0)), lambda w: w.isNotNull())
    long = entries.select(*key, schedule, day_number(F.col("day")).alias("day"), F.explode(both).alias("w")).select(*key, schedule, "day", "w.*")
    best = F.max("reception").over(Window.partitionBy(*key, schedule, "day"))
    return long.withColumn("_best", best).filter("reception = _best").select(*key, "day", "opens", "closes")


def split_overnight(windows: DataFrame, whole: int = 1440) -> DataFrame:
    """Windows past midnight as two, the second on the next day; a holiday's second part and windows without length go."""
    opens, closes, day = F.col("opens"), F.col("closes"), F.col("day")
    part = lambda d, a, b: F.struct(d.cast("int").alias("day"), a.cast("int").alias("opens"), b.cast("int").alias("closes"))
    late = F.when((day != HOLIDAY) & (closes > 0), F.array(part(day, opens, F.lit(whole)), part(day % 7 + 1, F.lit(0), closes))).otherwise(F.array(part(day, opens, F.lit(whole))))
    parts = F.when(closes > opens, F.array(part(day, opens, closes))).when(closes < opens, late)
    rest = [c for c in windows.columns if c not in ("day", "opens", "closes")]
    return windows.select(*rest, F.explode(parts).alias("p")).select(*rest, "p.*")


def apply_closures(windows: DataFrame, key: list[str], weekly: DataFrame, monthly: DataFrame) -> DataFrame:
    """Windows without closed days (``weekly``: key, day), with ``weeks``, the open weeks of the month as bits (``monthly``: key, day, week)."""
    masks = monthly.groupBy(*key, "day").agg(F.bit_or(F.pow(F.lit(2), F.col("week") - 1).cast("int")).alias("_closed"))
    left = windows.join(weekly.select(*key, "day").distinct(), [*key, "day"], "left_anti").join(masks, [*key, "day"], "left")
    return left.withColumn("weeks", F.lit(ALL_WEEKS).bitwiseAND(F.bitwise_not(F.coalesce("_closed", F.lit(0))))).drop("_closed")


def merge_intervals(rows: DataFrame, key: list[str], start: str = "opens", end: str = "closes") -> DataFrame:
    """(key, start, end): intervals of a key that overlap or touch, as one."""
    own = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.select(*key, start, end).withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    numbered = islands.withColumn("_island", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def build_periods(entries: DataFrame, key: list[str], schedule: str, weekly: DataFrame, monthly: DataFrame) -> DataFrame:
    """(key, day, opens, closes, weeks) in seconds, from schedule entries and closures."""
    split = split_overnight(opening_windows(entries, key, schedule))
    masked = apply_closures(split, key, weekly, monthly)
    merged = merge_intervals(masked, [*key, "day", "weeks"])
    return merged.select(*key, "day", (F.col("opens") * 60).alias("opens"), (F.col("closes") * 60).alias("closes"), "weeks")


def moments(rows: DataFrame, ts: str, holidays: DataFrame, zone: str = ZONE) -> DataFrame:
    """Rows with ``local_date``, ``day`` (8 on holidays), ``second`` of the day and ``week_bit`` of the month, local to the zone."""
    local = F.from_utc_timestamp(F.col(ts), zone)
    dated = rows.withColumns({"local_date": F.to_date(local), "second": F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)})
    return with_day(dated, holidays)


def with_day(dated: DataFrame, holidays: DataFrame) -> DataFrame:
    free = holidays.select(F.col("date").alias("local_date"), F.lit(True).alias("_free")).distinct()
    bit = F.pow(F.lit(2), F.floor((F.dayofmonth("local_date") - 1) / 7)).cast("int")
    return dated.join(free, "local_date", "left").withColumns({"day": F.when(F.col("_free"), HOLIDAY).otherwise(F.weekday("local_date") + 1), "week_bit": bit}).drop("_free")


def open_at(rows: DataFrame, key: list[str], periods: DataFrame, holidays: DataFrame, at, zone: str = ZONE) -> DataFrame:
    """Rows that have a period at a moment (a UTC timestamp)."""
    spark = rows.sparkSession
    moment = moments(spark.range(1).select(F.lit(at).cast("timestamp").alias("_ts")), "_ts", holidays, zone).select(F.col("day").alias("_day"), "second", "week_bit")
    hit = periods.join(F.broadcast(moment), (F.col("day") == F.col("_day")) & (F.col("opens") <= F.col("second")) & (F.col("second") < F.col("closes")) & (F.col("weeks").bitwiseAND(F.col("week_bit")) != 0))
    return rows.join(hit.select(*key), key, "left_semi")


def arrivals(rows: DataFrame, departure, metres: str, mode: str) -> DataFrame:
    """Rows with ``arrival``: the departure and the minutes of travel."""
    return rows.withColumn("arrival", (F.lit(departure).cast("timestamp").cast("long") + travel_minutes(F.col(metres), mode) * 60).cast("timestamp"))


def _dated_ranges(rows: DataFrame, key: list[str], periods: DataFrame, holidays: DataFrame, zone: str) -> DataFrame:
    """(key, arrived, opens, closes) in seconds from the arrival's local midnight: the periods of its day and of the next."""
    local = F.from_utc_timestamp("arrival", zone)
    start = rows.select(*key, "arrival", F.to_date(local).alias("_today"), (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)).alias("arrived"))
    both = start.withColumn("_offset", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("local_date", F.date_add("_today", F.col("_offset")))
    dated = with_day(both, holidays)
    meets = dated.join(periods, [*key, "day"]).filter(F.col("weeks").bitwiseAND(F.col("week_bit")) != 0)
    shift = F.col("_offset") * DAY_SECONDS
    return meets.select(*key, "arrival", "arrived", (F.col("opens") + shift).alias("opens"), (F.col("closes") + shift).alias("closes"))


def arrival_window(rows: DataFrame, key: list[str], periods: DataFrame, holidays: DataFrame, wait: int = 0, zone: str = ZONE) -> DataFrame:
    """Rows open at their ``arrival``, or within ``wait`` minutes of it."""
    ranges = _dated_ranges(rows, key, periods, holidays, zone)
    hit = ranges.filter((F.col("opens") <= F.col("arrived") + wait * 60) & (F.col("closes") > F.col("arrived")))
    return rows.join(hit.select(*key, "arrival"), [*key, "arrival"], "left_semi")


def arrival_hours(rows: DataFrame, key: list[str], periods: DataFrame, holidays: DataFrame, wait: int = 0, zone: str = ZONE) -> DataFrame:
    """(key, arrival, opens_at, open_until): the first joined range that serves the arrival; ``opens_at`` is null if it is open by then."""
    ranges = merge_intervals(_dated_ranges(rows, key, periods, holidays, zone), [*key, "arrival", "arrived"])
    fits = ranges.filter((F.col("closes") > F.col("arrived")) & (F.col("opens") <= F.col("arrived") + wait * 60))
    first = fits.groupBy(*key, "arrival", "arrived").agg(F.min_by(F.struct("opens", "closes"), "opens").alias("r"))
    moment = lambda s: (F.col("arrival").cast("long") + (s - F.col("arrived"))).cast("timestamp")
    return first.select(*key, "arrival", F.when(F.col("r.opens") > F.col("arrived"), moment(F.col("r.opens"))).alias("opens_at"), moment(F.col("r.closes")).alias("open_until"))


def holidays_between(holidays: DataFrame, since, until) -> DataFrame:
    return holidays.filter(F.col("date").between(F.lit(since), F.lit(until))).orderBy("date")


def exclude_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def not_contiguous(rows: DataFrame, key: str, order: str, unit: list[str], stretch: int = 100_000) -> DataFrame:
    """Keys whose rows are not listed together within a unit, with their number of runs.

    ``order`` is a number, as that of a row in its file.  Runs are counted within
    stretches of it, and a run that goes on from the last row of the stretch
    before counts once, so no task goes through a whole unit.
    """
    dealt = rows.withColumn("_part", F.floor(F.col(order) / stretch))
    own = Window.partitionBy(*unit, "_part").orderBy(order)
    fresh = F.when(F.row_number().over(own) == 1, 1).when(F.col(key).eqNullSafe(F.lag(key).over(own)), 0).otherwise(1)
    runs = dealt.withColumn("_new", fresh).groupBy(*unit, key).agg(F.sum("_new").alias("runs"))
    ends = dealt.groupBy(*unit, "_part").agg(F.min_by(F.struct(F.col(key).alias("v")), order).alias("_first"), F.max_by(F.struct(F.col(key).alias("v")), order).alias("_last"))
    stitched = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*unit).orderBy("_part")))  # a row for each stretch
    again = stitched.filter(F.col("_before").isNotNull() & F.col("_first.v").eqNullSafe(F.col("_before.v"))).select(*unit, F.col("_first.v").alias(key), F.lit(-1).cast("long").alias("runs"))
    return runs.unionByName(again).groupBy(*unit, key).agg(F.sum("runs").alias("runs")).filter("runs > 1")
