"""Comparison of a published edition with the master table: a new master and an append-only event log.

The natural key joins both sides once; every row's outcome is one expression.
A key that an edition holds twice counts with its last row and gives one event.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.fixed import ACTIVE, BASELINE, CLOSED, CREATED, DETECTED, REMOVED, REPROCESSED, UPDATED

KEY = ("bureau_code", "prefecture_code", "institution_type", "facility_code")


@dataclass(frozen=True)
class Layout:
    """The columns that the comparison is about; the master has them all, with ``status``, the watermark and both times."""

    key: tuple[str, ...] = KEY
    attributes: tuple[str, ...] = ()
    watermark: str = "last_seen_download"
    #: What must appear in a run before a row of it can be closed.
    completeness: tuple[str, ...] = ("institution_type", "prefecture_code")
    #: The column by which rows of one key in an edition follow each other; without it such rows must be alike.
    order: str | None = None
    #: What events of rows that appear or go tell of them.
    described: tuple[str, ...] = ("name", "address")
    #: Columns that no longer hold once a row's address is another.
    located: tuple[str, ...] = ("latitude", "longitude", "geocode_level", "geocoded_address")

    @property
    def carried(self) -> tuple[str, ...]:
        return tuple(c for c in self.completeness if c not in (*self.key, *self.attributes))


def canonical(column: Column, kind: str) -> Column:
    """A value as the text that comparisons use: six decimals, days, maps by key; codes stay text."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        return F.format_string("%.6f", column.cast("double"))
    if kind == "timestamp":
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    if kind.startswith("map"):
        return F.to_json(F.array_sort(F.map_entries(column)))
    if kind.startswith(("array", "struct")):
        return F.to_json(column)
    return column.cast("string")


def diff_attributes(old: Column, new: Column, kinds: dict[str, str]) -> Column:
    """map<attribute, struct<old, new>> of the attributes (struct fields) in which two rows differ."""
    pairs = []
    for name, kind in kinds.items():
        a, b = canonical(old[name], kind), canonical(new[name], kind)
        pairs.append(F.when(~a.eqNullSafe(b), F.struct(F.lit(name).alias("key"), F.struct(a.alias("old"), b.alias("new")).alias("value"))))
    if not pairs:
        return F.create_map().cast("map<string,struct<old:string,new:string>>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def last_of_key(rows: DataFrame, layout: Layout) -> DataFrame:
    """(key, new): of each key the last row's attributes, status and what completeness is about; without an order, rows of a key that differ are an error."""
    values = F.struct(*layout.attributes, "status", *layout.carried)
    if layout.order:
        return rows.groupBy(*layout.key).agg(F.max_by(values, F.struct(layout.order, F.to_json(values))).alias("new"))
    text = F.to_json(values)
    unlike = F.raise_error(F.concat(F.lit("rows of one key differ, and the layout has no order: "), F.to_json(F.struct(*layout.key))))
    found = rows.groupBy(*layout.key).agg(F.max_by(values, text).alias("new"), (F.min(text) == F.max(text)).alias("_alike"))
    return found.select(*layout.key, F.when(F.col("_alike"), F.col("new")).otherwise(unlike).alias("new"))


def compare(master: DataFrame, incoming: DataFrame, layout: Layout) -> DataFrame:
    """Key and completeness columns, ``old`` and ``new`` (structs or null), ``changes`` and ``outcome``: created, reopened, updated, unchanged or missing."""
    fields = [*layout.attributes, "status"]
    old = master.select(*layout.key, F.struct("*").alias("old"))
    new = last_of_key(incoming, layout)
    kinds = {n: k for n, k in incoming.dtypes if n in fields}
    both = old.join(new, list(layout.key), "full")
    changes = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), diff_attributes(F.col("old"), F.col("new"), kinds))
    outcome = (
        F.when(F.col("new").isNull(), "missing")
        .when(F.col("old").isNull(), "created")
        .when(F.col("old.status") == CLOSED, "reopened")
        .when(F.size("changes") > 0, "updated")
        .otherwise("unchanged")
    )
    scope = {c: F.coalesce(F.col("new").getField(c), F.col("old").getField(c)) for c in layout.carried}
    return both.withColumns(scope).withColumn("changes", changes).withColumn("outcome", outcome)


def event_origin(seen_before: DataFrame, scope: list[str], reimport: bool) -> DataFrame:
    """(scope, origin) of events: a forced re-import, else the scopes tracked before are watched and all others baselines."""
    origin = REPROCESSED if reimport else DETECTED
    return seen_before.select(*scope).distinct().withColumn("origin", F.lit(origin))


def description(row: Column, fields: list[str], side: str) -> Column:
    """The payload of an event of a row that appears (``side`` new) or goes (old): the fields' values on that side."""
    none = F.lit(None).cast("string")
    value = lambda n: row.getField(n).cast("string")
    entry = lambda n: F.struct((none if side == "new" else value(n)).alias("old"), (value(n) if side == "new" else none).alias("new"))
    pairs = [x for n in fields for x in (F.lit(n), entry(n))]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,struct<old:string,new:string>>")


def apply_snapshot(
    master: DataFrame,
    incoming: DataFrame,
    download_id: int,
    published_on,
    seen_at,
    layout: Layout,
    ledger: DataFrame | None = None,
    reimport: bool = False,
    derive: dict[str, Column] | None = None,
    compared: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The new master (rows not in the edition as they were) and the events of rows created, reopened or changed.

    ``compared`` is what ``compare`` gave for both, if it was written already.

    ``ledger`` (id, published_on, superseded_at), if given, makes reopenings and
    changes against a row last seen in the same edition reprocessings.
    ``derive`` gives columns that follow from others, over the new master's own
    columns; they are made anew for rows of such events.  A row whose address
    changed loses its position.
    """
    compared = compare(master, incoming, layout) if compared is None else compared
    seen = F.col("new").isNotNull()
    moved = F.col("outcome").isin("created", "reopened", "updated")
    relocated = F.lit(False)
    if "address" in layout.attributes:
        relocated = seen & F.col("old").isNotNull() & ~F.col("new.address").eqNullSafe(F.col("old").getField("address"))
    columns = []
    for name, kind in master.dtypes:
        old = F.col("old").getField(name)
        if name in layout.key:
            value = F.col(name)
        elif name in layout.located and name not in layout.attributes:
            value = F.when(~relocated, old)
        elif name in (*layout.attributes, "status", *layout.carried):
            value = F.when(seen, F.col("new").getField(name)).otherwise(old)
        elif name == layout.watermark:
            value = F.when(seen, F.lit(download_id)).otherwise(old)
        elif name == "created_at":
            value = F.coalesce(old, F.lit(seen_at))
        elif name == "updated_at":
            value = F.when(moved, F.lit(seen_at)).otherwise(old)
        else:
            value = old
        columns.append(value.cast(kind).alias(name))
    scopes = event_origin(master, list(layout.completeness), reimport)
    events = compared.filter(moved).join(scopes, list(layout.completeness), "left")
    origin = F.lit(REPROCESSED) if reimport else F.coalesce("origin", F.lit(BASELINE))
    if ledger is not None:
        same = ledger.filter(F.col("superseded_at").isNull() & (F.col("published_on") == F.lit(published_on))).select(F.col("id").alias("_last"))
        events = events.withColumn("_last", F.col("old").getField(layout.watermark)).join(same.distinct().withColumn("_same", F.lit(True)), "_last", "left")
        origin = F.when((F.col("outcome") != "created") & F.coalesce("_same", F.lit(False)), REPROCESSED).otherwise(origin)
    kind = F.when(F.col("outcome") == "updated", UPDATED).otherwise(CREATED)
    told = description(F.col("new"), [n for n in layout.described if n in layout.attributes], "new")
    logged = events.select(
        *layout.key,
        kind.alias("event_type"),
        origin.cast("int").alias("origin"),
        F.lit(published_on).cast("date").alias("occurred_on"),
        F.when(F.col("outcome") == "updated", F.col("changes")).otherwise(told).alias("payload"),
        F.lit(download_id).cast("long").alias("download_id"),
        F.lit(seen_at).cast("timestamp").alias("created_at"),
    )
    after = compared.select(*columns, moved.alias("_moved"))
    if derive:
        after = after.withColumns({n: F.when(F.col("_moved"), v).otherwise(F.col(n)) for n, v in derive.items()})
    return after.drop("_moved"), logged


def reconcile_closures(master: DataFrame, seen: DataFrame, download_id: int, published_on, seen_at, layout: Layout, failed: DataFrame | None = None, origin: int = DETECTED) -> tuple[DataFrame, DataFrame]:
    """Closes rows that a complete run did not hold: (new master, events).

    ``seen`` are the rows of the run; only what shares its type and prefecture
    can close, and never a facility code in ``failed``.  Events have the run's
    ``origin``.
    """
    scopes = seen.select(*layout.completeness).distinct()
    open_rows = master.filter(F.col("status") != CLOSED).filter(~F.col(layout.watermark).eqNullSafe(F.lit(download_id)))
    stale = open_rows.join(scopes, list(layout.completeness), "left_semi").join(seen.select(*layout.key).distinct(), list(layout.key), "left_anti")
    if failed is not None:
        stale = stale.join(failed.select("facility_code").distinct(), "facility_code", "left_anti")
    told = description(F.struct("*"), [n for n in layout.described if n in master.columns], "old")
    keys = stale.select(*layout.key, told.alias("payload"))
    marked = master.join(keys.select(*layout.key, F.lit(True).alias("_gone")), list(layout.key), "left")
    gone = F.coalesce("_gone", F.lit(False))
    closed = marked.select(
        *[
            (F.when(gone, F.lit(CLOSED)).otherwise(F.col(c)) if c == "status" else F.when(gone, F.lit(seen_at)).otherwise(F.col(c)) if c == "updated_at" else F.col(c)).cast(k).alias(c)
            for c, k in master.dtypes
        ]
    )
    events = keys.select(
        *layout.key,
        F.lit(REMOVED).alias("event_type"),
        F.lit(origin).alias("origin"),
        F.lit(published_on).cast("date").alias("occurred_on"),
        "payload",
        F.lit(download_id).cast("long").alias("download_id"),
        F.lit(seen_at).cast("timestamp").alias("created_at"),
    )
    return closed, events


def appeared_and_gone(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): the distinct keys that only ``after`` has (new) or only ``before`` (gone); a key with a null equals none, so it is both.

    Both tables meet in one grouping and no join, so a task holds each of its keys once, with two bits.
    """
    sides = before.select(*key, F.lit(1).alias("_sides")).unionByName(after.select(*key, F.lit(2).alias("_sides")))
    found = sides.groupBy(*key).agg(F.bit_or("_sides").alias("_sides"))
    unequal = reduce(or_, [F.col(k).isNull() for k in key])
    side = F.when(F.col("_sides") == 1, F.array(F.lit("gone"))).when(F.col("_sides") == 2, F.array(F.lit("new"))).when(unequal, F.array(F.lit("gone"), F.lit("new")))
    return found.select(*key, F.explode(side).alias("side"))


def run_counters(compared: DataFrame) -> DataFrame:
    return compared.groupBy("outcome").agg(F.count("*").alias("n"))


def backfill_origin(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Origins for old events: those of a source's earliest edition are baselines (if created) or reprocessings, later ones detected."""
    firsts = ledger.groupBy("bureau_code", "category").agg(F.min("published_on").alias("published_on"))
    first = ledger.join(firsts, ["bureau_code", "category", "published_on"], "left_semi").select(F.col("id").alias("download_id"), F.lit(True).alias("_earliest"))
    origin = F.when(F.coalesce("_earliest", F.lit(False)), F.when(F.col("event_type") == CREATED, BASELINE).otherwise(REPROCESSED)).otherwise(DETECTED)
    return events.join(first, "download_id", "left").withColumn("origin", origin).drop("_earliest")


def enrich_by_code(master: DataFrame, listed: DataFrame, code: Column, columns: list[str], seen_at) -> tuple[DataFrame, DataFrame]:
    """Sets, or clears, ``columns`` from a list by code; (new master, counters listed, matched and changed)."""
    found = listed.select(F.col("code").alias("_code"), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit")).dropDuplicates(["_code"])
    both = master.withColumn("_code", code).join(found, "_code", "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    both = both.withColumn("_changed", changed)
    fresh = [F.col(f"_new_{c}").alias(c) if c in columns else F.when(F.col("_changed"), F.lit(seen_at)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in master.columns]
    counts = both.agg(F.count_if("_hit").alias("matched"), F.count_if("_changed").alias("changed")).crossJoin(found.agg(F.count("*").alias("listed")))
    return both.select(*fresh), counts


def enrich_observed(master: DataFrame, listed: DataFrame, code: Column, columns: list[str], seen_at) -> tuple[DataFrame, Counters]:
    """As ``enrich_by_code``, with the counters (matched, changed, listed) observed while the new master is written, so that nothing is read twice.

    What is listed is counted where the join's right side passes; the counters
    are there once the new master was written.
    """
    listing, passing = Observation("listed"), Observation("passed")
    found = listed.select(F.col("code").alias("_code"), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit")).dropDuplicates(["_code"]).observe(listing, F.count("*").alias("listed"))
    both = master.withColumn("_code", code).join(found, "_code", "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    both = both.withColumn("_changed", changed).observe(passing, F.count_if("_hit").alias("matched"), F.count_if("_changed").alias("changed"))
    fresh = [F.col(f"_new_{c}").alias(c) if c in columns else F.when(F.col("_changed"), F.lit(seen_at)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in master.columns]
    return both.select(*fresh), Counters(listing, passing)


class Counters:
    """Numbers observed by a job; they are there once it is done."""

    def __init__(self, *observed: Observation):
        self.observed = observed

    @property
    def get(self) -> dict[str, int]:
        return {name: n for o in self.observed for name, n in o.get.items()}


def observed_outcomes(compared: DataFrame) -> tuple[DataFrame, Counters]:
    """The compared rows, with the number of each outcome observed as they pass."""
    seen = Observation("outcomes")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "reopened", "updated", "unchanged", "missing")]
    return compared.observe(seen, *counts), Counters(seen)


def prune_out_of_scope(master: DataFrame, events: DataFrame, ledger: DataFrame, prefectures: list[str], types: list[int], categories: list[int], key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of master, events and downloads; a download stays if any prefecture it covers is in scope."""
    kept = in_scope(master, prefectures, types)
    stays = kept.select(*key)
    covered = F.arrays_overlap("prefecture_codes", F.array(*[F.lit(p) for p in prefectures])) if prefectures else F.lit(True)
    wanted = F.col("category").isin(categories) if categories else F.lit(True)
    return kept, events.join(stays, key, "left_semi"), ledger.filter(covered & wanted)


def in_scope(rows: DataFrame, prefectures: list[str], types: list[int]) -> DataFrame:
    """Rows of the given prefectures and types; an empty list means all, an unknown code is an error."""
    from ..functions.fixed import PREFECTURES, TYPES

    unknown = [p for p in prefectures if p not in PREFECTURES] + [t for t in types if t not in TYPES]
    if unknown:
        raise ValueError(f"unknown codes: {unknown}")
    if prefectures:
        rows = rows.filter(F.col("prefecture_code").isin(prefectures))
    return rows.filter(F.col("institution_type").isin(types)) if types else rows


def change_fingerprint(tables: dict[str, DataFrame], time: str = "updated_at") -> DataFrame:
    """(name, n, last): unchanged values mean that a derived table need not be made anew."""
    out = None
    for name, table in sorted(tables.items()):
        one = table.agg(F.count("*").alias("n"), F.max(time).cast("string").alias("last")).select(F.lit(name).alias("name"), "n", "last")
        out = one if out is None else out.unionByName(one)
    return out


def open_rows(master: DataFrame) -> DataFrame:
    return master.filter(F.col("status") == ACTIVE)
