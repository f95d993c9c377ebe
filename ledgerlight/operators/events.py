"""The event log: reopenings, feeds, and the shape in which events are served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import BUREAUS, CATEGORIES, CREATED, DETECTED, EVENT_TYPES, ORIGINS, REMOVED, REPROCESSED, STATUSES, TYPES, UPDATED
from .documents import labelled

# Names that are not served, and the order in which changes are.
HIDDEN = ("founder_name", "administrator_name")
ORDER = (
    "facility_code", "institution_type", "status", "bureau_code", "name", "prefecture_code", "postal_code", "address",
    "phone_number", "designated_on", "designation_history", "bed_counts", "department_categories",
)


def is_reopening(events: DataFrame, entity: list[str], removed: Column | None = None, order: str = "id") -> DataFrame:
    """Events with ``is_reopening``: an earlier removal of the same entity that was no reprocessing."""
    gone = removed if removed is not None else (F.col("event_type") == REMOVED) & (F.col("origin") != REPROCESSED)
    before = Window.partitionBy(*entity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("is_reopening", F.coalesce(F.max(gone).over(before), F.lit(False)))


def filter_events(events: DataFrame, event_type: int | None = None, since=None, until=None, detected_since=None, entities: DataFrame | None = None, key: list[str] | None = None, history: bool = False) -> DataFrame:
    """The feed (detected events) or, with ``history``, one entity's events without reprocessings."""
    out = events.filter(F.col("origin") != REPROCESSED) if history else events.filter(F.col("origin") == DETECTED)
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    if since:
        out = out.filter(F.col("occurred_on") >= F.lit(since))
    if until:
        out = out.filter(F.col("occurred_on") <= F.lit(until))
    if detected_since:
        out = out.filter(F.col("created_at") >= F.lit(detected_since))
    return out.join(entities, key, "left_semi") if entities is not None else out


def shown(payload: Column) -> Column:
    return F.map_filter(payload, lambda k, v: ~k.isin(*HIDDEN))


def drop_hidden_only_updates(events: DataFrame) -> DataFrame:
    """Without updates in which only names that are not served changed."""
    return events.filter((F.col("event_type") != UPDATED) | (F.size(shown(F.col("payload"))) > 0))


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("occurred_on"), F.desc("id"))


def coded(value: Column, labels: dict) -> Column:
    """struct<code, label> of a code's text."""
    label = F.lit(None).cast("string")
    for code, text in labels.items():
        label = F.when(value == str(code), text).otherwise(label)
    return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("code"), label.alias("label"))))


def coded_list(value: Column, labels: dict) -> Column:
    """The codes of a JSON list as a JSON list of {code, label}."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    entry = lambda c: F.struct(c.alias("code"), F.element_at(pairs, c).alias("label"))
    return F.to_json(F.transform(F.from_json(value, "array<int>"), entry))


def event_document(events: DataFrame, bureaus: dict[int, str] = BUREAUS) -> DataFrame:
    """Events as served, their codes labelled: updates with their changes in a fixed order, creations with ``is_reopening``."""
    visible = shown(F.col("payload"))
    rest = F.array_sort(F.filter(F.map_keys(visible), lambda k: ~k.isin(*ORDER)))
    names = F.concat(F.filter(F.array(*[F.lit(n) for n in ORDER]), lambda k: F.map_contains_key(visible, k)), rest)

    def served(name: Column, value: Column) -> Column:
        out = F.when(name == "designated_on", F.substring(value, 1, 10)).otherwise(value)
        for attribute, labels in (("institution_type", TYPES), ("status", STATUSES), ("bureau_code", bureaus)):
            out = F.when(name == attribute, coded(value, labels)).otherwise(out)
        return F.when(name == "department_categories", coded_list(value, CATEGORIES)).otherwise(out)

    change = lambda n: F.struct(
        F.when(n == "bureau_code", "bureau").otherwise(n).alias("attribute"),
        served(n, F.element_at(F.col("payload"), n)["old"]).alias("old"),
        served(n, F.element_at(F.col("payload"), n)["new"]).alias("new"),
    )
    return events.select(
        "id",
        labelled(F.col("event_type"), EVENT_TYPES).alias("event_type"),
        labelled(F.col("origin"), ORIGINS).alias("origin"),
        "occurred_on",
        F.col("created_at").alias("detected_at"),
        F.when(F.col("event_type") == CREATED, F.col("is_reopening")).alias("is_reopening"),
        F.when(F.col("event_type") == UPDATED, F.transform(names, change)).alias("changes"),
    )
