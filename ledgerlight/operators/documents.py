"""Shapes in which facilities are served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BUREAUS, CATEGORIES, LEVELS, PREFECTURES, STATUSES, TYPES
from .records import institution_code


def labelled(code: Column, labels: dict) -> Column:
    """struct<code, label> by a literal map; null for a null code."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.element_at(pairs, code).alias("label")))


def with_labels(rows: DataFrame, tables: dict[str, dict]) -> DataFrame:
    """Each given code column as struct<code, label>."""
    return rows.withColumns({name: labelled(F.col(name), labels) for name, labels in tables.items()})


def facility_document(rows: DataFrame, municipalities: DataFrame, bureaus: dict[int, str] = BUREAUS) -> DataFrame:
    """Facilities as served: nested, labelled, without names of persons; no location unless it is whole, no prescriptions unless begun.

    ``municipalities`` (code, name) gives the municipalities' labels.
    """
    named = municipalities.select(F.col("code").alias("municipality_code"), F.col("name").alias("_municipality"))
    rows = rows.join(named, "municipality_code", "left")
    municipality = F.when(F.col("municipality_code").isNotNull(), F.struct(F.col("municipality_code").alias("code"), F.col("_municipality").alias("label")))
    has = lambda c: c in rows.columns
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("geocode_level").isNotNull()
    location = F.when(located, F.struct(F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), labelled(F.col("geocode_level"), LEVELS).alias("level")))
    begun = F.when(F.col("e_prescription_started_on").isNotNull(), F.struct(F.col("e_prescription_started_on").alias("started_on"), F.col("e_prescription_refill_started_on").alias("refill_started_on")))
    extra = [F.round("distance").cast("long").alias("distance")] if has("distance") else []
    extra += [F.col(c) for c in ("open_until", "arrives_at", "opens_at") if has(c)]
    return rows.select(
        *[c for c in ("id",) if has(c)],
        institution_code(F.col("prefecture_code"), F.col("institution_type"), F.col("facility_code")).alias("medical_institution_code"),
        "facility_code",
        labelled(F.col("institution_type"), TYPES).alias("institution_type"),
        labelled(F.col("status"), STATUSES).alias("status"),
        labelled(F.col("bureau_code"), bureaus).alias("bureau"),
        "name",
        "name_kana",
        "prefecture_code",
        labelled(F.col("prefecture_code"), PREFECTURES).alias("prefecture"),
        municipality.alias("municipality"),
        "postal_code",
        "address",
        location.alias("location"),
        "phone_number",
        "website_url",
        "designated_on",
        "designation_history",
        "bed_counts",
        F.transform("department_categories", lambda c: labelled(c, CATEGORIES)).alias("department_categories"),
        begun.alias("e_prescription"),
        "created_at",
        "updated_at",
        *extra,
    )


def opening_hours_document(facilities: DataFrame, locations: DataFrame, schedules: DataFrame, key: str = "id") -> DataFrame:
    """(key, hours) by the matched location and its schedules; null for facilities without match."""
    own = locations.select(F.col("source_id").alias("medical_info_net_id"), "published_on", "closures")
    listed = schedules.groupBy(F.col("source_id").alias("medical_info_net_id")).agg(F.array_sort(F.collect_list(F.struct("departments", "slots"))).alias("schedules"))
    both = facilities.select(key, "medical_info_net_id").join(own, "medical_info_net_id", "left").join(listed, "medical_info_net_id", "left")
    return both.select(key, F.when(F.col("published_on").isNotNull(), F.struct("published_on", "closures", "schedules")).alias("hours"))


def facility_summary(rows: DataFrame) -> DataFrame:
    """A short shape of labels only, the address with its prefecture in front, the position where it is whole."""
    label = F.coalesce(labelled(F.col("prefecture_code"), PREFECTURES)["label"], F.lit(""))
    given = F.coalesce("address", F.lit(""))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("geocode_level").isNotNull()
    return rows.select(
        "id",
        "name",
        labelled(F.col("institution_type"), TYPES)["label"].alias("type"),
        F.coalesce(F.transform("department_categories", lambda c: labelled(c, CATEGORIES)["label"]), F.array().cast("array<string>")).alias("departments"),
        F.when(F.startswith(given, label), given).otherwise(F.concat(label, given)).alias("address"),
        "phone_number",
        "website_url",
        F.when(located, F.col("latitude").cast("double")).alias("latitude"),
        F.when(located, F.col("longitude").cast("double")).alias("longitude"),
    )
