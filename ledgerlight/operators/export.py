"""Bulk exports: compressed CSV and JSON lines by prefecture and as a whole, with a manifest written last."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CATEGORIES, LEVELS, PREFECTURES, STATUSES, TYPES
from .documents import facility_document, labelled
from .records import institution_code

# The columns of the CSV files in order; later ones stand at the end.
CSV_COLUMNS = (
    "id", "medical_institution_code", "facility_code", "institution_type_code", "institution_type", "status_code", "status",
    "bureau_code", "bureau", "name", "prefecture_code", "prefecture", "municipality_code", "municipality", "postal_code",
    "address", "latitude", "longitude", "geocode_level_code", "geocode_level", "phone_number", "designated_on",
    "designation_history", "bed_counts", "department_category_codes", "department_categories", "created_at", "updated_at",
    "e_prescription_started_on", "e_prescription_refill_started_on", "name_kana", "website_url",
)


def neutralize_formula(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula, with a quote in front."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_text(rows: DataFrame) -> DataFrame:
    return rows.select(*[neutralize_formula(F.col(f"`{c}`")).alias(c) if k == "string" else F.col(f"`{c}`") for c, k in rows.dtypes])


def csv_rows(rows: DataFrame, municipalities: DataFrame, bureaus: dict[int, str]) -> DataFrame:
    """Facilities flattened to the CSV's columns."""
    named = rows.join(municipalities.select(F.col("code").alias("municipality_code"), F.col("name").alias("municipality")), "municipality_code", "left")
    label = lambda c, t: labelled(F.col(c), t)["label"]
    listed = lambda f: F.array_join(F.transform("department_categories", f), "|")
    columns = {
        "medical_institution_code": institution_code(F.col("prefecture_code"), F.col("institution_type"), F.col("facility_code")),
        "institution_type_code": F.col("institution_type"), "institution_type": label("institution_type", TYPES),
        "status_code": F.col("status"), "status": label("status", STATUSES), "bureau": label("bureau_code", bureaus),
        "prefecture": label("prefecture_code", PREFECTURES), "geocode_level_code": F.col("geocode_level"), "geocode_level": label("geocode_level", LEVELS),
        "designation_history": F.to_json("designation_history"), "bed_counts": F.to_json("bed_counts"),
        "department_category_codes": listed(lambda c: c.cast("string")), "department_categories": listed(lambda c: labelled(c, CATEGORIES)["label"]),
    }
    return safe_text(named.select(*[columns.get(c, F.col(c)).alias(c) for c in CSV_COLUMNS]))


def export_bulk(rows: DataFrame, municipalities: DataFrame, bureaus: dict[int, str], path: str, per_file: int = 1_000_000) -> None:
    """Writes csv and jsonl folders, each partitioned by prefecture and as a whole; files hold rows of a range of ids."""
    flat, served = csv_rows(rows, municipalities, bureaus), facility_document(rows, municipalities, bureaus)
    options = {"header": True, "escape": '"', "lineSep": "\r\n", "compression": "gzip", "maxRecordsPerFile": per_file}
    by_area = lambda df: df.withColumn("area", F.col("prefecture_code")).repartitionByRange("area", "id").sortWithinPartitions("area", "id").write.partitionBy("area")
    by_area(flat).options(**options).csv(f"{path}/csv")
    flat.write.options(**options).csv(f"{path}/csv_all")
    by_area(served).options(maxRecordsPerFile=per_file).json(f"{path}/jsonl", compression="gzip")
    served.write.options(maxRecordsPerFile=per_file).json(f"{path}/jsonl_all", compression="gzip")


def export_set(rows: DataFrame, municipalities: DataFrame, bureaus: dict[int, str], root: str, scope: dict) -> dict:
    """A new set under ``root``/sets that becomes the current one by a rename of the manifest, and only once it is whole.

    The set it replaces stays, as it may be being read; older ones go.
    """
    spark = rows.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    at = lambda name: jvm.Path(f"{root}/{name}")
    store = at("sets").getFileSystem(spark._jsc.hadoopConfiguration())
    current = current_manifest(spark, root)
    name = datetime.now(UTC).strftime("%Y%m%d%H%M%S%f")
    export_bulk(rows, municipalities, bureaus, f"{root}/sets/{name}")
    manifest = export_manifest(spark, f"{root}/sets/{name}", rows, scope) | {"set": name}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{root}/next-{name}")
    part = next(s.getPath() for s in store.listStatus(at(f"next-{name}")) if s.getPath().getName().startswith("part-"))
    swap = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    swap[0] = getattr(jvm, "Options$Rename").OVERWRITE
    jvm.FileContext.getFileContext(at("").toUri(), spark._jsc.hadoopConfiguration()).rename(part, at("manifest.json"), swap)
    store.delete(at(f"next-{name}"), True)
    kept = {name, (current or {}).get("set")}
    for status in store.listStatus(at("sets")):
        if status.getPath().getName() not in kept:
            store.delete(status.getPath(), True)
    return manifest


def current_manifest(spark, root: str) -> dict | None:
    """The manifest of the current set; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest.json")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads(spark.read.text(f"{root}/manifest.json", wholetext=True).head()[0])


def digests(rows: DataFrame, key: str | list[str], line: str, order: list[str]) -> DataFrame:
    """For each key its records, their bytes and the sha256 of its lines one after another, in order.

    A digest goes through the lines one by one, so no group is ever held, as a
    list or as a text; a key's lines are read by one task, so large sets want a
    key that parts them.
    """
    keys = [key] if isinstance(key, str) else key
    kinds = dict(rows.dtypes)

    def run(batches):
        now, records, size, digest, schema = None, 0, 0, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*now, records, size, digest.hexdigest()), schema, strict=True)], [*keys, "records", "bytes", "sha256"])
        for batch in batches:
            schema = [*batch.schema.types[:-1], pa.int64(), pa.int64(), pa.string()]
            *own, texts = (c.to_pylist() for c in batch.columns)
            for k, text in zip(zip(*own, strict=True), texts, strict=True):
                if digest is None or k != now:
                    if digest is not None:
                        yield row()
                    now, records, size, digest = k, 0, 0, hashlib.sha256()
                data = (text or "").encode()
                records, size = records + 1, size + len(data)
                digest.update(data)
        if digest is not None:
            yield row()

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in order])
    made = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return ordered.select(*keys, line).mapInArrow(run, f"{made}, records long, bytes long, sha256 string")


#: Bytes of a file that a task holds at a time.
CHUNK = 4 << 20


def file_digests(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Files (path) with bytes and sha256, each read as a stream in pieces, so that a task's memory does not grow with a file."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                digest, size = hashlib.sha256(), 0
                with store.open_input_stream(name, compression=None) as source:  # the bytes as they are, not what is in them
                    while piece := source.read(chunk):
                        digest.update(piece)
                        size += len(piece)
                yield pa.record_batch([pa.array([path]), pa.array([size]), pa.array([digest.hexdigest()])], ["path", "bytes", "sha256"])

    return files.select("path").mapInArrow(run, "path string, bytes long, sha256 string")


def described_files(spark, path: str, chunk: int = CHUNK) -> DataFrame:
    """(format, prefecture, bytes, sha256, path) of a set's files; their names come from a scan that reads no content, and are dealt to all tasks."""
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.regexp_extract("path", "/(csv|csv_all|jsonl|jsonl_all)/", 1)
    area = F.nullif(F.regexp_extract("path", "/area=([^/]+)/", 1), F.lit(""))
    return file_digests(named.repartition(tasks, "path"), chunk).select(name.alias("format"), area.alias("prefecture"), "bytes", "sha256", "path")


def export_manifest(spark, path: str, rows: DataFrame, scope: dict) -> dict:
    """Describes the written files (format, area, records, bytes, sha256) and writes the manifest as the last of the set.

    It is one document that lists all files, a few for each million rows, so
    this list goes through the driver; what is in the files does not.
    """
    counts = {r["prefecture_code"]: r["count"] for r in rows.groupBy("prefecture_code").count().collect()}
    listed = [r.asDict() | {"records": counts.get(r["prefecture"]) if r["prefecture"] else sum(counts.values())} for r in described_files(spark, path).orderBy("path").toLocalIterator()]
    last = rows.agg(F.max("updated_at").cast("string").alias("last")).head()["last"]
    manifest = {"generated_at": datetime.now(UTC).isoformat(), "data_updated_at": last, "scope": scope, "files": listed}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def should_export(rows: DataFrame, scope: dict, current: dict | None) -> bool:
    """Whether anything changed since the current set; an empty set is refused."""
    now = rows.agg(F.max("updated_at").cast("string").alias("last"), F.count("*").alias("n")).head()
    if not now["n"]:
        raise ValueError("nothing is in scope; the current set is kept")
    return current is None or current["data_updated_at"] != now["last"] or current["scope"] != scope


def replace_table(rows: DataFrame, path: str, least: int = 0) -> str:
    """Writes a whole new version of a reference table once it passes its floor; returns the version's path."""
    from ..sources.ledger import guard_min_rows

    version = f"{path}/{datetime.now(UTC).strftime('%Y%m%d%H%M%S%f')}"
    guard_min_rows(rows, least).write.parquet(version)
    return version
