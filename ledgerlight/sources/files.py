"""Readers of workbooks, bundles, zipped CSV and GeoJSON, holidays, tables with headers, and access logs."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(data: bytes) -> dict[str, str]:
    """Names of a workbook's sheets in order, with their parts' paths."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        return {s.get("name"): posixpath.normpath(posixpath.join("xl", targets[s.get(_REL)].replace("/xl/", ""))) for s in sheets}


def sheet_rows(data: bytes, sheet: str | None = None):
    """(row number, cells) of a sheet, by name or the first; cells up to the row's last, missing ones empty."""
    names = sheet_names(data)
    if sheet is not None and sheet not in names:
        raise ValueError(f"no sheet {sheet!r}")
    part = names[sheet] if sheet is not None else next(iter(names.values()))
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for node in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                for phonetic in node.findall(f"{_MAIN}rPh"):
                    node.remove(phonetic)
                shared.append(text(node))
        with z.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for c in row.iter(f"{_MAIN}c"):
                    value = c.find(f"{_MAIN}v")
                    raw = value.text if value is not None and value.text else ""
                    cells[_column(c.get("r"))] = shared[int(raw)] if c.get("t") == "s" and raw else text(c) if c.get("t") == "inlineStr" else raw
                yield int(row.get("r")), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                row.clear()


def scan_workbooks(units: DataFrame) -> DataFrame:
    """(unit, row_no, cells) of sheets; ``units`` are (unit, content, entry, sheet): a file, the zip member in it, and the sheet (null: itself, the first)."""

    def run(batches):
        for batch in batches:
            for unit, content, entry, sheet in zip(batch["unit"], batch["content"], batch["entry"], batch["sheet"], strict=True):
                data = bytes(content)
                if isinstance(entry, str):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = z.read(entry)
                rows = list(sheet_rows(data, sheet if isinstance(sheet, str) else None))
                yield pd.DataFrame({"unit": [unit] * len(rows), "row_no": [n for n, _ in rows], "cells": [c for _, c in rows]})

    return units.select("unit", "content", "entry", "sheet").mapInPandas(run, "unit string, row_no int, cells array<string>")


def expand_bundles(files: DataFrame) -> DataFrame:
    """(path, entry, sheet): every sheet of every workbook in files (path, content), within zips too."""

    def run(batches):
        for batch in batches:
            found = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                if path.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data), metadata_encoding="cp932") as z:
                        for info in z.infolist():
                            if info.filename.lower().endswith(".xlsx"):
                                inner = z.read(info)
                                if len(inner) != info.file_size:
                                    raise ValueError(f"short read of {info.filename}")
                                found += [(path, info.filename, s) for s in sheet_names(inner)]
                else:
                    found += [(path, None, s) for s in sheet_names(data)]
            yield pd.DataFrame(found, columns=["path", "entry", "sheet"])

    return files.select("path", "content").mapInPandas(run, "path string, entry string, sheet string")


def assign_prefecture(units: DataFrame, label: Column, prefectures: dict[str, str], skip: str | None = None) -> DataFrame:
    """Units with the prefecture whose name (with or without its ending) their label holds; an unknown one is an error.

    Units whose label matches ``skip`` belong to another list and go.
    """
    if skip:
        units = units.filter(~label.rlike(skip))
    short = lambda name: name if name == "北海道" else name[:-1]
    code = F.coalesce(*[F.when(F.contains(label, F.lit(short(name))), c) for c, name in prefectures.items()])  # 東京都 holds 京都, so the first counts
    return units.withColumn("prefecture_code", F.coalesce(code, F.raise_error(F.concat(F.lit("unknown prefecture: "), label)).cast("string")))


def scan_zip_csv(files: DataFrame, columns: list[str], encoding: str = "utf-8-sig") -> DataFrame:
    """(path, row_no, columns) of the CSV in each zip (path, content), all text; rows with another number of cells go."""
    schema = "path string, row_no long, " + ", ".join(f"`{c}` string" for c in columns)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        if not name.lower().endswith(".csv"):
                            continue
                        with z.open(name) as f:
                            reader = csv.reader(io.TextIOWrapper(f, encoding, newline=""))
                            header = next(reader, [])
                            held = []
                            for n, row in enumerate(reader, 1):
                                if len(row) == len(header):
                                    held.append((path, n, *(dict(zip(header, row, strict=True)).get(c) for c in columns)))
                                if len(held) >= 10_000:
                                    yield pd.DataFrame(held, columns=["path", "row_no", *columns])
                                    held = []
                            if held:
                                yield pd.DataFrame(held, columns=["path", "row_no", *columns])

    return files.select("path", "content").mapInPandas(run, schema)


GEOMETRY = {"Point": "array<double>", "LineString": "array<array<double>>"}


def scan_geojson(spark: SparkSession, paths, properties: str, geometry: str) -> DataFrame:
    """(ord, properties, geometry) of the features of GeoJSON files, null coordinates and all."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:{GEOMETRY[geometry]}>>>"
    read = spark.read.schema(schema).json(paths, multiLine=True)
    return read.select(F.posexplode("features").alias("ord", "f")).select("ord", "f.properties", "f.geometry")


def scan_zip_geojson(files: DataFrame, ending: str, schema: str) -> DataFrame:
    """Features as JSON structs, of the member of each zip (path, content) whose name has the ending."""

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        if name.replace("\\", "/").endswith(ending):
                            features = json.loads(z.read(name)).get("features") or []
                            yield pd.DataFrame({"ord": range(len(features)), "feature": [json.dumps(x, ensure_ascii=False) for x in features]})

    raw = files.select("content").mapInPandas(run, "ord long, feature string")
    return raw.select("ord", F.from_json("feature", schema).alias("f")).select("ord", "f.*")


def scan_holidays(lines: DataFrame) -> DataFrame:
    """(date, name) from lines (ord, value) such as 2026/1/1,name; other lines go and the last of a date counts."""
    pattern = "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2}),([^,\\r]+)"
    part = lambda g: F.regexp_extract("value", pattern, g)
    date = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    rows = lines.filter(F.col("value").rlike(pattern)).select("ord", date.alias("date"), F.trim(part(4)).alias("name")).filter("date IS NOT NULL")
    return rows.groupBy("date").agg(F.max_by("name", "ord").alias("name"))


def read_holidays(spark: SparkSession, path: str, encoding: str = "cp932") -> DataFrame:
    """Holidays of a published CSV; Spark's readers do not know its encoding, so its bytes are decoded here."""

    def lines(batches):
        for batch in batches:
            for content in batch["content"]:
                found = bytes(content).decode(encoding).splitlines()
                yield pd.DataFrame({"ord": range(len(found)), "value": found})

    return scan_holidays(spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "ord long, value string"))


def scan_population(cells: DataFrame) -> DataFrame:
    """(code, population) from a workbook's rows (row_no, cells): the column headed 計 under 人口.

    A heading covers the empty cells to its right.  Codes have six digits
    (five want a 0 in front); those of prefectures, xx000x, go.  A table
    without such a column, or a population that is no number, is an error.
    """
    grid = cells.select("row_no", F.posexplode("cells").alias("col", "v")).withColumn("v", F.nullif(F.trim("v"), F.lit("")))
    covered = grid.withColumn("over", F.last("v", ignorenulls=True).over(Window.partitionBy("row_no").orderBy("col")))
    above = covered.filter(F.col("over").contains("人口")).select(F.col("row_no").alias("r1"), "col")
    heads = grid.filter(F.col("v") == "計").join(above, "col").filter("r1 < row_no").orderBy("row_no", "col").limit(1).select(F.col("row_no").alias("head"), F.col("col").alias("at"))
    body = _below(cells, heads, "population", "no population column")
    code = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    six = F.when(code.rlike("^[0-9]{5}$"), F.concat(F.lit("0"), code)).otherwise(code)
    rows = body.select(six.alias("code6"), F.replace(F.coalesce(F.get("cells", F.col("at")), F.lit("")), F.lit(",")).alias("p"))
    rows = rows.filter(F.col("code6").rlike("^[0-9]{6}$") & (F.substring("code6", 3, 3) != "000"))
    population = F.when(F.col("p").rlike("^[0-9]+$"), F.col("p").cast("long")).otherwise(_fail("unreadable population of ", F.col("code6"), "long"))
    return rows.select(F.substring("code6", 1, 5).alias("code"), population.alias("population"))


def _fail(what: str, value: Column, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(what), F.coalesce(value.cast("string"), F.lit("null")))).cast(kind)


def _below(cells: DataFrame, heads: DataFrame, table: str, missing: str) -> DataFrame:
    """The rows below a header row (``heads``: its row number ``head`` and columns, one row or none); an error if there is none."""
    found = heads.agg(*[F.max(c).alias(c) for c in heads.columns])  # one row, of nulls without a header
    checked = found.withColumn("head", F.coalesce("head", F.raise_error(F.lit(f"{missing} in {table}")).cast("int")))
    return cells.crossJoin(F.broadcast(checked)).filter("row_no > head")  # one row


def excel_date(value: Column) -> Column:
    """A date from a serial number or a text such as 2026/8/1, a time of day after either left aside; null for all else."""
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.regexp_extract(value, r"^([0-9]{1,6})(?:\.[0-9]+)?$", 1).try_cast("int"))
    pattern = r"^([0-9]{4})[/.年-]\s*([0-9]{1,2})[/.月-]\s*([0-9]{1,2})日?(?:\s.*)?$"
    part = lambda g: F.regexp_extract(value, pattern, g)
    text = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    return F.coalesce(serial, F.when(value.rlike(pattern), text))


def scan_e_prescriptions(cells: DataFrame, heads: dict[str, str], prefectures: dict[str, str], digits: dict[str, str]) -> DataFrame:
    """(code, started_on, refill_started_on) from a workbook's rows below its header row.

    ``heads`` gives the beginning of the headings of prefecture, category, code,
    started_on and refill_started_on; ``digits`` the digit of each category by
    the beginning of its name.  Codes have ten digits: prefecture, category,
    seven of the facility.  Rows without a code go; an unknown prefecture or
    category, a code that is no number of up to seven digits, a date that is
    none, a missing start, or a table without header is an error.
    """
    grid = cells.select("row_no", F.posexplode("cells").alias("col", "v"))
    places = [F.min(F.when(F.startswith(F.trim("v"), F.lit(h)), F.col("col"))).alias(n) for n, h in heads.items()]
    whole = grid.groupBy("row_no").agg(*places).dropna().orderBy("row_no").limit(1).withColumnRenamed("row_no", "head")
    body = _below(cells, whole, "e-prescriptions", "no header row").filter(F.coalesce(F.trim(F.get("cells", F.col("code"))), F.lit("")) != "")
    at = lambda n: F.coalesce(F.trim(F.get("cells", F.col(n))), F.lit(""))
    area, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, label in prefectures.items():
        area = F.when(at("prefecture") == label, c).otherwise(area)
    for name, digit in digits.items():
        kind = F.when(F.startswith(at("category"), F.lit(name)), digit).otherwise(kind)
    number = F.when(at("code").rlike("^[0-9]{1,7}$"), F.lpad(at("code"), 7, "0")).otherwise(_fail("unreadable code ", at("code"), "string"))
    area = F.coalesce(area, _fail("unknown prefecture ", at("prefecture"), "string"))
    kind = F.coalesce(kind, _fail("unknown category ", at("category"), "string"))
    date = lambda n: F.coalesce(excel_date(at(n)), _fail("unreadable date ", at(n), "date"))
    refill = F.when(at("refill_started_on") != "", date("refill_started_on"))
    return body.select(F.concat(area, kind, number).alias("code"), date("started_on").alias("started_on"), refill.alias("refill_started_on"))


LOG = "ts double, status int, msg string, request struct<remote_ip:string,client_ip:string,method:string,uri:string>"


def scan_access_log(spark: SparkSession, path: str, since: float, until: float) -> DataFrame:
    """Entries of JSON lines, gzipped or not, in a span of seconds; files last written before it are not read, bad lines are passed over."""
    from datetime import UTC, datetime

    after = datetime.fromtimestamp(since - 1, UTC).strftime("%Y-%m-%dT%H:%M:%S")
    read = spark.read.schema(LOG).option("mode", "PERMISSIVE").option("timeZone", "UTC").option("modifiedAfter", after).json(path)
    return read.filter(F.col("status").isNotNull() & (F.col("ts") >= since) & (F.col("ts") < until))
