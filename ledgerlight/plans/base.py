"""Where queries are registered: by name, each beside its DuckDB SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_OWN: list[str] = []


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; a local session without one has a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-plans-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = f"file://{_OWN[0]}"
    return f"{root.rstrip('/')}/plans-{name}-{uuid.uuid4().hex}"


def rows_of(labels: dict, name: str) -> str:
    """A literal table (code, label) as SQL."""
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in labels.items())}) AS {name}(code, label)"
