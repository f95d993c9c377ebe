"""What the operators of this subpackage share: reading, staging and the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(docs: DataFrame) -> Column:
    """The text of a document; a null text counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing (a local session, as in tests) one folder of
    this process is used and removed at its end.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="spark-llm-"))
        atexit.register(shutil.rmtree, _OWN_ROOT[0], ignore_errors=True)
    return f"file://{_OWN_ROOT[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    The written table cuts the lineage, so a lost executor costs no more than
    the tasks after it.  The table outlives the call, as the frame returned
    reads it; the owner of the shared folder sweeps old ``llm-*`` folders.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more rows than this are dealt into lanes by ``spread_join``, the most frequent ones, so many of them at most.
HEAVY_ROWS, HEAVY_KEYS = 1000, 1000


def heavy_keys(rows: DataFrame, key: str) -> list:
    """The most frequent keys of a written table: at most ``HEAVY_KEYS``, each of more than ``HEAVY_ROWS`` rows."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > HEAVY_ROWS)
    return [r[0] for r in counts.orderBy(F.desc("count"), key).limit(HEAVY_KEYS).collect()]


def spread_join(rows: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """A left join with a table that has one row for each key, in which no frequent key of ``rows`` falls to one task.

    Rows of frequent keys are dealt into lanes by the hash of ``by``, and their
    rows of ``one`` are copied to each lane (``HEAVY_KEYS`` x lanes rows at most).
    """
    found = heavy_keys(rows, key)
    if not found:
        return rows.join(one, key, "left")
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.col(key).isin(found)
    left = rows.withColumn("_lane", F.when(heavy, F.pmod(F.xxhash64(by), F.lit(lanes))).otherwise(0).cast("int"))
    copies = F.when(heavy, F.sequence(F.lit(0), F.lit(lanes - 1))).otherwise(F.array(F.lit(0)))
    return left.join(one.withColumn("_lane", F.explode(copies)), [key, "_lane"], "left").drop("_lane")


#: Copies that this worker holds of files of one folder of a store that is not local.
_COPIES: dict[str, dict] = {}


class SharedFiles:
    """Files of this subpackage's own formats under a folder of the shared store.

    On a shared file system the files are opened, or mapped, in place.  For any
    other store pyarrow's file systems copy a file into an unnamed temporary
    file, once for each worker, that is gone when the worker turns to another
    folder or ends.
    """

    def __init__(self, url: str):
        self.url = url
        parts = urlparse(url)
        self.local = parts.path if parts.scheme in ("", "file") else None

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.url)

    @contextmanager
    def writer(self, name: str):
        """A function that adds bytes to a file, which has its final name only once it is whole; a task that runs twice replaces it by the same bytes."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{part}", "wb") as out:
                yield out.write
            os.replace(f"{self.local}/{part}", f"{self.local}/{name}")
            return
        remote, base = self._remote()
        remote.create_dir(base)
        with remote.open_output_stream(f"{base}/{part}") as out:
            yield out.write
        remote.move(f"{base}/{part}", f"{base}/{name}")

    def write(self, name: str, chunks) -> None:
        with self.writer(name) as add:
            for chunk in chunks:
                add(chunk)

    def map(self, name: str):
        """A read-only memory map of the file as bytes (an empty file gives empty bytes)."""
        import mmap

        if self.local is not None:
            with open(f"{self.local}/{name}", "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
        if self.url not in _COPIES:
            _COPIES.clear()
        copies = _COPIES.setdefault(self.url, {})
        if name not in copies:
            remote, base = self._remote()
            with remote.open_input_stream(f"{base}/{name}") as src, tempfile.TemporaryFile() as f:
                shutil.copyfileobj(src, f)
                f.flush()
                copies[name] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.tell() else b""
        return copies[name]


def slices(batch, most_rows: int = 1000, most_bytes: int = 8 << 20, column: str = "text"):
    """Parts of a record batch of at most ``most_rows`` rows and about ``most_bytes`` bytes of ``column`` (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype("i8")
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, before + most_bytes, side="right"))
        to = min(n, at + most_rows, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to
