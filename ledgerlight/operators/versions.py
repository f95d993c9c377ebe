"""The master table by scope and version: an edition reads and writes only the scopes that it is about.

Below a root stand ``rows``, partitioned by scope and version, ``events``, a
folder for each step, and ``current``, for each step a small table that says
which version of each scope is current.  A step writes its scopes under its own
version by dynamic partition overwrite, then its events, and at last its
pointer, which commits it; so a step that is cut off changes nothing that is
read, and one that runs again overwrites what it left.  Readers of the step
before are not disturbed, as the versions of the last two steps remain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .snapshot import Layout, apply_snapshot, compare, reconcile_closures

KEPT = 2


class Master:
    """The master below ``root``; ``schema`` is that of its rows, and the layout's scope must be part of its key."""

    def __init__(self, spark: SparkSession, root: str, layout: Layout, schema: StructType):
        if not set(layout.completeness) <= set(layout.key):
            raise ValueError(f"the scope {layout.completeness} must be part of the key {layout.key}")
        self.spark, self.root, self.layout, self.schema = spark, root, layout, schema
        self.scope = list(layout.completeness)

    # ---- folders

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _store(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        store, path = self._store(), self._path(name)
        return [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []

    def is_whole(self, name: str) -> bool:
        return self._store().exists(self._path(f"{name}/_SUCCESS"))

    def remove(self, name: str) -> None:
        self._store().delete(self._path(name), True)

    # ---- steps

    def steps(self) -> list[int]:
        """The committed steps whose versions remain, in order."""
        return sorted(int(n) for n in self._names("current") if self.is_whole(f"current/{n}"))

    def pointer(self, step: int) -> dict[tuple, int]:
        """The version of each scope after a step: a row for each type and prefecture."""
        rows = self.spark.read.parquet(f"{self.root}/current/{step}").collect()
        return {tuple(r[c] for c in self.scope): r["version"] for r in rows}

    def _commit(self, step: int, versions: dict[tuple, int]) -> None:
        kinds = StructType([self.schema[c] for c in self.scope]).add("version", LongType())
        self.spark.createDataFrame([(*s, v) for s, v in sorted(versions.items())], kinds).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/current/{step}")

    def _write(self, rows: DataFrame, step: int) -> None:
        dealt = rows.withColumn("version", F.lit(step).cast("long")).hint("rebalance", *self.scope)  # AQE splits a scope that is large
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.scope, "version").parquet(f"{self.root}/rows")

    def _scopes(self, rows: DataFrame) -> list[tuple]:
        found = [tuple(r) for r in rows.select(*self.scope).distinct().collect()]  # types x prefectures
        if any(None in s for s in found):
            raise ValueError(f"rows without {' or '.join(self.scope)}")
        return found

    def create(self, master: DataFrame) -> None:
        """The table to begin with, as step 0."""
        if self.steps():
            raise ValueError(f"{self.root} holds a master already")
        self._write(master, 0)
        self._commit(0, dict.fromkeys(self._scopes(master), 0))

    def read(self, scopes: list[tuple] | None = None, step: int | None = None) -> DataFrame:
        """The rows after a step (the last one, if none is given), of some scopes or all, by a filter on partitions."""
        step = self.steps()[-1] if step is None else step
        current = self.pointer(step)
        wanted = {s: v for s, v in current.items() if scopes is None or s in set(scopes)}
        rows = self.spark.read.schema(StructType(self.schema.fields).add("version", LongType())).parquet(f"{self.root}/rows")
        by_version: dict[int, list[tuple]] = {}
        for s, v in sorted(wanted.items()):
            by_version.setdefault(v, []).append(s)
        literal = lambda s: F.struct(*[F.lit(x).cast(self.schema[c].dataType).alias(c) for c, x in zip(self.scope, s, strict=True)])
        here = [(F.col("version") == v) & F.struct(*self.scope).isin(*map(literal, own)) for v, own in by_version.items()]
        return rows.filter(reduce(lambda a, b: a | b, here, F.lit(False))).select(*self.schema.names)

    def apply(self, step: int, edition: DataFrame, download_id: int, published_on, seen_at, ledger: DataFrame | None = None, reimport: bool = False, derive: dict | None = None, failed: DataFrame | None = None) -> bool:
        """Compares an edition with its scopes, closes what it lacks, and commits both; False if the step is committed already."""
        steps = self.steps()
        if step in steps:
            self.retain()  # it may have been cut off after its commit
            return False
        if not steps or step < steps[-1]:
            raise ValueError(f"step {step} cannot follow {steps}")
        scopes = self._scopes(edition)
        before = self.read(scopes, steps[-1])
        compare(before, edition, self.layout).write.mode("overwrite").parquet(f"{self.root}/compared/{step}")  # both sides meet once
        compared = self.spark.read.parquet(f"{self.root}/compared/{step}")
        after, logged = apply_snapshot(before, edition, download_id, published_on, seen_at, self.layout, ledger, reimport, derive, compared)
        closed, gone = reconcile_closures(after, edition, download_id, published_on, seen_at, self.layout, failed)
        self._write(closed, step)
        logged.unionByName(gone).write.mode("overwrite").parquet(f"{self.root}/events/{step}")
        self._commit(step, self.pointer(steps[-1]) | dict.fromkeys(scopes, step))
        self.remove(f"compared/{step}")
        self.retain()
        return True

    def events(self) -> DataFrame:
        """The log of all committed steps, with the step that wrote each event."""
        last = self.steps()[-1]
        named = F.regexp_extract("_metadata.file_path", r"/events/([0-9]+)/", 1).cast("long")
        found = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/events")
        return found.withColumn("step", named).filter(F.col("step") <= last)

    def _versions(self, scopes) -> Iterator[tuple[str, int]]:
        for s in scopes:
            folder = "/".join(["rows", *(f"{c}={x}" for c, x in zip(self.scope, s, strict=True))])
            yield from ((f"{folder}/{n}", int(n.removeprefix("version="))) for n in self._names(folder))

    def retain(self, kept: int = KEPT) -> None:
        """Removes pointers before the last ``kept`` ones, and versions of the scopes they replaced that no pointer names."""
        steps = self.steps()
        pointers = [self.pointer(n) for n in steps[-kept:]]
        for n in steps[:-kept]:
            self.remove(f"current/{n}")
        touched = [s for s, v in pointers[-1].items() if v == steps[-1]]
        for folder, version in list(self._versions(touched)):
            scope = tuple(x.split("=", 1)[1] for x in folder.split("/")[1:-1])
            named = {v for p in pointers for s, v in p.items() if tuple(map(str, s)) == scope}
            if version not in named:
                self.remove(folder)
