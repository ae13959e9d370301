"""A table in versions: each batch is a folder of its own, a manifest says which of them count.

A version's manifest is written after its rows, in one step that fails if the
version is taken; readers see the version before or the one after, never a part.
Rows of later versions replace earlier ones of their key, tombstones remove
them; reading merges what the manifest lists. Compaction writes the merged
rows as one folder, and ``vacuum`` deletes folders that no kept version lists.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import folders


class Conflict(RuntimeError):
    """Another writer took the version."""


class VersionedTable:
    """Rows with unique ``keys`` below ``path``; ``schema`` as DDL or struct."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = spark.createDataFrame([], schema).withColumns({"_gone": F.lit(False), "_version": F.lit(0)}).schema

    # ---- manifests --------------------------------------------------------

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._hadoop(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``parts`` (folders with their versions, oldest first) and ``batches`` (names that were applied)."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "parts": [], "batches": []}
        at, fs = self._hadoop(f"{self.path}/manifest/{known[-1] if version is None else version:010d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """The manifest under its final name at once: written beside it, then renamed, which fails if the name is taken."""
        final, fs = self._hadoop(f"{self.path}/manifest/{manifest['version']:010d}.json")
        draft, _ = self._hadoop(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is taken")

    # ---- writing ----------------------------------------------------------

    def apply(self, rows: DataFrame, batch: str | None = None, gone: DataFrame | None = None) -> int:
        """A version in which ``rows`` replace or join those of their keys and the keys of ``gone`` are no more.

        One row for each key (of repeated ones the greatest stays). A batch of a name that was applied already changes
        nothing. What a failed attempt wrote is in a folder that no manifest lists.
        """
        now = self.manifest()
        if batch is not None and batch in now["batches"]:
            return now["version"]
        version, part = now["version"] + 1, f"data/{uuid.uuid4().hex}"
        best = F.max(F.struct(*[c for c in self.schema.names if c not in self.keys], F.lit(0))).alias("r")
        once = rows.groupBy(*self.keys).agg(best)
        put = once.select(*[F.col(c) if c in self.keys else F.col(f"r.{c}") for c in self.schema.names], F.lit(False).alias("_gone"))
        if gone is not None:
            dead = gone.select(*self.keys).distinct().join(put.select(*self.keys), self.keys, "left_anti")
            put = put.unionByName(dead.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        put.withColumn("_version", F.lit(version)).write.parquet(f"{self.path}/{part}")
        self._commit({"version": version, "parts": [*now["parts"], part], "batches": [*now["batches"], *([batch] if batch is not None else [])]})
        return version

    def compact(self) -> int:
        """The rows as they are in one folder; tombstones go."""
        now = self.manifest()
        version, part = now["version"] + 1, f"data/{uuid.uuid4().hex}"
        self.read().withColumns({"_gone": F.lit(False), "_version": F.lit(version)}).write.parquet(f"{self.path}/{part}")
        self._commit({"version": version, "parts": [part], "batches": now["batches"]})
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep``, and folders that none of those lists; how many folders went.

        For times without a writer: a batch's folder isn't listed while it is written.
        """
        known = self.versions()
        live = {p for v in known[-keep:] for p in self.manifest(v)["parts"]}
        for v in known[:-keep]:
            folders.delete(self.spark, f"{self.path}/manifest/{v:010d}.json")
        at, fs = self._hadoop(f"{self.path}/data")
        dead = [f.getPath() for f in fs.listStatus(at) if f"data/{f.getPath().getName()}" not in live] if fs.exists(at) else []
        for path in dead:
            fs.delete(path, True)
        return len(dead)

    # ---- reading ----------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named. One folder is read as it is; of several the latest row of each key stands."""
        parts = self.manifest(version)["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(self.stored).parquet(f"{self.path}/{p}") for p in parts])
        if len(parts) > 1:
            last = Window.partitionBy(*self.keys).orderBy(F.desc("_version"))
            rows = rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
        return rows.where("NOT _gone").select(*self.schema.names)
