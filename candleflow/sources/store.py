"""Versioned parquet table store (raw bars, features, predictions).

Writes never overwrite the version being read: every save goes to a new
``v=<n>`` folder under the table root and readers pick the highest version
that was committed, so a failed save never becomes the current version.  A
number is never used twice: of two writers that choose the same one, one fails
or goes on to the next.

A full save (:meth:`TableStore.save`) is committed by Spark's ``_SUCCESS``
marker.  An upsert is copy on write by date partition: it reads and rewrites
only the partitions that the new rows fall in, and commits a snapshot, a small
manifest that names the folder of every partition, by one rename that
fails if another writer was first.  Partitions that nobody touched keep their
folders of earlier versions.

On a cluster the root is a shared folder (by default under
``spark.checkpoint.dir``).
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candleflow.operators.outcomes import dedupe_last
from candleflow.session import checkpoint_dir, materialize

SNAPSHOT = "_SNAPSHOT"
#: where a table has no date column, or keys do not hold it
WHOLE = "all"
NO_DATE = "none"


def month_of(ts: str = "ts") -> Column:
    return F.coalesce(F.date_format(F.col(ts), "yyyy-MM"), F.lit(NO_DATE))


class TableStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{checkpoint_dir(spark).rstrip('/')}/store").rstrip("/")

    # ---- files
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return [st.getPath().getName() for st in fs.listStatus(path)] if fs.exists(path) else []

    def _versions(self, name: str, committed: bool = True) -> list[int]:
        out = []
        for n in self._names(name):
            if n.startswith("v=") and (not committed or {"_SUCCESS", SNAPSHOT} & set(self._names(f"{name}/{n}"))):
                out.append(int(n[2:]))
        return sorted(out)

    def _snapshot(self, name: str, version: int) -> dict | None:
        """The manifest of a version; None for a full save."""
        path, fs = self._path(f"{name}/v={version}/{SNAPSHOT}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, version: int, manifest: dict) -> bool:
        """Writes the manifest beside its place and renames it there; False if
        the version has one already."""
        place, fs = self._path(f"{name}/v={version}/{SNAPSHOT}")
        draft, _ = self._path(f"{name}/v={version}/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            place.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, place, options)
        except Py4JJavaError as exc:
            if "FileAlreadyExists" not in exc.java_exception.getClass().getName():
                raise
            fs.delete(draft, False)
            return False
        return True

    # ---- tables
    def save(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        versions = self._versions(name, committed=False)
        v = (versions[-1] + 1) if versions else 1
        w = df.write.mode("errorifexists")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{self.root}/{name}/v={v}")
        return v

    def load(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise FileNotFoundError(os.path.join(self.root, name))
        return self._read(name, versions[-1])

    def _read(self, name: str, version: int, partitions: set[str] | None = None) -> DataFrame:
        manifest = self._snapshot(name, version)
        if manifest is None:
            return self.spark.read.parquet(f"{self.root}/{name}/v={version}")
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/{name}/{p}" for k, p in manifest["partitions"].items()
                 if partitions is None or k in partitions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def load_tail(self, name: str, n: int = 30, key: str = "symbol", order: str = "ts") -> DataFrame:
        """Newest ``n`` rows per series (``load_predictions(days=30)``): a
        rank-limited window, top-n per task before the shuffle."""
        from pyspark.sql import Window
        w = Window.partitionBy(key).orderBy(F.col(order).desc())
        df = self.load(name)
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")

    def partitions(self, name: str) -> dict[str, str]:
        """Partition -> folder of the current snapshot (empty after a full save)."""
        versions = self._versions(name)
        manifest = self._snapshot(name, versions[-1]) if versions else None
        return manifest["partitions"] if manifest else {}

    def applied(self, name: str, writer: str) -> int | None:
        """The last batch of a writer that the current snapshot holds."""
        versions = self._versions(name)
        manifest = self._snapshot(name, versions[-1]) if versions else None
        return manifest["applied"].get(writer) if manifest else None

    def upsert(self, name: str, new: DataFrame, keys: list[str], date: str = "ts",
               writer: str | None = None, batch: int | None = None) -> DataFrame:
        """The last row per key, old rows first; returns the new version.

        Months of ``date`` that ``new`` has no row of are not read or written
        (one partition only where ``date`` is no key).  The first upsert after a
        full save cuts that save into partitions.  With ``writer`` and ``batch`` a
        batch that the table already holds changes nothing.  A writer that finds
        its version taken starts again from the newer one; it merges anew only
        what the other has touched.
        """
        by_month = date in keys and date in new.columns
        part = month_of(date) if by_month else F.lit(WHOLE)
        rows = materialize(new.withColumn("_p", part), "upsert")
        touched = {r["_p"] for r in rows.select("_p").distinct().collect()}
        done: dict[str, str] = {}
        base = None
        while True:
            versions = self._versions(name)
            current = versions[-1] if versions else None
            manifest = self._snapshot(name, current) if current is not None else None
            if manifest and writer is not None and batch is not None and manifest["applied"].get(writer, -1) >= batch:
                return self._read(name, current)
            version = (current or 0) + 1
            old = manifest["partitions"] if manifest else {}
            # what was merged already holds unless another writer has changed its partition since
            if base is None or current is not None and manifest is None or any(
                    old.get(p) != base.get(p) for p in touched):
                done, schema = self._merge(name, current, manifest, rows, touched, keys, part, version)
            base = {p: old.get(p) for p in touched}
            merged = {"partitions": {**old, **done}, "schema": schema,
                      "applied": {**(manifest["applied"] if manifest else {}),
                                  **({writer: batch} if writer is not None and batch is not None else {})}}
            if self._commit(name, version, merged):
                return self._read(name, version)

    def _merge(self, name, current, manifest, rows, touched, keys, part, version):
        """Writes the touched partitions; their folders, and the schema."""
        new = rows.withColumn("_arrival", F.lit(1))
        if current is None:
            both = new
        elif manifest is None:  # a full save: every partition is new
            both = self._read(name, current).withColumns({"_p": part, "_arrival": F.lit(0)}) \
                       .unionByName(new, allowMissingColumns=True)
        else:
            both = self._read(name, current, touched).withColumns({"_p": part, "_arrival": F.lit(0)}) \
                       .unionByName(new, allowMissingColumns=True)
        merged = dedupe_last(both, keys, "_arrival").drop("_arrival")
        folder = f"v={version}/data-{uuid.uuid4().hex}"
        merged.write.partitionBy("_p").parquet(f"{self.root}/{name}/{folder}")
        found = {n[len("_p="):]: f"{folder}/{n}" for n in self._names(f"{name}/{folder}") if n.startswith("_p=")}
        return found, json.loads(merged.drop("_p").schema.json())
