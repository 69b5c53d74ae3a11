"""Tables of buckets whose merges rewrite only the buckets that a batch touches, published by a manifest.

Rows lie in folders by a hash of some of their key columns. A merge reads the folders of the buckets that its batch
touches, writes new ones beside them and then publishes a manifest, a small file that names the folder of every bucket.
Readers follow the newest manifest, so they see all of a merge or nothing of it, and a merge that fails leaves folders
that no manifest names. A manifest holds the ids of the batches so far: one that comes again changes nothing. Manifests
are never replaced; of two writers with the same version the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.tables import last_wins, upsert
from quire.storage import dropped, written

Change = Callable[[DataFrame, DataFrame], DataFrame]
BUCKET = "__bucket"
#: A manifest holds the ids of so many batches, the latest.
KNOWN = 10_000


class BucketedTable:
    """A table at ``path``. Spark reads and writes the rows; the driver handles a manifest of one entry a bucket."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, by: list[str], buckets: int) -> BucketedTable:
        """An empty table whose rows are dealt by the columns ``by``, a part of the keys of its merges."""
        table = cls(spark, path)
        missing = set(by) - set(schema.names)
        if missing or BUCKET in schema.names or not by or buckets < 1:
            raise ValueError(f"cannot deal rows by {by} into {buckets} buckets")
        table._publish({"version": 0, "schema": schema.jsonValue(), "by": by, "buckets": buckets, "folders": {}, "batches": []})
        return table

    # ---- manifests ----

    def _hadoop(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        to = jvm.org.apache.hadoop.fs.Path
        return to(self.path).getFileSystem(conf), to

    def _publish(self, manifest: dict) -> None:
        """Written whole under another name and renamed, which fails where the version is there already."""
        fs, to = self._hadoop()
        name = f"{self.path}/manifests/v={manifest['version']:012d}.json"
        draft = to(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(to(name)) or not fs.rename(draft, to(name)):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} is there already")

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version."""
        fs, to = self._hadoop()
        if version is None:
            names = [s.getPath().getName() for s in fs.listStatus(to(f"{self.path}/manifests"))]
            version = max(int(n[2:-5]) for n in names if n.startswith("v="))
        stream = fs.open(to(f"{self.path}/manifests/v={version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    # ---- reading ----

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f for k, f in manifest["folders"].items() if buckets is None or int(k) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def lookup(self, **values) -> DataFrame:
        """The rows with these values, of all columns that rows are dealt by and perhaps more: one bucket is read."""
        manifest = self.manifest()
        schema = StructType.fromJson(manifest["schema"])
        one = self.spark.range(1).select(*[F.lit(values[c]).cast(schema[c].dataType).alias(c) for c in manifest["by"]])
        bucket = one.select(self._bucket(manifest)).first()[0]
        found = self._read(manifest, [bucket])
        for c, v in values.items():
            found = found.filter(F.col(c).eqNullSafe(F.lit(v)))
        return found

    # ---- writing ----

    def _bucket(self, manifest: dict) -> Column:
        """The same for a value whatever integer or string type a batch gives it."""
        schema = StructType.fromJson(manifest["schema"])
        return F.pmod(F.xxhash64(*[F.col(c).cast(schema[c].dataType) for c in manifest["by"]]), F.lit(manifest["buckets"])).cast("int")

    def change(self, batch: DataFrame, batch_id: str, change: Change) -> int:
        """Applies ``change(rows, batch)`` to the rows of the buckets that ``batch`` touches; what it returns replaces
        them, and must not move a row to another bucket. Returns the version; a batch id that is known returns the
        newest and writes nothing. An empty batch makes a version with the same folders."""
        manifest = self.manifest()
        if batch_id in manifest["batches"]:
            return manifest["version"]
        schema = StructType.fromJson(manifest["schema"])
        # read for its buckets and for the merge, so computed once
        staged = written(batch, "batch")
        touched = sorted(r[0] for r in staged.select(self._bucket(manifest)).distinct().collect())
        folder, folders = f"data/{uuid.uuid4().hex}", dict(manifest["folders"])
        if touched:
            rows = change(self._read(manifest, touched), staged).select(*[F.col(f.name).cast(f.dataType) for f in schema])
            rows = rows.withColumn(BUCKET, self._bucket(manifest))
            astray = F.when(F.col(BUCKET).isin(touched), F.col(BUCKET)).otherwise(F.raise_error(F.lit("a change moved a row to a bucket that its batch does not touch")))
            # dealt by bucket, and a bucket of many rows to several tasks
            rows.withColumn(BUCKET, astray).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            fs, to = self._hadoop()
            for k in touched:
                name = f"{folder}/{BUCKET}={k}"
                folders.pop(str(k), None)
                if fs.exists(to(f"{self.path}/{name}")):
                    folders[str(k)] = name
        version = manifest["version"] + 1
        self._publish(manifest | {"version": version, "folders": folders, "batches": [*manifest["batches"], batch_id][-KNOWN:]})
        dropped(staged)
        return version

    def upsert(self, batch: DataFrame, batch_id: str, keys: list[str], order: list[Column] | None = None) -> int:
        """New keys are added, of known keys the columns that the batch has are overwritten; of rows of one key inside
        a batch the last by ``order``, without which keys are unique. Columns that a batch lacks are null in new rows."""
        if not set(self.manifest()["by"]) <= set(keys):
            raise ValueError("rows are dealt by columns that are no keys")
        return self.change(batch, batch_id, lambda rows, new: upsert(rows, new, keys, order))

    def keep_last(self, batch: DataFrame, batch_id: str, keys: list[str], order: str) -> int:
        """Of each key the row that is last by ``order`` stays, whichever batch it came in."""
        return self.change(batch, batch_id, lambda rows, new: last_wins(rows.unionByName(new), keys, [F.col(order)]))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the manifests but the newest ``keep`` and the folders that none of those names; how many folders.
        Not beside a running merge, whose folders are not named yet."""
        fs, to = self._hadoop()
        newest = self.manifest()["version"]
        old = [s.getPath() for s in fs.listStatus(to(f"{self.path}/manifests"))]
        for p in old:
            if not p.getName().startswith("v=") or int(p.getName()[2:-5]) <= newest - keep:
                fs.delete(p, False)
        named = {f for v in range(max(0, newest - keep + 1), newest + 1) for f in self.manifest(v)["folders"].values()}
        n = 0
        data = to(f"{self.path}/data")
        for run in fs.listStatus(data) if fs.exists(data) else []:
            inner = [p.getPath() for p in fs.listStatus(run.getPath()) if p.getPath().getName().startswith(BUCKET)]
            dead = [p for p in inner if f"data/{run.getPath().getName()}/{p.getName()}" not in named]
            n += len(dead)
            for p in dead:
                fs.delete(p, True)
            if len(dead) == len(inner):
                fs.delete(run.getPath(), True)
        return n
