"""Tables in buckets by key, so that a merge rewrites the buckets that it touches and no other.

A manifest names, for each bucket, the folder that holds it. A merge writes new folders for the buckets of its keys and then a new manifest, in one
rename; readers find the old table or the new one. Runs that are repeated with the same batch number change nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators import upsert
from lakeloom.sources.writers import rename_over

MANIFEST = "MANIFEST"


class BucketTable:
    """A table at `path` with unique `keys`. buckets: how many, fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.buckets = self.manifest()["buckets"] if self.manifest() else buckets

    def manifest(self) -> dict | None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.path}/{MANIFEST}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{MANIFEST}", wholetext=True).first()[0])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first write."""
        m = self.manifest()
        if m is None:
            return None
        schema = StructType.fromJson(m["schema"])
        paths = [f"{self.path}/{at}" for k, at in sorted(m["folders"].items(), key=lambda x: int(x[0])) if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, new: DataFrame, overwrite: Sequence[str] = (), keep: Sequence[str] = (), batch: int | None = None) -> list[int]:
        """upsert() of rows unique by key; returns the buckets that were written. Rows with a null in a key are left out, as no key agrees with them.
        A batch whose number is not above the last one's has been merged and is passed over."""
        m = self.manifest() or {"buckets": self.buckets, "schema": new.schema.jsonValue(), "folders": {}, "batch": -1}
        if batch is not None and batch <= m["batch"]:
            return []
        dealt = new.dropna(subset=self.keys).withColumn("__bucket", self.bucket())
        touched = sorted(r[0] for r in dealt.select("__bucket").distinct().collect())  # `buckets` numbers at most
        old = self.read(touched)
        merged = dealt.drop("__bucket")
        if old is not None:
            merged = upsert.upsert(old, merged, self.keys, overwrite, keep)
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            merged.withColumn("__bucket", self.bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        m["folders"] |= {str(k): f"{folder}/__bucket={k}" for k in touched}
        m["batch"] = m["batch"] if batch is None else batch
        rename_over(self.spark, self.path, MANIFEST, json.dumps(m, sort_keys=True))
        return touched

    def vacuum(self) -> None:
        """Remove bucket folders that the manifest no longer names. Readers that began before the last merge must have ended."""
        m = self.manifest()
        if m is None:
            return
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        named = set(m["folders"].values())
        for run in fs.listStatus(hadoop.Path(f"{self.path}/data")):
            name = run.getPath().getName()
            parts = [p.getPath().getName() for p in fs.listStatus(run.getPath()) if p.isDirectory()]
            gone = [p for p in parts if f"data/{name}/{p}" not in named]
            for p in gone if len(gone) < len(parts) else [""]:
                fs.delete(hadoop.Path(f"{self.path}/data/{name}/{p}" if p else f"{self.path}/data/{name}"), True)
