"""Sinks: tables by season, publishing a set of tables at once, and the response cache."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import upsert


def write_seasons(df: DataFrame, path: str, column: str = "season") -> None:
    """Write a table partitioned by season; seasons that df holds are replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def rename_over(spark: SparkSession, path: str, name: str, text: str) -> None:
    """Put a small file with `text` in the place of path/name in one rename."""
    hadoop, root, fs = _fs(spark, path)
    fs.mkdirs(root)
    fresh, final = hadoop.Path(f"{path}/.{name}.{uuid.uuid4().hex}"), hadoop.Path(f"{path}/{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(root.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(final), how)


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, keep: int = 2) -> str:
    """Write all tables to a folder of their own and then name it current, in one rename of a small file over the last. Readers (see published) find
    all of the old or all of the new at any time; the last `keep` sets stay for those that still read them. Returns the set's name."""
    name = f"set-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{path}/{name}/{table}")
    rename_over(spark, path, POINTER, name)
    hadoop, root, fs = _fs(spark, path)
    old = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("set-"))
    for _, gone in [x for x in old if x[1] != name][: max(len(old) - keep, 0)]:
        fs.delete(hadoop.Path(f"{path}/{gone}"), True)
    return name


def published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the set that is current."""
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}/{table}")


def cache_put(cache: DataFrame, responses: DataFrame, ttl_seconds: float, now=None) -> DataFrame:
    """The cache with responses (endpoint, params_hash, response) fetched now, to expire after ttl_seconds; they replace those of the same request."""
    at = now if now is not None else F.current_timestamp()
    fresh = responses.withColumn("fetched_at", at).withColumn("expires_at", F.timestamp_seconds(F.unix_micros(at) / 1e6 + F.lit(float(ttl_seconds))))
    return upsert.upsert(cache, fresh.select(*cache.columns), ["endpoint", "params_hash"], overwrite=["response", "fetched_at", "expires_at"])


def cache_purge(cache: DataFrame, now=None) -> DataFrame:
    """The cache without what has expired."""
    return cache.where(F.col("expires_at") >= (now if now is not None else F.current_timestamp()))


def cache_clear(cache: DataFrame) -> DataFrame:
    """The cache without any entry."""
    return cache.limit(0)
