"""Streams of the same feeds: upserts by micro-batch, late and corrected rows, sessions of windows, and state by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeloom.operators import upsert
from lakeloom.sources.bucketed import BucketTable


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, keep: int = 3):
    """Keep the table at `path` up to date: each batch is made unique by key (last wins) and merged. The merged table is written to a folder of
    its own by batch number and only then named current, so a batch that is run again gives the same table. Each batch writes the whole
    table, as plain files need it; the last `keep` versions stay."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = upsert.last_wins(batch, keys, order)
        old = current(spark, path, before=number)
        table = upsert.upsert(old.select(*fresh.columns), fresh, keys) if old is not None else fresh
        table.write.mode("overwrite").parquet(f"{path}/v{number:09d}")
        _drop_before(spark, path, number - keep + 1)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def merge_stream(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, buckets: int = 64):
    """Keep a BucketTable at `path` up to date: each batch is made unique by key (last wins) and merged, which writes the buckets of its keys alone. A
    batch that is run again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        table = BucketTable(batch.sparkSession, path, keys, buckets)
        table.merge(upsert.last_wins(batch, keys, order), batch=number)
        table.vacuum()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def enrich_stream(stream: DataFrame, dimension: Callable[[SparkSession], DataFrame], key: str, path: str, missing: str, checkpoint: str):
    """Facts of a stream with the columns of their dimension, in folders of `path` by batch; facts whose key the dimension lacks, or is null, go to folders of
    `missing` instead, as they came. The dimension is asked for anew with each batch, so it may be refreshed at any time. It is unique by key."""

    def join(batch: DataFrame, number: int) -> None:
        dim = dimension(batch.sparkSession)
        facts = batch.persist()
        facts.join(dim, [key]).write.mode("overwrite").parquet(f"{path}/batch={number}")
        facts.join(dim.select(key), [key], "left_anti").write.mode("overwrite").parquet(f"{missing}/batch={number}")
        facts.unpersist()

    return stream.writeStream.foreachBatch(join).option("checkpointLocation", checkpoint).outputMode("append")


def _drop_before(spark: SparkSession, path: str, number: int) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in [p.getPath().getName() for p in fs.listStatus(hadoop.Path(path))]:
        if name.startswith("v") and name[1:].isdigit() and int(name[1:]) < number:
            fs.delete(hadoop.Path(f"{path}/{name}"), True)


def late_dimension(stream: DataFrame, dimension: DataFrame, key: str, path: str, checkpoint: str, defaults: Mapping[str, object] | None = None):
    """Keys of a stream of facts that `dimension` lacks are added to the table at `path`, once each, with `defaults` for the other columns (else
    null); facts that come before their dimension thus find one."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = current(spark, path, before=number)
        known = known if known is not None else dimension
        new = batch.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), [key], "left_anti")
        rest = [F.lit((defaults or {}).get(f.name)).cast(f.dataType).alias(f.name) if f.name != key else F.col(key).cast(f.dataType) for f in known.schema.fields]
        known.unionByName(new.select(*rest)).write.mode("overwrite").parquet(f"{path}/v{number:09d}")
        _drop_before(spark, path, number - 2)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append")


def unexpired(stream: DataFrame, time: str, keys: Sequence[str], ttl: str = "1 hour") -> DataFrame:
    """Rows of a stream whose keys were not seen within `ttl` of event time: what was seen is kept as state and dropped when it expires."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(list(keys))


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last complete version of an upserted table, or None."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted(p.getPath().getName() for p in fs.listStatus(root))
    done = [n for n in names if n.startswith("v") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")) and (before is None or int(n[1:]) < before)]
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None


def windowed(stream: DataFrame, time: str, keys: Sequence[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window, with late rows allowed for `late`."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def rolling_state(stream: DataFrame, key: str, time: str, value: str, n: int = 5) -> DataFrame:
    """(key, time, value, prior_mean): the mean of the n values before each row by key, kept as state of n numbers. Rows are put in order within a
    batch; a row that is late by a batch counts from then on and changes nothing that was given out."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        out = []
        for t, x in pd.concat(rows)[[time, value]].sort_values(time).itertuples(index=False):
            out.append((k[0], t, x, sum(seen) / len(seen) if seen else None))
            if not pd.isna(x):
                seen = [*seen, float(x)][-n:]
        state.update((seen,))
        yield pd.DataFrame(out, columns=[key, time, value, "prior_mean"])

    return stream.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} {kinds[time]}, {value} {kinds[value]}, prior_mean double", "seen array<double>", "append", GroupStateTimeout.NoTimeout)
