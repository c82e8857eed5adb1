"""What the operators of this package share: tables on the shared folder, batches, word patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lakeloom.sources.tables import release, shared_dir, stored

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "CRC32", "map_rows", "SPACE", "WORD", "read", "release", "shared_dir", "short_batches", "stored", "unit_hash"]

#: White space and words as every operator here understands them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch; texts may be long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20

#: crc32 of a text of ASCII characters, as DuckDB has no such function; {0} stands for the text.
CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: rows and bytes are bounded here, whatever the session says. These settings are read when a plan
    runs, so they stay set; they only ever shrink."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:  # a size with a unit counts as large
            spark.conf.set(key, str(most))


def map_rows(rows: DataFrame, op: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, ids: Sequence[str] = ("id",)) -> DataFrame:
    """mapInPandas to the columns `ids`, as they were, and those of `schema`. Ids that are whole numbers travel as text: among nulls pandas would make
    them floats, which hold 53 bits."""
    whole = [c for c in ids if isinstance(rows.schema[c].dataType, IntegralType)]
    text = rows.withColumns({c: F.col(c).cast("string") for c in whole})
    out = text.mapInPandas(op, ", ".join([*[f"{c} {text.schema[c].dataType.simpleString()}" for c in ids], schema]))
    return out.withColumns({c: F.col(c).cast(rows.schema[c].dataType) for c in whole})


def unit_hash(seed: int, *cols: Column) -> Column:
    """A whole number in [0, 2^32) from md5 of the seed and the columns as text: the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
