"""Feeds as they land: positional CSV and JSON, keyed JSON payloads, cached responses, and tables with odd nulls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def slices(spark: SparkSession, path: str, seasons: Sequence[int] | None = None, column: str = "season") -> DataFrame:
    """A table, or some of its seasons; with the table partitioned by season only their files are read."""
    df = spark.read.parquet(path)
    return df if seasons is None else df.where(F.col(column).isin(*seasons))


def as_int(c: Column) -> Column:
    """A whole number from number or text, cut toward zero; what is none is null."""
    return F.trim(c.cast("string")).try_cast("double").try_cast("int")


def as_double(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def as_text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


KINDS = {"int": as_int, "double": as_double, "string": as_text}


def positional_csv(spark: SparkSession, path: str, columns: Mapping[str, tuple[int, str]], width: int) -> DataFrame:
    """Headerless CSV by position: columns maps a name to (position, kind). Rows with fewer than width fields are left out."""
    fields = F.from_csv(F.col("value"), ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    # fields are counted outside quotes
    count = F.length(F.regexp_replace(F.regexp_replace("value", '"(?:[^"]|"")*"', ""), "[^,]", "")) + 1
    rows = spark.read.text(path).where(count >= width).select(fields.alias("f"))
    return rows.select(*[KINDS[kind](F.col(f"f.c{i}")).alias(n) for n, (i, kind) in columns.items()])


def positional_json(spark: SparkSession, path: str, columns: Mapping[str, tuple[int, str]], width: int, required: Sequence[str] = ()) -> DataFrame:
    """A JSON array of arrays, plain or gzipped by name: short rows and rows that lack a required column are left out."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    rows = text.where(F.size("r") >= width).select(*[KINDS[kind](F.get("r", F.lit(i))).alias(n) for n, (i, kind) in columns.items()])
    return rows.dropna(subset=list(required)) if required else rows


# Keys of a payload that hold no rows.
META_KEYS = ("meta", "user", "query", "success", "error", "warnings")


def payload_rows(df: DataFrame, payload: str, row_schema: str, meta_keys: Sequence[str] = META_KEYS) -> DataFrame:
    """df's other columns and `row`, one for each row of the payload's first key that is no meta key, which holds an array or an object of objects."""
    keys = F.filter(F.json_object_keys(F.col(payload)), lambda k: ~k.isin(*meta_keys))
    body = F.element_at(F.from_json(F.col(payload), "map<string,string>"), F.get(keys, F.lit(0)))
    listed = F.from_json(body, f"array<{row_schema}>")
    named = F.map_values(F.from_json(body, f"map<string,{row_schema}>"))
    rows = F.when(F.ltrim(body).startswith("["), listed).otherwise(named)
    rest = [c for c in df.columns if c != payload]
    return df.select(*rest, F.explode(rows).alias("row"))


def cached(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Responses that have not expired, the last fetched of each (endpoint, params_hash)."""
    df = spark.read.parquet(path).where(F.col("expires_at") > (now if now is not None else F.current_timestamp()))
    return df.groupBy("endpoint", "params_hash").agg(F.max_by("response", "fetched_at").alias("response"), F.max("fetched_at").alias("fetched_at"))


def params_hash(params: Column) -> Column:
    """Sixteen hex digits of a 64-bit hash."""
    return F.lower(F.lpad(F.hex(F.xxhash64(params)), 16, "0"))


def csv_with_nulls(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header in which empty fields, NA and NaN are null."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = [c.strip().split()[1] for c in schema.split(",")]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names), enforceSchema=False)
    clean = lambda n: F.when(~F.trim(F.col(n)).isin("", "NA", "NaN"), F.trim(F.col(n)))
    return raw.select(*[clean(n).try_cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])
