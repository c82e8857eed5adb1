"""Writes as DataFrame transformations: each returns the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _full(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("o__"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in old.columns], F.lit(True).alias("n__"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    return o.join(n, cond, "full"), rest


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Rows of new by key over those of old: by column the new value where it is there, else the old one. Columns in `overwrite` take the new
    value even where it is null; columns in `keep` take it only where the old one is null. new must be unique by key."""
    both, rest = _full(old, new, keys)

    def value(c: str):
        o, n = F.col(f"o_{c}"), F.col(f"n_{c}")
        if c in overwrite:
            return F.when(F.col("n__"), n).otherwise(o)
        return F.coalesce(o, n) if c in keep else F.coalesce(n, o)

    by = {c: F.coalesce(f"n_{c}", f"o_{c}") for c in keys} | {c: value(c) for c in rest}
    return both.select(*[by[c].alias(c) for c in old.columns])


def last_wins(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A batch with one row a key: by column the last value that is there, in the order of arrival."""
    spec = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = [c for c in batch.columns if c not in keys and c not in order]
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    out = batch.select(*keys, *[F.last(c, ignorenulls=True).over(spec).alias(c) for c in rest], first.alias("__k"))
    return out.where("__k = 1").drop("__k")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new whose key is not there yet are added."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_slice(old: DataFrame, new: DataFrame, slice_col: str) -> DataFrame:
    """Delete and insert by slice: new's slices take the place of old's."""
    return old.join(new.select(slice_col).distinct(), [slice_col], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def fill_nulls(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Update only where the target is null; rows without a source stay. source must be unique by key."""
    s = source.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__v_{c}") for c in columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    out = target.join(s, cond, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__v_{c}")).alias(c) if c in columns else F.col(c) for c in target.columns])


def add_missing_dimension(dim: DataFrame, facts: DataFrame, keys: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Late-arriving dimension rows: keys maps dim columns to fact columns; other columns take defaults or null."""
    given = facts.select(*[F.col(f).alias(d) for d, f in keys.items()]).distinct()
    fresh = given.join(dim.select(*keys), list(keys), "left_anti")
    values = defaults or {}
    return dim.unionByName(fresh.select(*[F.col(c) if c in keys else F.lit(values.get(c)).cast(dim.schema[c].dataType).alias(c) for c in dim.columns]))


def duplicates(entities: DataFrame, facts: DataFrame, entity_id: str, by: Sequence[str]) -> DataFrame:
    """(dup, primary): entities that agree in `by`; the primary has most facts, then the least id. Nulls agree with nothing."""
    n = facts.groupBy(F.col(entity_id).alias("__e")).agg(F.count("*").alias("__n"))
    e = entities.join(n, F.col(entity_id) == F.col("__e"), "left").dropna(subset=list(by))
    w = W.partitionBy(*by).orderBy(F.coalesce("__n", F.lit(0)).desc(), F.col(entity_id).asc())
    e = e.withColumn("primary", F.first(entity_id).over(w))
    return e.where(F.col(entity_id) != F.col("primary")).select(F.col(entity_id).alias("dup"), "primary")


def merge_facts(facts: DataFrame, mapping: DataFrame, entity_id: str, within: Sequence[str]) -> DataFrame:
    """Facts of duplicates go to their primary; of several for the same `within` the primary's own stays, else that of the least former id."""
    m = facts.join(mapping, F.col(entity_id) == F.col("dup"), "left")
    m = m.withColumn("__to", F.coalesce("primary", entity_id))
    k = F.row_number().over(W.partitionBy("__to", *within).orderBy(F.col("dup").isNotNull(), F.col(entity_id)))
    kept = m.withColumn("__k", k).where("__k = 1")
    return kept.select(*[F.col("__to").alias(c) if c == entity_id else F.col(c) for c in facts.columns])


def resolvable(facts: DataFrame, known: Mapping[str, DataFrame]) -> DataFrame:
    """Facts whose keys all stand in their dimension (column to a table with that column); null keys stand in none."""
    for column, dimension in known.items():
        facts = facts.join(dimension.select(column), [column], "left_semi")
    return facts
