"""Window operators. Every order names where nulls go and ends in a key that makes it total."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.exprs import col, ordered
from lakeloom.sources.tables import stored

Keys = Sequence[Column | str]


def series(by: Keys, order: Keys) -> WindowSpec:
    return W.partitionBy(*[col(c) for c in by]).orderBy(*[c if isinstance(c, Column) else ordered(c) for c in order])


def prior(by: Keys, order: Keys, n: int | None = None) -> WindowSpec:
    """The n rows before the current one, or all of them; the current one is left out."""
    return series(by, order).rowsBetween(W.unboundedPreceding if n is None else -n, -1)


def expanding_mean(x, by: Keys, order: Keys) -> Column:
    return F.avg(col(x)).over(prior(by, order))


def cumulative(x, by: Keys, order: Keys) -> Column:
    """Sum of all earlier rows; 0 for the first."""
    return F.coalesce(F.sum(col(x)).over(prior(by, order)), F.lit(0))


def cumulative_wavg(x, w, by: Keys, order: Keys) -> Column:
    """Weighted mean of all earlier rows; null before the first weight."""
    spec = prior(by, order)
    return F.try_divide(F.sum(col(x) * col(w)).over(spec), F.sum(col(w)).over(spec))


def running_index(by: Keys, order: Keys) -> Column:
    return (F.row_number().over(series(by, order)) - 1).cast("long")


def percent_rank(x, by: Keys = (), descending: bool = False) -> Column:
    """Nulls count as rows: last when ascending, first when descending."""
    return F.percent_rank().over(W.partitionBy(*[col(c) for c in by] or [F.lit(1)]).orderBy(ordered(x, descending, nulls_last=not descending)))


def percent_rank_among(x, among: Column, by: Keys = (), descending: bool = False) -> Column:
    """percent_rank among the rows where `among` holds; null elsewhere."""
    inside = F.when(among, 1).otherwise(0)
    return F.when(among, percent_rank(x, [*by, inside], descending))


def percent_ranks(df: DataFrame, key: Keys, metrics: Sequence[str], by: Keys = (), descending: Sequence[str] = (), among: Mapping[str, Column] | None = None) -> DataFrame:
    """key, by and for each metric <metric>_pct; nulls last when ascending, first when descending. among: for some metrics a condition; rows where it does
    not hold have no rank and count for none. Values are counted first and the counts are summed up in ranges, so neither a group nor a
    metric is ordered in one task, however many distinct values it has; rows then look their value up."""
    ids = [*key, *by]
    inside = {m: F.coalesce(c, F.lit(False)) for m, c in (among or {}).items()}
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x"), inside.get(m, F.lit(True)).alias("in")) for m in metrics]
    long = df.select(*ids, F.explode(F.array(*values)).alias("m")).select(*ids, "m.metric", "m.x", "m.in")
    down = F.col("metric").isin(*descending) if descending else F.lit(False)
    # descending ranks with nulls first equal ascending ranks of the negated value with nulls first
    nulls = F.when(F.col("x").isNull(), F.when(down, 0).otherwise(2)).otherwise(1)
    order = F.struct(nulls.alias("nulls"), F.when(down, -F.col("x")).otherwise(F.col("x")).alias("x"))
    counts = stored(long.where("in").groupBy(*by, "metric", "x").agg(F.count("*").alias("n")).withColumn("__o", order), "counts")
    summed = running_sum(counts, [*by, "metric"], "__o", {"upto": "n"})
    total = counts.groupBy(*[F.col(c).alias(f"__t_{c}") for c in [*by, "metric"]]).agg(F.sum("n").alias("total"))
    summed = summed.join(total, [F.col(c).eqNullSafe(F.col(f"__t_{c}")) for c in [*by, "metric"]])
    rank = F.coalesce(F.try_divide((F.col("upto") - F.col("n")).cast("double"), F.col("total") - 1), F.lit(0.0))
    ranks = summed.select(*[F.col(c).alias(f"__{c}") for c in [*by, "metric", "x"]], rank.alias("r"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, "metric", "x"]]
    looked = long.join(ranks, same, "left").withColumn("r", F.when(F.col("in"), F.col("r")))
    return looked.groupBy(*ids).agg(*[F.max(F.when(F.col("metric") == m, F.col("r"))).alias(f"{m}_pct") for m in metrics])


def with_percent_rank(df: DataFrame, out: str, x: str, by: Keys = (), among: Column | None = None, descending: bool = False) -> DataFrame:
    """df with percent_rank_among as a column (percent_rank where `among` is not given), for groups of any size: values are counted, the counts are summed up in
    ranges, and rows look their value up. df is read twice."""
    inside = F.coalesce(among, F.lit(False)) if among is not None else F.lit(True)
    marked = df.withColumn("__in", inside).withColumn("__x", F.col(x).cast("double"))
    nulls = F.when(F.col("__x").isNull(), 0 if descending else 2).otherwise(1)
    order = F.struct(nulls.alias("nulls"), (-F.col("__x") if descending else F.col("__x")).alias("x"))
    counts = stored(marked.where("__in").groupBy(*by, "__x").agg(F.count("*").alias("n")).withColumn("__o", order), "counts")
    total = counts.groupBy(*[col(c).alias(f"__t_{c}") for c in by]).agg(F.sum("n").alias("total"))
    summed = running_sum(counts, by, "__o", {"upto": "n"})
    summed = summed.join(total, [col(c).eqNullSafe(F.col(f"__t_{c}")) for c in by]) if by else summed.crossJoin(F.broadcast(total))
    rank = F.coalesce(F.try_divide((F.col("upto") - F.col("n")).cast("double"), F.col("total") - 1), F.lit(0.0))
    ranks = summed.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__x").alias("__kx"), rank.alias("__r"))
    found = marked.join(ranks, [*[F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by], F.col("__x").eqNullSafe(F.col("__kx"))], "left")
    return found.select(*df.columns, F.when(F.col("__in"), F.col("__r")).alias(out))


def quantiles(df: DataFrame, value: str, at: Mapping[str, float], by: Keys = ()) -> DataFrame:
    """(by..., a column for each of `at`): exact quantiles, linear between ranks; nulls don't count. Values are counted and ranked in ranges, so no task holds
    the values of a group; a group without values has no row."""
    x = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("n"))
    counts = stored(x, "counts")
    total = counts.groupBy(*[col(c).alias(f"__t_{c}") for c in by]).agg(F.sum("n").alias("total"))
    summed = running_sum(counts, by, "__x", {"upto": "n"})
    summed = summed.join(total, [col(c).eqNullSafe(F.col(f"__t_{c}")) for c in by]) if by else summed.crossJoin(F.broadcast(total))
    out = {}
    for name, q in at.items():
        place = (F.col("total") - 1) * F.lit(float(q))
        holds = lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto"))
        out[name] = [F.max(F.when(holds(r(place)), F.col("__x"))).alias(f"{name}_{k}") for k, r in (("lo", F.floor), ("hi", F.ceil))]
        out[name].append(F.max(place - F.floor(place)).alias(f"{name}_part"))
    found = summed.groupBy(*by).agg(*[c for cols in out.values() for c in cols])
    if not by:
        found = found.where(F.col(f"{next(iter(at))}_lo").isNotNull())
    between = lambda n: F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")
    return found.select(*by, *[between(n).alias(n) for n in at])


def running_sum(df: DataFrame, by: Keys, order: str, sums: Mapping[str, str]) -> DataFrame:
    """df with sums (name to column) over the rows of its group up to each one, in order of a column that is unique in the group. Rows are dealt by range,
    so a group is summed in as many tasks as it fills, and one row a task and group gives what the tasks before hold."""
    keys = [col(c) for c in by]
    dealt = stored(df.repartitionByRange(*keys, F.col(order)).withColumn("__task", F.spark_partition_id()), "dealt")
    totals = dealt.groupBy(*by, "__task").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*by or [F.lit(1)]).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__task").alias("__t"), *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    here = W.partitionBy(*by, "__task").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(c).over(here).alias(f"__h_{n}") for n, c in sums.items()]).join(starts, [F.col("__task") == F.col("__t"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]])
    return out.select(*df.columns, *[(F.col(f"__h_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums])


def rank_of(x, by: Keys = (), descending: bool = True, dense: bool = False) -> Column:
    """rank or dense_rank as long, nulls last."""
    spec = W.partitionBy(*[col(c) for c in by] or [F.lit(1)]).orderBy(ordered(x, descending))
    return (F.dense_rank() if dense else F.rank()).over(spec).cast("long")


def row_number(by: Keys, order: Keys) -> Column:
    return F.row_number().over(series(by or [F.lit(1)], order)).cast("long")


def top_n(df: DataFrame, by: Keys, order: Keys, n: int) -> DataFrame:
    """The first n rows of each group. Filters on a rank below a constant become a group limit before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(series(by, order))).where(F.col("__rank") <= n).drop("__rank")


def distinct_on(df: DataFrame, by: Keys, order: Keys) -> DataFrame:
    """One row a group, the first in order."""
    return top_n(df, by, order, 1)


def share_of_total(x, by: Keys = ()) -> Column:
    """x over its sum in the group; null where the sum is 0."""
    return F.try_divide(col(x).cast("double"), F.sum(col(x)).over(W.partitionBy(*[col(c) for c in by] or [F.lit(1)])))
