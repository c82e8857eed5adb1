"""Evaluation of predictions as aggregates. A prediction frame has the columns named by the arguments; nothing is collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.exprs import col
from lakeloom.operators.windows import quantiles, running_sum


def error_summary(actual: str, predicted: str) -> list[Column]:
    """mae, rmse, r2, sign accuracy and quantiles of the absolute error (linear between ranks). The quantiles hold the distinct errors of a group in one
    task: for groups of any size see errors()."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = F.abs(a - p)
    return [
        F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.sum(a * a) - F.try_divide(F.sum(a) * F.sum(a), F.count(a)))).alias("r2"),
        F.avg(F.when((a > 0) == (p > 0), 1.0).otherwise(0.0)).alias("sign_accuracy"), *[F.percentile(e, F.lit(q)).alias(n) for n, q in QUANTILES.items()],
    ]


#: Quantiles of the absolute error that a summary has.
QUANTILES = {"median_error": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def errors(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mae, rmse, r2, sign_accuracy, quantiles) as of error_summary, for any number of rows: the quantiles are ranked in ranges and not in
    one aggregation that holds all errors."""
    e = F.abs(F.col(actual).cast("double") - F.col(predicted).cast("double"))
    rest = df.groupBy(*by).agg(*error_summary(actual, predicted)[: -len(QUANTILES)])
    at = quantiles(df.select(*by, e.alias("__e")), "__e", QUANTILES, by)
    if not by:
        return rest.join(at, F.lit(True), "left")
    return rest.join(at.select(*[F.col(c).alias(f"__{c}") for c in by], *QUANTILES), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").drop(*[f"__{c}" for c in by])


def classification_summary(truth: str, probability: str, floor: float = 1e-15) -> list[Column]:
    """accuracy at 0.5 and log loss with clipped probabilities."""
    y, p = F.col(truth).cast("double"), F.least(F.greatest(F.col(probability), F.lit(floor)), F.lit(1 - floor))
    return [F.count("*").alias("n"), F.avg(F.when((F.col(probability) >= 0.5) == (y > 0), 1.0).otherwise(0.0)).alias("accuracy"), (-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss")]


def auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): area under the ROC curve from mean ranks, exact with ties. Scores are counted first, so ranks are made over distinct
    scores and not over rows; null where only one class is there."""
    n = df.groupBy(*by, F.col(score).alias("__s")).agg(F.count("*").alias("__n"), F.sum(F.when(F.col(truth) > 0, 1).otherwise(0)).alias("__p"))
    r = running_sum(n, by, "__s", {"__upto": "__n"}).withColumn("__r", F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2.0)
    pos, neg = F.sum("__p"), F.sum(F.col("__n") - F.col("__p"))
    value = F.try_divide(F.sum(F.col("__r") * F.col("__p")) - pos * (pos + 1) / 2.0, (pos * neg).cast("double"))
    return r.groupBy(*by).agg(value.alias("auc")) if by else r.agg(value.alias("auc"))


def calibration(df: DataFrame, truth: str, probability: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_predicted, observed, abs_error) over equal-width bins of the observed range, the highest value in the last bin."""
    span = df.agg(F.min(probability).alias("__lo"), F.max(probability).alias("__hi"))
    place = F.ceil(F.try_divide(F.col(probability) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins) - 1
    b = df.crossJoin(F.broadcast(span)).withColumn("bin", F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)).cast("long"))
    out = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(probability).alias("mean_predicted"), F.avg(F.col(truth).cast("double")).alias("observed"))
    return out.withColumn("abs_error", F.abs(F.col("mean_predicted") - F.col("observed")))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("abs_error") * F.col("n")) / F.sum("n")).alias("ece"))


def segments(df: DataFrame, parts: Mapping[str, Column], measures: Sequence[Column], least: int = 20) -> DataFrame:
    """(segment, measures...) in one pass: a row goes to each segment whose condition holds; segments of fewer rows are left out."""
    inside = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in parts.items()]), lambda x: x.isNotNull())
    return df.withColumn("segment", F.explode(inside)).groupBy("segment").agg(F.count("*").alias("rows"), *measures).where(F.col("rows") >= least)


def compare_runs(old: DataFrame, new: DataFrame, lower_is_better: Sequence[str]) -> DataFrame:
    """(metric, old, new, change, verdict) for tables (metric, value)."""
    j = old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric")
    gain = F.when(F.col("metric").isin(*lower_is_better), F.col("old") - F.col("new")).otherwise(F.col("new") - F.col("old"))
    return j.withColumn("change", F.col("new") - F.col("old")).withColumn("verdict", F.when(gain > 1e-12, "better").when(gain < -1e-12, "worse").otherwise("same"))


def parity(ours: DataFrame, theirs: DataFrame, key: str, columns: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """(column, n, skipped, max_diff, worst, passed): per column the greatest difference over shared keys and where it is; pairs with a null are
    skipped. Both sides are unpivoted and joined once."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        return df.select(F.col(key), F.explode(pairs).alias("x")).select(key, "x.column", F.col("x.v").alias(name))

    j = long(ours, "a").join(long(theirs, "b"), [key, "column"]).withColumn("d", F.abs(F.col("a") - F.col("b")))
    out = j.groupBy("column").agg(F.count("d").alias("n"), F.count(F.when(F.col("d").isNull(), 1)).alias("skipped"), F.max("d").alias("max_diff"), F.max_by(F.when(F.col("d").isNotNull(), F.col(key)), F.struct("d", -col(key))).alias("worst"))
    return out.withColumn("passed", F.coalesce(F.col("max_diff") < tolerance, F.lit(False)))
