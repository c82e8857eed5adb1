"""Margin and win models over matchup features, with Spark's gradient-boosted trees."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions import metrics
from lakeloom.operators import boosting


@dataclass(frozen=True)
class Params:
    trees: int = 60
    depth: int = 4
    rate: float = 0.1
    share: float = 0.7
    seed: int = 42


def chronological(df: DataFrame, day: str, tie: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first share of rows by day, and the rest. The cut is found from counts by day; only rows of the day that it falls on are ranked."""
    days = df.groupBy(day).agg(F.count("*").alias("__n"))
    total = F.sum("__n").over(W.partitionBy(F.lit(1)))
    before = F.sum("__n").over(W.partitionBy(F.lit(1)).orderBy(day).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    cuts = days.withColumn("__left", F.floor(total * share) - before).select(F.col(day).alias("__d"), "__n", "__left")
    j = df.join(cuts, F.col(day) == F.col("__d"))
    k = F.row_number().over(W.partitionBy(day).orderBy(tie))
    first = F.when(F.col("__left") >= F.col("__n"), F.lit(True)).when(F.col("__left") <= 0, F.lit(False)).otherwise(k <= F.col("__left"))
    j = j.withColumn("__first", first).drop("__d", "__n", "__left")
    return j.where("__first").drop("__first"), j.where("NOT __first").drop("__first")


def train(df: DataFrame, features: Sequence[str], margin: str, win: str, p: Params = Params()) -> tuple[PipelineModel, PipelineModel]:  # noqa: B008
    """Regressor of the margin and classifier of the win; rows that lack a feature are left out."""
    d = df.dropna(subset=[*features, margin, win])
    parts = VectorAssembler(inputCols=list(features), outputCol="features")
    shared = {"featuresCol": "features", "maxIter": p.trees, "maxDepth": p.depth, "stepSize": p.rate, "subsamplingRate": p.share, "seed": p.seed}
    return Pipeline(stages=[parts, GBTRegressor(labelCol=margin, predictionCol="pred_margin", **shared)]).fit(d), Pipeline(stages=[parts, GBTClassifier(labelCol=win, predictionCol="pred_class", **shared)]).fit(d)


def best_rounds(first: DataFrame, rest: DataFrame, features: Sequence[str], margin: str, win: str, p: Params = Params()) -> tuple[int, int]:  # noqa: B008
    """Numbers of trees at which the margin's absolute error and the win's loss on `rest` are least, for models of p trained on `first`."""
    fitted = train(first, features, margin, win, p)
    d = rest.dropna(subset=[*features, margin, win])
    losses = [m.stages[-1].evaluateEachIteration(m.stages[0].transform(d), *how) for m, how in zip(fitted, (("absolute",), ()), strict=True)]
    return tuple(int(np.argmin(x)) + 1 for x in losses)


def refit(df: DataFrame, day: str, tie: str, features: Sequence[str], margin: str, win: str, p: Params = Params()) -> tuple[tuple[PipelineModel, PipelineModel], dict]:  # noqa: B008
    """Models of all rows with the numbers of trees that served the last fifth by day best, and their metadata."""
    first, rest = chronological(df, day, tie)
    trees = best_rounds(first, rest, features, margin, win, p)
    fitted = tuple(train(df, features, margin, win, replace(p, trees=n))[k] for k, n in enumerate(trees))
    return fitted, {"features": list(features), "trees": list(trees), "rows": df.count()}


def predict(df: DataFrame, models: tuple[PipelineModel, PipelineModel]) -> DataFrame:
    """df with pred_margin (to 0.1), pred_win (to 0.001) and the winner by sign of the margin; all candidate matchups in one job."""
    out = models[1].transform(models[0].transform(df).drop("features"))
    out = out.withColumn("pred_win", F.round(vector_to_array("probability")[1], 3)).withColumn("pred_margin", F.round("pred_margin", 1))
    return out.drop("features", "rawPrediction", "probability", "pred_class").withColumn("home_wins", F.col("pred_margin") > 0)


def cross_validate(df: DataFrame, features: Sequence[str], margin: str, win: str, key: str, folds: int = 5, p: Params = Params()) -> DataFrame:  # noqa: B008
    """(fold, n, mae, ..., auc) over folds by hash of the key."""
    d = df.withColumn("fold", F.pmod(F.xxhash64(F.lit(p.seed), key), F.lit(folds)).cast("int")).persist()
    out = None
    for f in range(folds):
        scored = predict(d.where(F.col("fold") == f), train(d.where(F.col("fold") != f), features, margin, win, p))
        row = scored.agg(*metrics.error_summary(margin, "pred_margin")).withColumn("fold", F.lit(f)).crossJoin(metrics.auc(scored, win, "pred_win"))
        out = row if out is None else out.unionByName(row)
    return out


def train_leafwise(df: DataFrame, features: Sequence[str], margin: str, win: str, day: str, tie: str, p: boosting.Growth = boosting.Growth(), share: float = 0.8) -> list[boosting.Model]:  # noqa: B008
    """Margin and win models grown leaf by leaf over the first share of rows by day; the rest stops their rounds. Both take part in the same passes."""
    first, rest = chronological(df, day, tie, share)
    rows = first.withColumn("__early", F.lit(True)).unionByName(rest.withColumn("__early", F.lit(False))).withColumn("__late", ~F.col("__early"))
    return boosting.fit(rows, features, [boosting.Target(margin, "squared", "__early", "__late"), boosting.Target(win, "logistic", "__early", "__late")], tie, p)


def predict_leafwise(df: DataFrame, fitted: Sequence[boosting.Model]) -> DataFrame:
    """As predict(), by leaf-wise models."""
    out = boosting.scored(boosting.scored(df, fitted[0], "pred_margin"), fitted[1], "pred_win")
    return out.withColumn("pred_margin", F.round("pred_margin", 1)).withColumn("pred_win", F.round("pred_win", 3)).withColumn("home_wins", F.col("pred_margin") > 0)


def save_leafwise(spark: SparkSession, fitted: Sequence[boosting.Model], path: str) -> None:
    """A row of JSON a model, in order, so that requests load what was trained once."""
    spark.createDataFrame([(k, m.dumps()) for k, m in enumerate(fitted)], "k int, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_leafwise(spark: SparkSession, path: str) -> list[boosting.Model]:
    return [boosting.Model.loads(r["model"]) for r in spark.read.parquet(path).orderBy("k").collect()]


def importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def save(spark: SparkSession, models: tuple[PipelineModel, PipelineModel], path: str, meta: dict) -> None:
    """Models and their metadata (features, sizes, scores) under one folder of any file system."""
    models[0].write().overwrite().save(f"{path}/margin")
    models[1].write().overwrite().save(f"{path}/win")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[tuple[PipelineModel, PipelineModel], dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return (PipelineModel.load(f"{path}/margin"), PipelineModel.load(f"{path}/win")), meta
