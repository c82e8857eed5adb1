"""Ranks, quantiles and errors that are dealt by range, against windows and plain loops; leaf-wise models end to end."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import metrics
from lakeloom.operators import boosting, windows
from lakeloom.plans import models, reads


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, 1.5, 2.5, rng.gauss(0, 9)]), rng.randint(0, 2)) for i in range(500)] + [(900, 7, None, 1), (901, 8, 4.0, 0)]
    return spark.createDataFrame(rows, "id long, g int, x double, tries int").repartition(7).persist()


@pytest.mark.parametrize("down", [False, True])
def test_percent_ranks_of_counted_values(table, down):
    among = F.col("tries") > 0
    long = windows.percent_ranks(table.withColumn("y", F.col("x")), ["id"], ["x", "y"], ["g"], ["x", "y"] if down else [], {"y": among})
    one = windows.with_percent_rank(windows.with_percent_rank(table, "all", "x", ["g"], None, down), "some", "x", ["g"], among, down)
    want = table.select("id", windows.percent_rank("x", ["g"], down).alias("all"), windows.percent_rank_among("x", among, ["g"], down).alias("some"))
    key = lambda df, a, b: sorted((r["id"], r[a], r[b]) for r in df.collect())
    near = lambda rows: [(i, pytest.approx(a), None if b is None else pytest.approx(b)) for i, a, b in rows]
    expected = key(want, "all", "some")
    assert key(one, "all", "some") == near(expected) and key(long, "x_pct", "y_pct") == near(expected)
    assert one.columns == [*table.columns, "all", "some"]


def test_percent_rank_of_a_whole_table(table):
    got = windows.with_percent_rank(table, "r", "x").select("id", "r")
    want = table.select("id", windows.percent_rank("x").alias("r"))
    assert {r["id"]: r["r"] for r in got.collect()} == pytest.approx({r["id"]: r["r"] for r in want.collect()})
    assert windows.with_percent_rank(table.where("false"), "r", "x", ["g"]).collect() == []


def test_quantiles_by_range(table):
    at = {"low": 0.0, "q": 0.37, "mid": 0.5, "top": 1.0}
    got = {r["g"]: [r[n] for n in at] for r in windows.quantiles(table, "x", at, ["g"]).collect()}
    rows = [(r["g"], r["x"]) for r in table.collect() if r["x"] is not None]
    want = {g: [float(np.quantile([x for k, x in rows if k == g], q)) for q in at.values()] for g in {k for k, _ in rows}}
    assert set(got) == set(want) == {None, 1, 2, 8} and all(got[g] == pytest.approx(want[g]) for g in want)
    whole = windows.quantiles(table, "x", at).first()
    assert [whole[n] for n in at] == pytest.approx([float(np.quantile([x for _, x in rows], q)) for q in at.values()])
    assert windows.quantiles(table.where("false"), "x", at).collect() == [] == windows.quantiles(table.where("g = 7"), "x", at, ["g"]).collect()


def test_errors_are_those_of_the_summary(table):
    d = table.withColumn("p", F.coalesce("x", F.lit(0.0)) * 0.9).where("x IS NOT NULL")
    for by in ([], ["g"]):
        want = sorted(d.groupBy(*by).agg(*metrics.error_summary("x", "p")).collect(), key=str)
        got = sorted(metrics.errors(d, "x", "p", by).collect(), key=str)
        assert len(got) == len(want) and all(a.asDict() == pytest.approx(b.asDict(), nan_ok=True) for a, b in zip(got, want, strict=True))


def test_leafwise_models_are_kept(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, i // 10, a := rng.gauss(0, 1), b := rng.gauss(0, 1), m := 6 * a - 3 * b + rng.gauss(0, 1), float(m > 0)) for i in range(400)]
    games = spark.createDataFrame(rows, "game_id long, day int, a double, b double, margin double, win double")
    fitted = models.train_leafwise(games, ["a", "b"], "margin", "win", "day", "game_id", boosting.Growth(rounds=3, leaves=6, rate=0.5, bins=16, least=10, features=1.0))
    models.save_leafwise(spark, fitted, str(tmp_path / "m"))
    out, again = (models.predict_leafwise(games, f).orderBy("game_id").collect() for f in (fitted, models.load_leafwise(spark, str(tmp_path / "m"))))
    assert out == again and sum(r["home_wins"] == (r["margin"] > 0) for r in out) > 300 and all(0 < r["pred_win"] < 1 for r in out)
    assert [r["pred_margin"] for r in out] == [pytest.approx(r["x"], abs=0.051) for r in games.select("game_id", fitted[0].predict().alias("x")).orderBy("game_id").collect()]


def test_comparison_takes_up_to_four(table):
    for ids in ([], [1, 2, 3, 4, 5]):
        with pytest.raises(ValueError, match="compared"):
            reads.compare(ids, table, table)


def test_one_archetype_a_player(spark):
    rows = [(1, 2020, "Wing", 0.4), (1, 2020, "Big", 0.6), (1, 2021, "Guard", 0.9), (2, 2020, "Guard", None), (2, 2020, "Big", None)]
    classes = spark.createDataFrame(rows, "player_id long, season int, primary string, primary_score double")
    assert [tuple(r)[:3] for r in reads.archetype(classes, 2020).orderBy("player_id").collect()] == [(1, 2020, "Big"), (2, 2020, "Big")]
    assert reads.archetype(classes, 2021, 1).first()["primary"] == "Guard" and reads.archetype(classes, 2021, 2).collect() == []
