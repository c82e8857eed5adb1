"""Models over a table in which the answer is known: quality, folds, importance, best number of trees, saving."""

import random

import pytest

from lakeloom.functions import metrics
from lakeloom.plans import models

FEATURES = ["a", "b", "noise"]
SMALL = models.Params(trees=8, depth=3, rate=0.3, share=0.9)


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        a, b, noise = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        margin = 8 * a - 4 * b + rng.gauss(0, 2)
        rows.append((i, 20240101 + i // 10, a, b, noise, margin, float(margin > 0)))
    return spark.createDataFrame(rows, "game_id long, day int, a double, b double, noise double, margin double, win double").persist()


def test_chronological_cut(games):
    first, rest = models.chronological(games, "day", "game_id")
    assert (first.count(), rest.count()) == (480, 120) and first.agg({"day": "max"}).first()[0] <= rest.agg({"day": "min"}).first()[0]


def test_models_learn_and_are_kept(spark, games, tmp_path):
    first, rest = models.chronological(games, "day", "game_id")
    fitted = models.train(first, FEATURES, "margin", "win", SMALL)
    out = models.predict(rest, fitted)
    assert out.agg(*metrics.error_summary("margin", "pred_margin")).first()["mae"] < 4 and metrics.auc(out, "win", "pred_win").first()[0] > 0.9
    names = [n for n, _ in models.importance(fitted[0], FEATURES)]
    assert names[0] == "a" and names[-1] == "noise"
    models.save(spark, fitted, str(tmp_path / "m"), {"features": FEATURES})
    again, meta = models.load(spark, str(tmp_path / "m"))
    assert meta == {"features": FEATURES}
    key = lambda df: sorted((r["game_id"], r["pred_margin"], r["pred_win"]) for r in df.collect())
    assert key(models.predict(rest, again)) == key(out)


def test_folds_cover_all(games):
    rows = models.cross_validate(games, FEATURES, "margin", "win", "game_id", 3, SMALL).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2] and sum(r["n"] for r in rows) == 600 and all(r["mae"] < 4.5 and r["auc"] > 0.85 for r in rows)


def test_refit_takes_the_best_number_of_trees(games):
    first, rest = models.chronological(games, "day", "game_id")
    best = models.best_rounds(first, rest, FEATURES, "margin", "win", SMALL)
    fitted, meta = models.refit(games, "day", "game_id", FEATURES, "margin", "win", SMALL)
    assert meta["trees"] == list(best) and [m.stages[-1].getNumTrees for m in fitted] == list(best) and meta["rows"] == 600
