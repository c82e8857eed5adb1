"""Leaf-wise boosting against a plain loop: trees agree split for split, stopping and saving hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import boosting as B

FEATURES = ["a", "b", "c"]
P = B.Growth(rounds=3, leaves=7, rate=0.3, rows=0.8, features=0.7, every=2, least=12, bins=16, patience=5)


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(5)
    rows = []
    for i in range(700):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice([None, 0.0, 1.0, 2.0])
        margin = 6 * a - 3 * b * (c or 0) + rng.gauss(0, 1)
        rows.append((i, a, b, c, margin if i % 97 else None, float(margin > 0), i < 550, i >= 550))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, margin double, win double, early boolean, late boolean").persist()


def replay(rows, cuts, label, loss, k, p):
    """One split after another, every row and every threshold looked at each time."""
    bins = {i: [0 if r[f] is None else sum(e < r[f] for e in cuts[j]) for j, f in enumerate(FEATURES)] for i, r in rows.items()}
    train = [i for i, r in rows.items() if r["early"] and r[label] is not None]
    mean = sum(rows[i][label] for i in train) / len(train)
    start = math.log(mean / (1 - mean)) if loss == "logistic" else mean
    score, trees = dict.fromkeys(rows, start), []
    for t in range(p.rounds):
        chosen = B.chosen_features(len(FEATURES), k, t, p)
        bag = [i for i in train if rows[i][f"bag{t}"]]

        def grad(i):
            if loss == "logistic":
                q = 1 / (1 + math.exp(-score[i]))
                return q - rows[i][label], q * (1 - q)
            return score[i] - rows[i][label], 1.0

        g = {i: grad(i) for i in bag}
        total = lambda ids: (sum(g[i][0] for i in ids), sum(g[i][1] for i in ids))
        worth = lambda s: max(abs(s[0]) - p.l1, 0) ** 2 / (s[1] + p.l2)

        def split(ids):
            best = None
            for f in chosen:
                for b in range(len(cuts[f]) + 1):
                    left, right = [i for i in ids if bins[i][f] <= b], [i for i in ids if bins[i][f] > b]
                    if min(len(left), len(right)) >= p.least:
                        gain = worth(total(left)) + worth(total(right)) - worth(total(ids))
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, b, left, right)
            return best

        leaves = [((), bag, split(bag))]
        while len(leaves) < p.leaves and any(s for _, _, s in leaves):
            at = max((n for n, x in enumerate(leaves) if x[2]), key=lambda n: leaves[n][2][0])
            path, ids, (_, f, b, left, right) = leaves.pop(at)
            leaves += [((*path, (f, b, True)), left, split(left)), ((*path, (f, b, False)), right, split(right))]
        found = {}
        for path, ids, _ in leaves:
            s = total(ids)
            found[path] = -p.rate * math.copysign(max(abs(s[0]) - p.l1, 0), s[0]) / (s[1] + p.l2)
        trees.append(found)
        for i in rows:
            score[i] += next(v for path, v in found.items() if all((bins[i][f] <= b) == side for f, b, side in path))
    return trees, score


def paths(tree, node=0, path=()):
    if tree.left[node] < 0:
        return {path: tree.value[node]}
    f, b = tree.feature[node], tree.cut[node]
    return paths(tree, tree.left[node], (*path, (f, b, True))) | paths(tree, tree.right[node], (*path, (f, b, False)))


def test_trees_of_a_plain_loop(games):
    targets = [B.Target("margin", "squared", "early"), B.Target("win", "logistic", "early")]
    models = B.fit(games.repartition(5), FEATURES, targets, "id", P, keep=2)
    bags = games.select("*", *[B.in_bag("id", t, P).alias(f"bag{t}") for t in range(P.rounds)])
    rows = {r["id"]: r.asDict() for r in bags.collect()}
    out = {r["id"]: r for r in games.select("id", *[m.raw().alias(f"s{k}") for k, m in enumerate(models)]).collect()}
    for k, (m, t) in enumerate(zip(models, targets, strict=True)):
        trees, score = replay(rows, m.cuts, t.label, t.loss, k, P)
        assert [set(paths(x)) for x in m.trees] == [set(x) for x in trees]
        for x, want in zip(m.trees, trees, strict=True):
            assert paths(x) == pytest.approx(want, abs=1e-4)
        assert {i: r[f"s{k}"] for i, r in out.items()} == pytest.approx(score, abs=1e-3)


def test_rounds_stop_and_the_best_counts(games):
    """Labels of pure noise: what is learned does not help on the validation rows, so it stops soon and keeps few trees."""
    noise = games.withColumn("noise", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).cast("double"))
    p = B.Growth(rounds=20, leaves=6, rate=0.5, least=5, bins=16, patience=2)
    m, good = B.fit(noise, FEATURES, [B.Target("noise", "squared", "early", "late"), B.Target("margin", "absolute", "early", "late")], "id", p)
    best = m.losses.index(min(m.losses))
    assert len(m.losses) - 1 - best == p.patience and len(m.trees) == best + 1 < 20
    assert min(good.losses) < 0.5 * good.losses[0] and good.importance()["a"] > 0
    mae = noise.where("late").agg(F.avg(F.abs(good.predict() - F.col("margin")))).first()[0]
    assert mae == pytest.approx(min(good.losses), rel=1e-6)


def test_model_as_text(games):
    (m,) = B.fit(games, FEATURES, [B.Target("win", "logistic")], "id", B.Growth(rounds=2, leaves=4, bins=40))
    again = B.Model.loads(m.dumps())
    assert games.where(F.abs(m.predict() - again.predict()) > 0).count() == 0
    assert games.agg(F.min(m.predict()), F.max(m.predict())).first()[0] > 0


def test_no_rows(games):
    targets = [B.Target("margin", "squared", "none"), B.Target("win", "logistic", "early")]
    m, other = B.fit(games.withColumn("none", F.lit(False)), FEATURES, targets, "id", B.Growth(rounds=1, leaves=3, bins=8))
    assert m.start == 0 and all(len(t.left) == 1 for t in m.trees) and len(other.trees[0].left) > 1
