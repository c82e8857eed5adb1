"""Ratings by rounds of joins against the solver, k-means of all starts at once, lookup by the beginning of a name."""

import random

import numpy as np
import pytest

from lakeloom.operators import joins, ratings, similarity

EDGES = "season int, team_id long, opponent_id long, pts double, poss double, games double"


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(4)
    rows = [(s, t, o, float(rng.randint(50, 99)), float(rng.randint(55, 80)), float(rng.randint(1, 3))) for s, n in ((1, 6), (2, 9)) for t in range(n) for o in range(n) if t != o and rng.random() < 0.7]
    rows.append((1, 2, 77, 60.0, 66.0, 1.0))  # an opponent without a row of its own
    return spark.createDataFrame(rows, EDGES).persist()


@pytest.mark.parametrize("universe", ["offense", "union"])
@pytest.mark.parametrize("tol", [0.0, 0.5])
def test_rounds_of_joins_equal_the_solver(edges, universe, tol):
    read = lambda df: {(r["season"], r["team_id"]): (r["off"], r["def"], r["sos"]) for r in df.collect()}
    want = read(ratings.adjusted(edges, 5, tol, universe=universe))
    got = read(ratings.adjusted(edges, 5, tol, universe=universe, most_edges=0))
    mixed = read(ratings.adjusted(edges, 5, tol, universe=universe, most_edges=25))
    assert set(got) == set(want) == set(mixed)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9) and mixed[k] == pytest.approx(want[k], abs=1e-9)


def test_rounds_keep_groups_without_a_key(spark, edges):
    from pyspark.sql import functions as F

    lost = edges.withColumn("season", F.when(F.col("season") == 2, F.col("season")))
    want = {(r["season"] or 1, r["team_id"]): r["off"] for r in ratings.adjusted(edges, 3, 0.0).collect()}
    got = {(r["season"] or 1, r["team_id"]): r["off"] for r in ratings.adjusted_by_rounds(lost, 3, 0.0).collect()}
    assert got == pytest.approx(want)


def test_kmeans_finds_the_clusters_whatever_the_partitions(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 4)) * 12
    rows = [(2**60 + i, (middle[i % 6] + rng.normal(size=4) * 0.3).tolist()) for i in range(600)] + [(None, middle[0].tolist()), (7, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    fits = [similarity.kmeans(df.repartition(n), "id", "v", 6, seeds=4) for n in (1, 7)]
    (one, c1), (two, c2) = [(sorted(map(tuple, f.collect()), key=str), c) for f, c in fits]
    assert one == two and c1 == c2 and len(one) == 601
    assert all(min(np.linalg.norm(np.array(c) - m) for c in c1) < 0.3 for m in middle)
    kinds = {}
    for i, cluster in one:
        if i is not None:
            kinds.setdefault((i - 2**60) % 6, set()).add(cluster)
    assert all(len(v) == 1 for v in kinds.values()) and len(set.union(*kinds.values())) == 6


def test_kmeans_reaches_a_local_optimum_of_plain_rounds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 3))
    _, centroids = similarity.kmeans(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "id", "v", 4, seeds=6, rounds=60)
    c = np.array(centroids)
    cost = lambda c: np.square(x[:, None] - c[None]).sum(axis=2).min(axis=1).sum()
    at = np.square(x[:, None] - c[None]).sum(axis=2).argmin(axis=1)
    assert np.abs(np.array([x[at == k].mean(axis=0) for k in range(4)]) - c).max() < 1e-3  # a fixed point
    plain = []
    for s in range(6):
        p = x[np.random.default_rng(s).choice(len(x), 4, replace=False)]
        for _ in range(60):
            at = np.square(x[:, None] - p[None]).sum(axis=2).argmin(axis=1)
            p = np.array([x[at == k].mean(axis=0) if (at == k).any() else p[k] for k in range(4)])
        plain.append(cost(p))
    assert cost(c) <= np.median(plain)


def test_kmeans_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id int, v array<double>")
    got, centroids = similarity.kmeans(few, "id", "v", 3, seeds=2)
    assert len(centroids) == 3 and {r["cluster"] for r in got.collect()} == {0}
    got, centroids = similarity.kmeans(few.limit(0), "id", "v", 3, seeds=2)
    assert centroids == [] and got.collect() == []
    assert similarity.archetypes(few.limit(0), "id", "v", {"a": [1.0, 0.0]}, 2).collect() == []


def test_lookup_by_prefix(spark):
    names = spark.createDataFrame([(1, "Duke"), (2, "Dukes"), (3, "Duke City"), (4, "dayton"), (5, None), (6, "Dab")], "id int, name string")
    asked = spark.createDataFrame([("DUKE",), ("duke",), ("dukes",), ("d",), ("duke c",), ("x",), ("",), (None,)], "q string")
    got = {r["q"]: r["id"] for r in joins.lookup_by_prefix(asked, "q", joins.prefix_index(names, "name", ["id"])).collect()}
    assert got == {"DUKE": 1, "duke": 1, "dukes": 2, "d": 6, "duke c": 3, "": 6}
