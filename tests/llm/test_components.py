"""Connected components: the same by contraction and by rounds of steps, and few tables where there are few links."""

import random

import pytest

from lakeloom.llm import components as module
from lakeloom.llm.components import components


def least(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def links(seed=5):
    """Long paths in mixed order, a hub, cliques, negative and large ids, repeated links."""
    rng = random.Random(seed)
    path = rng.sample(range(-5_000, 5_000), 900)
    out = [*zip(path, path[1:], strict=False), *((9_000, 9_001 + i) for i in range(400))]
    out += [(20_000 + 10 * k + i, 20_000 + 10 * k + j) for k in range(30) for i in range(5) for j in range(i)]
    out += [((1 << 62) + i, i - (1 << 62)) for i in range(20)] + out[:50]
    rng.shuffle(out)
    return [(b, a) if rng.random() < 0.5 else (a, b) for a, b in out]


@pytest.fixture
def tables(monkeypatch):
    found = []
    monkeypatch.setattr(module, "stored", lambda df, name, real=module.stored: found.append(name) or real(df, name))
    return found


def got(spark, edges, parts, **more):
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(parts), **more).collect()
    assert len(rows) == len({r["v"] for r in rows})
    return {r["v"]: r["c"] for r in rows}


def test_few_links_take_no_rounds_however_they_are_dealt(spark, tables):
    """Dealt over 60 tasks, each of which sees little of a path, links took rounds of shuffles before, two tables each."""
    edges = links()
    assert got(spark, edges, 60) == least(edges)
    assert len(tables) == 2


@pytest.mark.parametrize("nodes", [3, 60, 1_500])
def test_more_links_than_a_task_takes(spark, tables, nodes):
    edges = links(nodes)
    assert got(spark, edges, 7, nodes=nodes) == least(edges)
    assert len(tables) > 2


def test_loops_alone_and_no_links(spark):
    assert got(spark, [(1, 1), (2, 2)], 2) == {} == got(spark, [], 2)
