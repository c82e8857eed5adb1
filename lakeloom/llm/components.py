"""Connected components of link tables. Tasks contract what they hold; tables of more links than a task takes go on by alternating large-star and
small-star steps (each an aggregation and a join)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import stored


#: Nodes that a task holds at a time.
NODES = 200_000


def _contracted(edges: DataFrame, nodes: int, roots: bool = False) -> DataFrame:
    """Each task replaces its links, `nodes` nodes at a time, by links from every node to the least node that they connect it with; with `roots` by
    one from that to itself, too."""

    def op(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p] if p in up else p
            return x

        def out():
            pairs = [(x, r) for x in up if (r := root(x)) != x or roots]
            up.clear()
            return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > nodes:
                yield out()
        yield out()

    return edges.select("a", "b").mapInPandas(op, "a long, b long")


#: A step broadcasts the least neighbours of at most so many nodes, those with the most links.
HOT = 10_000


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One step on at most `rows` links (a, b) with a > b. A node of more than its share of the links, of which there are HOT at most, is joined
    by broadcast, so that its links stay where they are; all others meet theirs by shuffle."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "d")
    most = max(200, 2 * rows // HOT + 1)
    hot, cold = F.broadcast(least.where(F.col("d") > most)), least.where(F.col("d") <= most)
    joined = near.join(hot, F.col("u") == F.col("w")).unionByName(near.join(hot, F.col("u") == F.col("w"), "left_anti").join(cold.hint("merge"), F.col("u") == F.col("w")))
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has either one link to a lesser node or links from greater ones only."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    loose = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1")
    return not loose.agg(F.count("*")).first()[0]


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60, nodes: int = NODES) -> DataFrame:
    """(v, c): for each node of links (a long, b long) the least node it is connected with. Loops and repeated links do no harm; without
    links the result is empty.

    Links are first contracted where they are. If at most nodes / 2 are left, with `nodes` nodes at most, a last task contracts those: their shuffles would
    take longer than they do, and the more so the more partitions there are. Otherwise tasks of about `nodes` links contract them again and rounds
    of steps follow until the links are stars, or few enough. Each round's links are written to the shared folder; only counts reach the driver.
    """
    e = stored(_contracted(edges.where("a <> b"), nodes), name)
    n = e.count()
    if n > nodes // 2:
        e = stored(_contracted(e.coalesce(n // nodes + 1), nodes).distinct(), name)
        n = e.count()
    for _ in range(most_rounds):
        if n <= nodes // 2:
            return stored(_contracted(e.coalesce(1), nodes, roots=True), name).select(F.col("a").alias("v"), F.col("b").alias("c"))
        if _settled(e):
            break
        e = stored(_star(stored(_star(e, True, n), name), False, 2 * n), name)
        n = e.count()
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("b").alias("v")).distinct().withColumn("c", F.col("v"))
    return e.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(roots)
