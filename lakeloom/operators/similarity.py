"""Vectors: neighbours by distance, soft membership of clusters, k-means with named classes, and shares of classes by group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.sources.tables import stored


def distance(a, b) -> Column:
    """Euclidean distance of two number arrays, in double."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def nearest(df: DataFrame, target: DataFrame, id_col: str, vector: str, k: int = 10) -> DataFrame:
    """The k rows nearest to the one row of target, itself left out, with distance and similarity; ties by id."""
    t = target.select(F.col(id_col).alias("__id"), F.col(vector).alias("__v")).limit(1)
    d = df.crossJoin(F.broadcast(t)).where(F.col(id_col) != F.col("__id")).withColumn("distance", distance(F.col(vector), F.col("__v")))
    return d.select(id_col, "distance", (1.0 / (1.0 + F.col("distance"))).alias("similarity")).orderBy("distance", id_col).limit(min(max(k, 1), 50))


def standardize(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """z-scores by population deviation; a constant feature gives 0. Means and deviations are one aggregation, joined to the rows."""
    of = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(*[F.avg(c).alias(f"__m_{c}") for c in features], *[F.stddev_pop(c).alias(f"__s_{c}") for c in features])
    j = df.join(of, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]) if by else df.crossJoin(F.broadcast(of))  # without groups: one row
    return j.select(*[c for c in df.columns if c not in features], *[F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)).alias(c) for c in features])


def affinities(vector, centroids: Sequence[Sequence[float]], names: Sequence[str], temperature: float = 1.5) -> Column:
    """Map of class to softmax(-distance / temperature), which sums to 1."""
    near = [distance(vector, F.array(*[F.lit(float(x)) for x in c])) for c in centroids]
    least = F.least(*near) if len(near) > 1 else near[0]
    e = [F.exp((least - d) / temperature) for d in near]
    total = sum(e[1:], e[0])
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[x / total for x in e]))


def first_two(affinity) -> tuple[Column, Column]:
    """Structs (key, value) of the strongest class and the next, ties by name."""
    order = F.array_sort(F.map_entries(affinity), lambda a, b: F.when(a["value"] != b["value"], F.signum(b["value"] - a["value"]).cast("int")).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.get(order, F.lit(0)), F.get(order, F.lit(1))


def assign(score: np.ndarray) -> list[int]:
    """For each row the column of the one-to-one assignment with the greatest total score (square matrices), by shortest augmenting paths."""
    cost = -np.asarray(score, float)
    n = len(cost)
    u, v, of = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)  # of[j]: the row of column j; rows and columns from 1
    for row in range(1, n + 1):
        of[0], j = row, 0
        short, used, back = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j] = True
            i = of[j]
            free = ~used
            free[0] = False
            gap = np.append(np.inf, cost[i - 1] - u[i] - v[1:])
            better = free & (gap < short)
            short[better], back[better] = gap[better], j
            nxt = int(np.where(free, short, np.inf).argmin())
            step = short[nxt]
            u[of[used]] += step
            v[used] -= step
            short[free] -= step
            j = nxt
            if of[j] == 0:
                break
        while j:
            of[j], j = of[back[j]], back[j]
    out = [0] * n
    for col in range(1, n + 1):
        out[of[col] - 1] = col - 1
    return out


def _uniform(key: np.ndarray, start: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from a row's key, a start and a step."""
    x = key.astype(np.uint64) + np.uint64((start * 1_000_003 + step * 7_919 + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres, summed feature by feature, so a row's do not depend on what shares its batch."""
    out = np.zeros((len(x), len(centres)))
    for f in range(x.shape[1]):
        out += np.square(x[:, f, None] - centres[None, :, f])
    return out


#: Vectors that are compared with all centres at once.
SLICE = 2_000


def _slices(batches):
    for b in batches:
        for at in range(0, len(b), SLICE):
            part = b.iloc[at : at + SLICE]
            yield part["key"].to_numpy(), np.array(part["v"].tolist(), float).reshape(len(part), -1)


def _farthest(d: DataFrame, centres: list[np.ndarray], take: int, step: int) -> list[np.ndarray]:
    """For each start `take` rows, drawn without replacement with chances by squared distance from its centres (all alike where it has none): those
    with the greatest log(u) / distance. A task sends `take` rows a start."""
    starts = len(centres)

    def op(batches):
        best: list[list[tuple]] = [[] for _ in range(starts)]
        for key, x in _slices(batches):
            for s, c in enumerate(centres):
                near = _apart(x, c).min(axis=1) if len(c) else np.ones(len(x))
                ok = np.flatnonzero(near > 0)
                rank = np.log(_uniform(key[ok], s, step)) / near[ok]
                for i in np.argsort(-rank, kind="stable")[:take]:
                    best[s].append((float(rank[i]), x[ok[i]].tolist()))
                best[s] = sorted(best[s], reverse=True)[:take]
        rows = [(s, r, v) for s, each in enumerate(best) for r, v in each]
        yield pd.DataFrame(rows, columns=["start", "rank", "v"])

    drawn = d.mapInPandas(op, "start int, rank double, v array<double>")
    top = drawn.withColumn("k", F.row_number().over(W.partitionBy("start").orderBy(F.col("rank").desc(), "v"))).where(F.col("k") <= take)
    new: list[list] = [[] for _ in range(starts)]
    for r in top.orderBy("start", "k").collect():  # starts * take rows
        new[r["start"]].append(r["v"])
    return [np.array([*c.tolist(), *n]) if n else c for c, n in zip(centres, new, strict=True)]


def _sums(d: DataFrame, centres: dict[int, np.ndarray], scale: float) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """By start: rows, sums of vectors and cost by nearest centre, all starts in one aggregation. Whole numbers are summed, so they don't depend on
    how rows are dealt."""
    width = len(next(iter(centres.values()))[0])

    def op(batches):
        for _, x in _slices(batches):
            whole = np.rint(x * scale).astype(np.int64)
            for s, c in centres.items():
                gaps = _apart(x, c)
                at = gaps.argmin(axis=1)
                cost = np.rint(gaps[np.arange(len(x)), at] / width * scale).astype(np.int64)
                order = np.argsort(at, kind="stable")
                kinds, first = np.unique(at[order], return_index=True)
                total = np.add.reduceat(np.column_stack([np.ones(len(x), np.int64), cost, whole])[order], first, axis=0)
                yield pd.DataFrame({"start": s, "c": kinds, "t": total.tolist()})

    part = d.mapInPandas(op, "start int, c int, t array<bigint>")
    wide = [F.sum(F.get("t", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(width + 2)]
    out = {s: (np.zeros(len(c)), np.zeros((len(c), width)), 0.0) for s, c in centres.items()}
    for r in part.groupBy("start", "c").agg(*wide).orderBy("start", "c").collect():  # a row for each start and centre
        n, total, cost = out[r["start"]]
        n[r["c"]] = float(r["t0"])
        total[r["c"]] = [float(r[f"t{i}"]) / scale for i in range(2, width + 2)]
        out[r["start"]] = n, total, cost + float(r["t1"]) / scale * width
    return out


def _pick(candidates: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of few weighted candidates by k-means++; where there are fewer kinds, the last repeat."""
    chosen = [candidates[rng.choice(len(candidates), p=weight / weight.sum())]]
    while len(chosen) < k:
        pull = weight * _apart(candidates, np.array(chosen)).min(axis=1)
        chosen.append(candidates[rng.choice(len(candidates), p=pull / pull.sum())] if pull.sum() > 0 else chosen[-1])
    return np.array(chosen)


def kmeans(df: DataFrame, id_col: str, vector: str, k: int, seeds: int = 20, rounds: int = 30, seed: int = 42, tol: float = 1e-4) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster) and the centroids: the start of least cost of `seeds`, ties to the first.

    All starts are fitted side by side: seeding draws 2 k far rows a start in each of three passes (k-means|| with draws of fixed size) and weighs them in a
    fourth, and each round is one aggregation for the starts that still move. The driver holds seeds * 6 k vectors. Draws follow from a row's id and
    vector, and sums are of whole numbers, so the result does not depend on how rows are dealt. Rows whose vector is null or holds a null are left
    out; vectors are of one length; an empty table gives no rows and no centroids. Clusters that lose all rows keep their centroid.
    """
    v = F.col(vector).cast("array<double>")
    rows = stored(df.select(F.col(id_col), v.alias("v"), F.xxhash64(F.lit(seed), F.col(id_col), v).alias("key")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())), "vectors")
    most = rows.select(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    if most is None:
        return rows.select(id_col, F.lit(None).cast("long").alias("cluster")), []
    scale = 2.0 ** (30 - np.ceil(np.log2(max(most, 1e-30))))  # a value has 30 bits, the sum of a slice 41
    d = rows.select("key", "v")
    drawn = _farthest(d, [np.zeros((0, 0))] * seeds, 1, 0)
    for step in (1, 2, 3):
        drawn = _farthest(d, drawn, 2 * k, step)
    weights = _sums(d, dict(enumerate(drawn)), scale)
    live = {s: _pick(drawn[s], weights[s][0], k, np.random.default_rng(seed + s)) for s in range(seeds)}
    done: dict[int, tuple[float, np.ndarray]] = {}
    for turn in range(rounds + 1):
        for s, (n, total, cost) in _sums(d, live, scale).items():
            had = live[s]
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], had)
            if turn == rounds or np.square(new - had).sum(axis=1).max() <= tol * tol:
                done[s] = cost, live.pop(s)
            else:
                live[s] = new
        if not live:
            break
    best = min(done, key=lambda s: (done[s][0], s))
    centroids = [c.tolist() for c in done[best][1]]
    gaps = F.array(*[distance(F.col("v"), F.array(*[F.lit(x) for x in c])) for c in centroids])
    return rows.select(id_col, gaps.alias("gaps")).select(id_col, (F.array_position("gaps", F.array_min("gaps")) - 1).cast("long").alias("cluster")), centroids


def archetypes(df: DataFrame, id_col: str, vector: str, signatures: dict[str, Sequence[float]], seeds: int = 20) -> DataFrame:
    """(id, cluster, primary, primary_score, secondary, secondary_score, affinity): k-means with as many clusters as there are named
    signatures; clusters take names by the assignment that maximises centroid . signature; scores are soft memberships."""
    names = list(signatures)
    clusters, centroids = kmeans(df, id_col, vector, len(names), seeds)
    if not centroids:
        return clusters.select(id_col, "cluster", *[F.lit(None).cast(t).alias(c) for c, t in (("primary", "string"), ("primary_score", "double"), ("secondary", "string"), ("secondary_score", "double"), ("affinity", "map<string,double>"))])
    score = np.array([[float(np.dot(c, signatures[n])) for n in names] for c in centroids])
    labels = [names[j] for j in assign(score)]
    out = df.select(id_col, vector).join(clusters, id_col).withColumn("affinity", affinities(F.col(vector), centroids, labels))
    one, two = first_two(F.col("affinity"))
    return out.select(id_col, "cluster", one["key"].alias("primary"), one["value"].alias("primary_score"), two["key"].alias("secondary"), two["value"].alias("secondary_score"), "affinity")


def class_shares(members: DataFrame, group: str, primary: str, secondary: str, weight: str, member: str) -> DataFrame:
    """(group, class, members, group_weight, group_share, total_share, index): a member counts its weight for its primary class and half of it for
    its secondary; index is the group's share over the total's. Every class is listed for every group."""
    one = members.select(group, member, F.col(primary).alias("class"), F.col(weight).cast("double").alias("w"))
    two = members.where(F.col(secondary).isNotNull()).select(group, member, F.col(secondary).alias("class"), (F.col(weight) * 0.5).alias("w"))
    w = one.unionByName(two)
    total = w.groupBy("class").agg(F.sum("w").alias("total_weight"))
    per = w.groupBy(group, "class").agg(F.count_distinct(member).alias("members"), F.sum("w").alias("group_weight"))
    every = per.select(group).distinct().crossJoin(F.broadcast(total))
    j = every.join(per, [group, "class"], "left").select(group, "class", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("group_weight", F.lit(0.0)).alias("group_weight"), "total_weight")
    g = F.coalesce(F.try_divide("group_weight", F.sum("group_weight").over(W.partitionBy(group))), F.lit(0.0))
    t = F.coalesce(F.try_divide("total_weight", F.sum("total_weight").over(W.partitionBy(group))), F.lit(0.0))
    j = j.withColumn("group_share", g).withColumn("total_share", t)
    return j.withColumn("index", F.try_divide("group_share", "total_share")).drop("total_weight")


def class_summary(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, mean) of a value, labels in order with null last."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).orderBy(F.col(label).asc_nulls_last())

