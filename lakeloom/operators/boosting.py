"""Gradient boosting with leaf-wise trees: histograms are grouped in Spark, trees are chosen on the driver from sums.

Values of a feature become bins between quantiles. A round computes each row's gradient and grows a tree best first: of all leaves the one whose split
gains most is split, until there are `leaves` of them. A pass over the rows gives the histograms (target, node, feature, bin) of all nodes that this
order may need next; of two siblings only the smaller one is counted, the other is what is left of their parent. A tree thus takes as many
passes as it is deep, and several targets (margin and win, folds) share each pass.

Gradients are summed as whole numbers (FIXED bits after the point), so sums, and with them trees, do not depend on how rows are dealt. What reaches the
driver is bounded by leaves x features x bins, whatever the number of rows. Rounds end when a target's loss on its validation rows has not
improved for `patience` rounds; the best round counts.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.tables import stored

#: Bits after the point of a gradient when it is summed.
FIXED = 20


@dataclass(frozen=True)
class Growth:
    """How trees are grown. rows and features: shares that a tree sees; rows are drawn anew every `every` rounds. least: rows a leaf has at least."""

    rounds: int = 1000
    leaves: int = 24
    rate: float = 0.03
    rows: float = 0.7
    features: float = 0.7
    every: int = 5
    least: int = 30
    l1: float = 0.1
    l2: float = 1.0
    bins: int = 255
    patience: int = 80
    seed: int = 42


@dataclass(frozen=True)
class Target:
    """A label to be learned. loss: squared, absolute or logistic. train, valid: names of boolean columns, all rows and none if not given.
    Validation is by absolute error, for logistic by log loss."""

    label: str
    loss: str = "squared"
    train: str | None = None
    valid: str | None = None


@dataclass
class Tree:
    """Node k has feature[k] <= cut[k] on its left, or is a leaf where left[k] is -1. Node 0 is the root. Cuts are numbers of bins."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for x, y in ((self.feature, -1), (self.cut, -1), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            x.append(y)
        return len(self.left) - 1

    def route(self, bins: Column, leaf: Callable[[int], Column], node: int = 0) -> Column:
        """What `leaf` says for the node that a row ends in."""
        if self.left[node] < 0:
            return leaf(node)
        return F.when(bins[self.feature[node]] <= self.cut[node], self.route(bins, leaf, self.left[node])).otherwise(self.route(bins, leaf, self.right[node]))


@dataclass
class Model:
    """Trees over binned features. cuts: for each feature the upper ends of its bins but the last; a null goes with the lowest values."""

    features: list[str]
    cuts: list[list[float]]
    loss: str
    start: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> Model:
        d = json.loads(text)
        return Model(**{**d, "trees": [Tree(**t) for t in d["trees"]]})

    def raw(self) -> Column:
        """The score of a row of `features`."""
        bins = binned(self.features, self.cuts)
        score = F.lit(self.start)
        for t in self.trees:
            score = score + t.route(bins, lambda k, t=t: F.lit(t.value[k]))
        return score

    def predict(self) -> Column:
        """The score; for logistic the probability."""
        return 1 / (1 + F.exp(-self.raw())) if self.loss == "logistic" else self.raw()

    def importance(self) -> dict[str, int]:
        """Splits by feature."""
        found = dict.fromkeys(self.features, 0)
        for t in self.trees:
            for f, left in zip(t.feature, t.left, strict=True):
                if left >= 0:
                    found[self.features[f]] += 1
        return found


def scored(df: DataFrame, model: Model, out: str, together: int = 16) -> DataFrame:
    """df with the model's prediction as a column. Bins are found once; trees are added up a few at a time, so that no expression grows with their number."""
    rows = df.withColumn("__bins", binned(model.features, model.cuts)).withColumn("__score", F.lit(model.start))
    for at in range(0, len(model.trees), together):
        score = F.col("__score")
        for t in model.trees[at : at + together]:
            score = score + t.route(F.col("__bins"), lambda k, t=t: F.lit(t.value[k]))
        rows = rows.withColumn("__score", score)
    found = 1 / (1 + F.exp(-F.col("__score"))) if model.loss == "logistic" else F.col("__score")
    return rows.withColumn(out, found).drop("__bins", "__score")


# ---- bins


def quantile_cuts(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """For each feature at most bins - 1 distinct quantiles; one aggregation, in bounded memory."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), F.array(*[F.lit(x) for x in at]), F.lit(20 * bins)).alias(f"q{k}") for k, f in enumerate(features)]).first()
    return [sorted(set(found[f"q{k}"] or [])) for k in range(len(features))]


def binned(features: Sequence[str], cuts: Sequence[Sequence[float]]) -> Column:
    """Array of bins: how many cuts lie below the value; 0 for null."""

    def below(f: str, ends: Sequence[float]) -> Column:
        """Binary search where there are few cuts, else a count of those below."""
        if len(ends) > 15:
            return F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda e: e < F.col(f)))

        def bin_of(lo: int, hi: int) -> Column:
            mid = (lo + hi) // 2
            return F.lit(lo) if lo == hi else F.when(F.col(f) <= ends[mid], bin_of(lo, mid)).otherwise(bin_of(mid + 1, hi))

        return bin_of(0, len(ends))

    return F.array(*[F.when(F.col(f).isNull(), F.lit(0)).otherwise(below(f, ends)) for f, ends in zip(features, cuts, strict=True)])


# ---- splits


def shrunk(g: np.ndarray | float, l1: float) -> np.ndarray | float:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g: float, h: float, p: Growth) -> float:
    return float(-shrunk(g, p.l1) / (h + p.l2))


def best_split(hist: np.ndarray, chosen: Sequence[int], p: Growth) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node; of equal gains the first feature and the lowest bin. hist: features x bins x (g, h, n)."""
    g, h, n = (np.cumsum(hist[..., k], axis=1) for k in range(3))
    all_g, all_h, all_n = g[:, -1:], h[:, -1:], n[:, -1:]
    score = lambda a, b: shrunk(a, p.l1) ** 2 / (b + p.l2)
    gain = score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)
    gain[(n < p.least) | (all_n - n < p.least)] = -np.inf
    keep = np.zeros(len(gain), bool)
    keep[list(chosen)] = True
    gain[~keep] = -np.inf
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-9 else None


class Grower:
    """One tree in the making. Nodes may be split that the tree will not have in the end: what is chosen is always the best first order over all
    nodes whose histograms are known."""

    def __init__(self, chosen: Sequence[int], p: Growth):
        self.p, self.chosen, self.tree = p, chosen, Tree()
        self.hists: dict[int, np.ndarray] = {}
        self.splits: dict[int, tuple[float, int, int] | None] = {}
        self.wanted: dict[int, int] = {self.tree.add(): -1}  # node that is counted next -> its sibling, or -1

    def take(self, found: dict[int, np.ndarray], empty: np.ndarray) -> None:
        """Histograms of the wanted nodes; their siblings follow."""
        parent = {c: k for k in range(len(self.tree.left)) for c in (self.tree.left[k], self.tree.right[k]) if c >= 0}
        for node, sibling in self.wanted.items():
            self.hists[node] = found.get(node, empty)
            if sibling >= 0:
                self.hists[sibling] = self.hists[parent[node]] - self.hists[node]
            for k in (node, sibling):
                if k >= 0:
                    self.splits[k] = best_split(self.hists[k], self.chosen, self.p)
        self.wanted = {}
        for node in self.order():
            if self.tree.left[node] < 0:
                _, f, b = self.splits[node]
                left, right = self.tree.add(), self.tree.add()
                self.tree.feature[node], self.tree.cut[node], self.tree.left[node], self.tree.right[node] = f, b, left, right
                few = self.hists[node][f, : b + 1, 2].sum() * 2 <= self.hists[node][f, :, 2].sum()
                self.wanted |= {left: right} if few else {right: left}

    def order(self) -> list[int]:
        """The nodes that are split, best first, as far as is known."""
        open_, done = [0], []
        while len(done) < self.p.leaves - 1:
            ready = [k for k in open_ if self.splits.get(k)]
            if not ready:
                break
            node = max(ready, key=lambda k: (self.splits[k][0], -k))
            open_.remove(node)
            done.append(node)
            if self.tree.left[node] >= 0:
                open_ += [self.tree.left[node], self.tree.right[node]]
        return done

    def finished(self) -> Tree:
        """The tree with leaves where nothing was split."""
        kept, out = set(self.order()), Tree()

        def copy(node: int) -> int:
            k = out.add()
            if node in kept:
                out.feature[k], out.cut[k] = self.tree.feature[node], self.tree.cut[node]
                out.left[k], out.right[k] = copy(self.tree.left[node]), copy(self.tree.right[node])
            else:
                g, h, _ = self.hists[node][0].sum(axis=0)
                out.value[k] = self.p.rate * leaf_value(g, h, self.p)
            return k

        copy(0)
        return out


# ---- rounds


def _gradient(t: Target, score: Column) -> tuple[Column, Column]:
    y = F.col(t.label)
    if t.loss == "logistic":
        p = 1 / (1 + F.exp(-score))
        return p - y, p * (1 - p)
    return (F.signum(score - y) if t.loss == "absolute" else score - y), F.lit(1.0)


def _loss(t: Target, score: Column) -> Column:
    if t.loss == "logistic":
        p = F.least(F.greatest(1 / (1 + F.exp(-score)), F.lit(1e-15)), F.lit(1 - 1e-15))
        return -(F.col(t.label) * F.log(p) + (1 - F.col(t.label)) * F.log(1 - p))
    return F.abs(score - F.col(t.label))


def in_bag(key: str, r: int, p: Growth) -> Column:
    return F.pmod(F.xxhash64(F.lit(p.seed), F.lit(r // p.every), key), F.lit(10_000)) < round(p.rows * 10_000)


def chosen_features(n: int, target: int, r: int, p: Growth) -> list[int]:
    return sorted(random.Random(f"{p.seed}:{target}:{r}").sample(range(n), max(1, round(p.features * n))))


def _fixed(x: Column) -> Column:
    return F.round(x * F.lit(float(1 << FIXED))).cast("long")


def _histograms(state: DataFrame, key: str, targets: Sequence[Target], growers: dict[int, Grower], r: int, shape: tuple[int, int], p: Growth) -> dict[int, dict[int, np.ndarray]]:
    """By target and wanted node the sums of its rows: features x bins x (g, h, n)."""
    bins = F.col("bins")
    parts = []
    for k, g in growers.items():
        node = g.tree.route(bins, lambda n, g=g: F.lit(n) if n in g.wanted else F.lit(None).cast("int"))
        grad, hess = _gradient(targets[k], F.col("score")[k])
        seen = F.coalesce(F.col(targets[k].train), F.lit(False)) if targets[k].train else F.lit(True)
        parts.append(F.struct(F.lit(k).alias("k"), F.when(seen & F.col(targets[k].label).isNotNull(), node).alias("node"), _fixed(grad).alias("g"), _fixed(hess).alias("h")))
    rows = state.where(in_bag(key, r, p)).select("bins", F.explode(F.array(*parts)).alias("p")).where("p.node IS NOT NULL")
    seen = " OR ".join(f"(k = {k} AND f IN ({', '.join(map(str, g.chosen))}))" for k, g in growers.items())
    cells = rows.select("p.k", "p.node", "p.g", "p.h", F.posexplode("bins").alias("f", "b")).where(seen)
    sums = cells.groupBy("k", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    out: dict[int, dict[int, np.ndarray]] = {k: {} for k in growers}
    for k, node, f, b, g, h, n in sums.collect():
        hist = out[k].setdefault(node, np.zeros((*shape, 3)))
        hist[f, b] = (g / (1 << FIXED), h / (1 << FIXED), n)
    for k, nodes in out.items():  # features that the tree does not see have all rows in their first bin, so that each sums up to the node
        first = growers[k].chosen[0]
        for hist in nodes.values():
            rest = [f for f in range(shape[0]) if f not in set(growers[k].chosen)]
            hist[rest, 0] = hist[first].sum(axis=0)
    return out


def _medians(state: DataFrame, targets: Sequence[Target], trees: dict[int, Tree], key: str, r: int, p: Growth) -> None:
    """For absolute error a leaf's value is the median of what its rows still lack (approximate, in bounded memory)."""
    for k, tree in trees.items():
        t = targets[k]
        if t.loss == "absolute":
            seen = F.coalesce(F.col(t.train), F.lit(False)) if t.train else F.lit(True)
            rows = state.where(in_bag(key, r, p) & seen & F.col(t.label).isNotNull())
            for n, m in rows.groupBy(tree.route(F.col("bins"), F.lit).alias("leaf")).agg(F.percentile_approx(F.col(t.label) - F.col("score")[k], 0.5).alias("m")).collect():
                tree.value[n] = p.rate * m


def fit(rows: DataFrame, features: Sequence[str], targets: Sequence[Target], key: str, p: Growth = Growth(), keep: int = 5) -> list[Model]:  # noqa: B008
    """A model for each target. key: a column by hash of which rows are drawn; rows are written with their bins once and with their scores every `keep`
    rounds. Rows without a label are left out, null features count as lowest. A target without validation rows runs all rounds; without
    a training row its model has no tree and starts at 0."""
    cuts = quantile_cuts(rows, features, p.bins)
    shape = (len(features), max(len(c) for c in cuts) + 1)
    extra = dict.fromkeys(c for t in targets for c in (t.train, t.valid) if c)
    labels = [F.col(c).cast("double").alias(c) for c in dict.fromkeys(t.label for t in targets)]
    table = stored(rows.select(F.col(key), *labels, *extra, binned(features, cuts).alias("bins")), "boost-bins")
    start = _starts(table, targets)
    models = [Model(list(features), cuts, t.loss, s) for t, s in zip(targets, start, strict=True)]
    state = table.withColumn("score", F.array(*[F.lit(s) for s in start]))
    active = {k for k, t in enumerate(targets)}
    for r in range(p.rounds):
        growers = {k: Grower(chosen_features(len(features), k, r, p), p) for k in sorted(active)}
        while wanted := {k: g for k, g in growers.items() if g.wanted}:
            found = _histograms(state, key, targets, wanted, r, shape, p)
            for k, g in wanted.items():
                g.take(found[k], np.zeros((*shape, 3)))
        trees = {k: g.finished() for k, g in growers.items()}
        _medians(state, targets, trees, key, r, p)
        for k, t in trees.items():
            models[k].trees.append(t)
        step = [F.col("score")[k] + trees[k].route(F.col("bins"), lambda n, k=k: F.lit(trees[k].value[n])) if k in trees else F.col("score")[k] for k in range(len(targets))]
        state = state.withColumn("score", F.array(*step))
        if r % keep == keep - 1:
            state = stored(state, "boost-scores")
        held = [k for k in sorted(active) if targets[k].valid]
        if held:
            said = state.agg(*[F.avg(F.when(F.col(targets[k].valid), _loss(targets[k], F.col("score")[k]))).alias(f"l{k}") for k in held]).first()
            for k in held:
                losses = models[k].losses
                losses.append(said[f"l{k}"] if said[f"l{k}"] is not None else math.inf)
                if len(losses) - 1 - int(np.argmin(losses)) >= p.patience:
                    active.discard(k)
        if not active:
            break
    for m in models:
        if m.losses:
            del m.trees[int(np.argmin(m.losses)) + 1 :]
    return models


def _starts(table: DataFrame, targets: Sequence[Target]) -> list[float]:
    """Where scores start: the mean, the median, or the log odds of the training rows."""

    def of(t: Target) -> Column:
        y = F.when(F.coalesce(F.col(t.train), F.lit(False)), F.col(t.label)) if t.train else F.col(t.label)
        return F.percentile_approx(y, 0.5) if t.loss == "absolute" else F.avg(y)

    found = table.agg(*[of(t).alias(f"s{k}") for k, t in enumerate(targets)]).first()
    out = []
    for k, t in enumerate(targets):
        x = found[f"s{k}"]
        if x is not None and t.loss == "logistic":
            x = min(max(x, 1e-6), 1 - 1e-6)
            x = math.log(x / (1 - x))
        out.append(float(x or 0.0))
    return out
