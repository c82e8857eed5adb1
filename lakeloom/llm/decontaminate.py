"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies are counted over all documents, by full hash for the words that benchmarks use and by slot for the others; they weigh
   every passage (TF-IDF, each word once).
2. All passages of the benchmark, of up to PIECE words, form a matrix over its words. None is left out, and no sample of the corpus takes part: the
   basis is an index of the benchmark, where the corpus enters by its counts. Its right singular vectors come from a randomised SVD: tasks multiply their
   rows into a random block, sums over tasks are made by blocks of words, the driver only orthogonalises (words * rank numbers).
3. Every document is cut into overlapping windows sized to the items, by class of length. Windows are projected into the latent space, and the items
   whose passages have a cosine of `propose` or more with a window there are candidates near it.
4. What that search misses has an exact way: a stretch of text that holds as many of an item's words as the common subsequence needs is a
   candidate too, whatever the words weigh. A stretch with fewer is none by either way. `found_by` says which way a pair came.
5. Candidates are settled by the longest common subsequence of words around the window, as a share of the item's: from `same` on the item has
   leaked; from `near` on only if its answer, the item's last sentence, is there too. So that common words strewn over the surroundings are no
   leak, the window's latent cosine with a passage of the item reaches `cut`, or the subsequence lies within twice the item's length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_rows, short_batches, stored
from lakeloom.llm.shingles import WordHash, plain_hashes, plain_hashes_each

DIMS = 1 << 16
PIECE, WINDOW, STRIDE = 48, 64, 24
#: Words of a bin; windows of the latent search are runs of bins.
BIN = 16
#: Characters of texts that are looked at together.
TOGETHER = 1 << 17
#: Places of a table of blocks and words that is marked place by place; a larger one is sorted instead.
MARKED = 1 << 20


@dataclass(frozen=True)
class Params:
    rank: int = 256
    rounds: int = 2
    light: float = 0.2  # words of less weight than this share of the benchmark's greatest are left out of the windows that are projected
    propose: float = 0.5  # latent cosine of a window that makes an item a candidate
    exact: bool = True  # whether stretches with enough words are candidates that the latent search did not propose
    search: int = 64  # latent dimensions, from the strongest, that the search for candidates uses
    cut: float = 0.22
    same: float = 0.6
    near: float = 0.45
    short: int = 8  # items of fewer words must be there whole
    seed: int = 17
    benchmark_bytes: int = 64 << 20  # items are broadcast; a larger benchmark is searched for in parts


def dim(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies: of the benchmark's own words by their full hash, of all others by slot."""

    words: np.ndarray  # the benchmark's, sorted
    idf: np.ndarray  # of these
    slots: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        k = places(words, self.words)
        w = self.slots[dim(words)]
        w[k >= 0] = self.idf[k[k >= 0]]
        return w


def frequencies(texts: DataFrame, own: np.ndarray) -> Weights:
    """Weights from the number of texts that hold each word. own: the benchmark's words, sorted."""
    shared = texts.sparkSession.sparkContext.broadcast(own)
    size = DIMS + len(own)

    def op(batches):
        own = shared.value
        ours = np.zeros(DIMS, bool)
        ours[dim(own)] = True
        memo, df, n = WordHash(), np.zeros(size, np.int64), 0
        for b in batches:
            for u in plain_hashes_each(b["text"].tolist(), memo):
                u = np.sort(u)
                u = u[np.append(True, u[1:] != u[:-1])[: len(u)]]
                d = dim(u)
                k = places(u[ours[d]], own)
                df[d[np.append(True, d[1:] != d[:-1])[: len(d)]]] += 1  # words are sorted, so are their slots
                df[DIMS + k[k >= 0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"d": np.append(at, size), "n": np.append(df[at], n)})

    rows = texts.mapInPandas(op, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).toPandas()  # DIMS, the benchmark's words and 1 row at most
    out = np.zeros(size + 1, np.int64)
    out[rows["d"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    n = int(out[size])
    idf = np.log((n + 1.0) / (out[:size] + 1.0)) + 0.01
    return Weights(own, idf[DIMS:], idf[:DIMS])


def pieces(n: int, width: int, stride: int) -> list[tuple[int, int]]:
    """Windows that cover n words: all of `width` but where n is less; the last ends at n."""
    starts = list(range(0, max(n - width, 0), stride)) + [max(n - width, 0)]
    return [(a, min(a + width, n)) for a in starts] if n else []


def windows_from(n: int, start: int) -> Iterator[tuple[int, int]]:
    """Of the windows of n words in steps of STRIDE, those from about `start` on."""
    last = max(n - WINDOW, 0)
    yield from ((a, min(a + WINDOW, n)) for a in range(max(start // STRIDE - 1, 0) * STRIDE, last, STRIDE))
    yield last, n


def weights(words: np.ndarray, weight: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a passage, and their unit-length weights."""
    u = np.unique(words)
    w = weight.of(u)
    return u, w / (np.sqrt(w @ w) or 1.0)


def places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each word stands among the known ones (sorted), or -1."""
    if not len(known):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1)


def answer_of(text: str) -> str:
    """The item's answer: what follows the last question mark or line break, else its last sentence."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if x.strip()]
    return parts[-1] if len(parts) > 1 else ""


def places_of(words: list[int]) -> dict[int, int]:
    """For each word the places where it stands, as bits."""
    at: dict[int, int] = {}
    for i, w in enumerate(words):
        at[w] = at.get(w, 0) | 1 << i
    return at


def common_with(at: dict[int, int], n: int, b: list[int]) -> int:
    """Length of the longest common subsequence of b and the n words whose places are given, bit-parallel over the latter."""
    none = 0
    return common_of([at.get(w, none) for w in b], n)


def common_of(b: list[int], n: int) -> int:
    """The same of words given by their places among the n."""
    v = full = (1 << n) - 1
    for places in b:
        if u := v & places:
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    return common_with(places_of(a), len(a), b)


class Item:
    def __init__(self, item_id: object, words: list[int], answer: list[int]):
        self.item_id, self.words, self.answer = item_id, words, answer
        self.at, self.answer_at = places_of(words), places_of(answer)


@dataclass(frozen=True)
class Index:
    """For each benchmark word, the items (of a group) that hold it and how often."""

    start: np.ndarray
    item: np.ndarray
    count: np.ndarray


@dataclass(frozen=True)
class Group:
    """Items of like length, and the number of their words that a leak needs."""

    longest: int
    items: np.ndarray
    place: np.ndarray  # of each item among these, -1 for others
    words: Index
    answers: Index
    need: np.ndarray
    need_near: np.ndarray  # of these, if need_answer of the answer are there too
    need_answer: np.ndarray


@dataclass(frozen=True)
class Space:
    weight: Weights
    dims: np.ndarray  # whether a dim is one of theirs: a quick test before the search
    basis: np.ndarray  # benchmark word, latent dimension
    scaled: np.ndarray  # what the search uses of the basis, each word's row times its weight
    heavy: np.ndarray  # which words the search projects
    passages: np.ndarray  # passage, latent dimension; scaled to a product of 1 with the projected passage
    unit: np.ndarray  # what the search uses of the same, of length 1
    owner: np.ndarray  # item of each passage
    groups: list[Group]


def index(texts: list[list[int]], known: np.ndarray) -> Index:
    rows = [np.unique(places(np.array(t, np.uint64), known), return_counts=True) for t in texts]
    word = np.concatenate([u for u, _ in rows])
    order = np.argsort(word, kind="stable")
    item, count = np.repeat(np.arange(len(rows)), [len(u) for u, _ in rows]), np.concatenate([n for _, n in rows])
    return Index(np.searchsorted(word[order], np.arange(len(known) + 1)), item[order], count[order])


def groups(items: list[Item], known: np.ndarray, p: Params) -> list[Group]:
    """Items by length, doubling from 16 words on, so that texts are looked at in stretches that suit the items."""
    sizes: dict[int, list[int]] = {}
    for j, item in enumerate(items):
        if item.words:
            sizes.setdefault(max(16, 1 << (len(item.words) - 1).bit_length()), []).append(j)
    out = []
    for _, js in sorted(sizes.items()):
        m = np.array([len(items[j].words) for j in js])
        a = np.array([len(items[j].answer) for j in js])
        least = lambda share, n: np.ceil(share * n - 1e-6)
        near = np.where((m >= p.short) & (a > 0), least(p.near, m), np.inf)
        place = np.full(len(items), -1)
        place[js] = np.arange(len(js))
        out.append(Group(int(m.max()), np.array(js), place, index([items[j].words for j in js], known), index([items[j].answer for j in js], known), np.where(m < p.short, m, least(p.same, m)), near, least(0.8, a)))
    return out


def _svd(rows: DataFrame, dims: int, n: int, p: Params) -> np.ndarray:
    """Right singular vectors (dims, rank) of the n sparse rows (d array<int>, w array<double>), by randomised subspace iteration. There are no more of them
    than rows, else the last ones were noise."""
    spark = rows.sparkSession
    rank = min(p.rank, dims, n)
    q = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((dims, rank)))[0].astype(np.float32)
    for _ in range(p.rounds + 1):
        shared = spark.sparkContext.broadcast(q)

        def product(batches, shared=shared):
            q = shared.value
            out = np.zeros_like(q)
            for b in batches:
                for d, w in zip(b["d"], b["w"], strict=True):
                    if len(d):
                        d, w = np.asarray(d), np.asarray(w, np.float32)
                        out[d] += w[:, None] * (w @ q[d])[None, :]
            for at in range(0, len(out), 64):
                if (part := out[at : at + 64]).any():
                    yield pd.DataFrame({"k": [at], "m": [part.tobytes()]})

        def total(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": [g["k"].iloc[0]], "m": [np.sum([np.frombuffer(m, np.float32) for m in g["m"]], axis=0, dtype=np.float32).tobytes()]})

        z = np.zeros_like(q)
        for r in rows.mapInPandas(product, "k int, m binary").groupBy("k").applyInPandas(total, "k int, m binary").collect():  # dims * rank numbers
            part = np.frombuffer(r["m"], np.float32).reshape(-1, rank)
            z[r["k"] : r["k"] + len(part)] = part
        q = np.linalg.qr(z.astype(np.float64))[0].astype(np.float32)
    return q


def fit(docs: DataFrame, items: list[tuple[object, str]], p: Params = Params()) -> tuple[Space, list[Item]]:  # noqa: B008
    """docs: (id, text). The latent space and the items in words. Counts cover all texts, the basis is fitted on every passage of every item."""
    spark, memo = docs.sparkSession, WordHash()
    words = [plain_hashes(t, memo) for _, t in items]
    known = [Item(i, w.tolist(), plain_hashes(answer_of(t), memo).tolist()) for (i, t), w in zip(items, words, strict=True)]
    owner = [k for k, w in enumerate(words) for _ in pieces(len(w), PIECE, PIECE)]
    own = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    dims = np.zeros(DIMS, bool)
    dims[dim(own)] = True
    if not len(own):
        return Space(Weights(own, np.zeros(0), np.zeros(DIMS)), dims, *[np.zeros((0, 1), np.float32)] * 2, np.zeros(0, bool), *[np.zeros((0, 1), np.float32)] * 2, np.zeros(0, np.int64), []), known

    weight = frequencies(docs.where("text is not null").select("text"), own)
    parts = [weights(w[a:b], weight) for w in words for a, b in pieces(len(w), PIECE, PIECE)]
    bench = spark.createDataFrame([(places(u, own).tolist(), w.tolist()) for u, w in parts], "d array<int>, w array<double>")
    rows = bench.repartition(max(2, spark.sparkContext.defaultParallelism)).persist()
    basis = _svd(rows, len(own), len(parts), p)
    rows.unpersist()
    latent = np.array([basis[places(u, own)].T @ w for u, w in parts], np.float32)
    unit = latent[:, : p.search] / (np.linalg.norm(latent[:, : p.search], axis=1, keepdims=True) + 1e-9)
    latent /= (latent * latent).sum(axis=1, keepdims=True) + 1e-9  # a passage's cosine with itself is 1, however much of it the basis holds
    scaled = (basis[:, : p.search] * weight.idf[:, None]).astype(np.float32)
    heavy = weight.idf >= p.light * weight.idf.max()
    return Space(weight, dims, basis, scaled, heavy, latent, unit, np.array(owner), groups(known, own, p)), known


def hits(block: np.ndarray, word: np.ndarray, blocks: int, index: Index, items: int) -> np.ndarray:
    """(block, item): number of the item's words that the block holds, an upper bound of any common subsequence."""
    n = index.start[word + 1] - index.start[word]
    at = np.repeat(index.start[word] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    return np.bincount(np.repeat(block, n) * items + index.item[at], index.count[at], blocks * items).reshape(blocks, items)


def blocks_of(ends: np.ndarray, group: Group) -> np.ndarray:
    """(text, start, end) of overlapping blocks of words. Texts stand one after another and end at `ends`. Every window with its surroundings lies in
    a block."""
    reach = WINDOW + 2 * group.longest
    return np.array([(t, s + a, s + b) for t, (s, e) in enumerate(pairwise([0, *ends.tolist()])) for a, b in pieces(e - s, 2 * reach, reach)]).reshape(-1, 3)


def binned(k: np.ndarray, starts: np.ndarray, space: Space) -> np.ndarray:
    """Latent vectors of the bins that start at all but the last of `starts`, in running sums from zero on."""
    here = k[starts[0] : starts[-1]]
    known = np.flatnonzero(here >= 0)
    known = known[space.heavy[here[known]]] + starts[0]
    at = np.searchsorted(known, starts)
    out = np.zeros((len(starts), space.scaled.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full + 1] = np.add.reduceat(space.scaled[k[known]], at[full], axis=0)
        np.cumsum(out, axis=0, out=out)
    return out


def proposed(k: np.ndarray, ends: np.ndarray, blocks: list[np.ndarray], space: Space, p: Params) -> list[np.ndarray]:
    """For each group, as block * items + item, repeats included, (block, item) of each item with a passage whose latent cosine with a window is `propose` or more. Windows are runs of bins, so wide
    and so close that any item of the group lies in one as a whole, and end with their text."""
    starts = np.concatenate([np.arange(s, e, BIN) for s, e in pairwise([0, *ends.tolist()])])
    text = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(text, text, "right")  # of each bin's text
    begin = np.append(0, ends)[text]
    starts = np.append(starts, ends[-1])
    shapes = []
    for group, its in zip(space.groups, blocks, strict=True):
        mine = np.flatnonzero(group.place[space.owner] >= 0)
        stride = max(1, group.longest // (2 * BIN))
        shapes.append((stride, stride + -(-group.longest // BIN), WINDOW + 2 * group.longest, space.owner[mine], space.unit[mine].T, np.searchsorted(its[:, 0], np.arange(len(ends))), np.bincount(its[:, 0], minlength=len(ends))))
    widest = max(shape[1] for shape in shapes)
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in shapes]
    n_items = len(space.groups[0].place)
    for first in range(0, len(text), 1024):  # so many bins at a time bound the memory
        so_far = binned(k, starts[first : first + 1024 + widest + 1], space)
        here = np.arange(first, min(first + 1024, len(text)))
        for pairs, (stride, width, reach, owner, passages, first_block, n_blocks) in zip(out, shapes, strict=True):
            some = here[(starts[here] - begin[here]) // BIN % stride == 0]
            sums = so_far[np.minimum(some + width, last[some]) - first] - so_far[some - first]
            least = p.propose * np.sqrt(np.einsum("ij,ij->i", sums, sums)) + 1e-6
            x, y = np.nonzero(sums @ passages >= least[:, None])
            if not len(x):
                continue
            x, item = some[x], owner[y]
            at = (starts[x] - begin[x]) // reach
            for step in (-1, 0, 1):
                near = np.clip(at + step, 0, n_blocks[text[x]] - 1) + first_block[text[x]]
                pairs.append(near * n_items + item)
    return [np.concatenate(pairs) for pairs in out]


def distinct(x: np.ndarray, size: int) -> np.ndarray:
    """The distinct ones of whole numbers below size, in order."""
    if size > MARKED:
        return np.unique(x)
    seen = np.zeros(size, bool)
    seen[x] = True
    return np.flatnonzero(seen)


def candidates(k: np.ndarray, blocks: np.ndarray, group: Group) -> list[tuple[int, int]]:
    """(block, item) of each block of words and item that may have a window with enough of the item's words. No count is estimated, so none that
    the common subsequence would settle is missing."""
    known = np.flatnonzero(k >= 0)
    size, words = max(1, min(64, (1 << 18) // len(group.items))), len(group.words.start) - 1
    out = []
    for first in range(0, len(blocks), size):  # so many blocks at a time bound the memory
        part = blocks[first : first + size]
        lo, hi = np.searchsorted(known, part[:, 1]), np.searchsorted(known, part[:, 2])
        at = np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange((hi - lo).sum())
        block, word = np.divmod(distinct(np.repeat(np.arange(len(part)), hi - lo) * words + k[known[at]], len(part) * words), words)
        n = hits(block, word, len(part), group.words, len(group.items))
        enough = n >= group.need
        if (close := (n >= group.need_near) & ~enough).any():
            enough |= close & (hits(block, word, len(part), group.answers, len(group.items)) >= group.need_answer)
        out += [(first + x, int(group.items[y])) for x, y in np.argwhere(enough).tolist()]
    return out


def cosine(words: np.ndarray, k: np.ndarray, space: Space, item: int) -> float:
    """Latent cosine of a window (words and their places among the benchmark's) with the item's nearest passage."""
    w = space.weight.of(words)
    latent = (w[k >= 0, None] * space.basis[k[k >= 0]]).sum(axis=0) / (np.sqrt(w @ w) or 1.0)
    return float((space.passages[space.owner == item] @ latent).max())


def settled(item: Item, around: list[int], p: Params) -> tuple[float, bool, bool]:
    """(share of the item in common, answer found, whether that is a leak)."""
    m = len(item.words)
    share = common_with(item.at, m, around) / m
    if share < min(p.same, p.near):
        return share, False, False
    answer = bool(item.answer) and common_with(item.answer_at, len(item.answer), around) >= 0.8 * len(item.answer)
    return share, answer, share >= (1.0 if m < p.short else p.same) or (m >= p.short and share >= p.near and answer)


class Stretches:
    """Stretches of text: from each known place (in order) as far as `width` words on. `holds` tells whether a list of words, or some part of it, can
    pass; what it denies a long stretch it denies all within, so runs of starts are passed over together."""

    def __init__(self, at: list[int], around: list[int], width: int, holds: Callable[[list[int]], bool]):
        self.at, self.around, self.width, self.holds = at, around, width, holds
        self.past = list(range(len(at)))  # for each start the next that is not known to fail
        self.passes: set[int] = set()

    def next(self, x: int, stop: int) -> int:
        """The first start from x on whose whole stretch passes, or stop."""
        while x < stop:
            if x in self.passes:
                return x
            if self.past[x] > x:
                x = self.past[x]
                continue
            run = 64
            while run:
                end = min(x + run, len(self.at))
                if not self.holds(self.around[x : bisect_left(self.at, self.at[end - 1] + self.width, x)]):
                    self.past[x:end] = [end] * (end - x)
                    break
                run //= 2
            else:
                self.passes.add(x)
        return stop


class Close:
    """Whether words at some places make a leak within twice the item's length; an answer that decides is to lie within twice its own length."""

    def __init__(self, item: Item, at: list[int], around: list[int], p: Params):
        self.item, self.at, self.around, self.p = item, at, around, p
        self.wholes = Stretches(at, around, 2 * len(item.words), lambda b: settled(item, b, p)[2])
        self.answers = Stretches(at, around, 2 * len(item.answer), self._answered)

    def _answered(self, b: list[int]) -> bool:
        return common_with(self.item.answer_at, len(self.item.answer), b) >= 0.8 * len(self.item.answer)

    def _within(self, x: int, width: int, end: int) -> list[int]:
        return self.around[x : bisect_left(self.at, self.at[x] + width, x, end)]

    def _first(self, of: Stretches, x: int, end: int, passes: Callable[[int, list[int]], bool]) -> bool:
        while (x := of.next(x, end)) < end:
            if passes(x, here := self._within(x, of.width, end)):
                return True
            if x + len(here) == end:  # later stretches end there too and lie in this one
                return False
            x += 1
        return False

    def between(self, x: int, end: int) -> bool:
        """Whether the words from place x to before place `end` do."""

        def leaked(x: int, here: list[int]) -> bool:
            share, _, is_leak = settled(self.item, here, self.p)
            return is_leak and (share >= self.p.same or self._first(self.answers, x, x + len(here), lambda _, b: self._answered(b)))

        return self._first(self.wholes, x, end, leaked)


def leaks(texts: list[np.ndarray], space: Space, items: list[Item], p: Params) -> list[tuple[int, object, float, float, bool, str]]:
    """(text, item, cosine, share of the item in common, answer found, found by) for each item that has leaked into a text."""
    ends = np.cumsum([len(t) for t in texts])
    if not len(ends) or not ends[-1] or not len(space.owner):
        return []
    words = np.concatenate(texts)
    k = np.full(len(words), -1)
    maybe = np.flatnonzero(space.dims[dim(words)])
    k[maybe] = places(words[maybe], space.weight.words)
    known_at = np.flatnonzero(k >= 0).tolist()
    known_words = words[k >= 0].tolist()
    blocks_by_group = [blocks_of(ends, g) for g in space.groups]
    latent_by_group = proposed(k, ends, blocks_by_group, space, p)
    best: dict[tuple[int, int], tuple[float, float, bool, bool]] = {}
    seen: dict[tuple[int, int], set[int]] = {}
    for g, blocks, latent in zip(space.groups, blocks_by_group, latent_by_group, strict=True):
        found = candidates(k, blocks, g)
        for (block, j), by_cosine in zip(found, np.isin([block * len(items) + j for block, j in found], latent).tolist(), strict=True):
            if not by_cosine and not p.exact:
                continue
            t, start, end = blocks[block].tolist()
            item, m = items[j], len(items[j].words)
            least = m if m < p.short else int(np.ceil(min(p.same, p.near) * m - 1e-6))
            lo, hi = bisect_left(known_at, start), bisect_left(known_at, end)
            where = list(map(item.at.get, known_words[lo:hi]))
            masks = list(filter(None, where))  # other words are in no common subsequence
            if common_of(masks, m) < least:  # then no window of the block has as many as it needs
                continue
            at = [x - start for x, places in zip(known_at[lo:hi], where, strict=True) if places]
            reach = WINDOW + 2 * m
            if not any(b - a <= reach for a, b in zip(at, at[least - 1 :], strict=False)):
                continue
            around = [w for w, places in zip(known_words[lo:hi], where, strict=True) if places]
            if not settled(item, around, p)[2]:  # nor if the whole block is no leak
                continue
            base, n = int(ends[t]) - len(texts[t]), len(texts[t])
            start, end = start - base, end - base
            close = Close(item, at, around, p)
            known: dict[tuple[int, int], tuple[float, bool, bool, bool]] = {}
            done = seen.setdefault((t, j), set())
            for a, b in windows_from(n, start):
                if max(a - m, 0) < start:
                    continue
                if min(b + m, n) > end:
                    break
                if a in done and not by_cosine:
                    continue
                done.add(a)
                x, y = bisect_left(at, a - m - start), bisect_left(at, b + m - start)
                if y - x < least:
                    continue
                if (x, y) not in known:
                    few = common_of(masks[x:y], m) < least
                    result = (0.0, False, False) if few else settled(item, around[x:y], p)
                    known[x, y] = *result, result[2] and close.between(x, y)
                share, answer, leaked, near_by = known[x, y]
                if not leaked:
                    continue
                near = cosine(words[base + a : base + b], k[base + a : base + b], space, j)
                if near_by or near >= p.cut:
                    old = best.get((t, j), (-1.0, 0.0, False, False))
                    best[t, j] = (max(old[0], near), max(old[1], share), old[2] or answer, old[3] or by_cosine)
    return [(t, items[j].item_id, *x, "latent" if by_cosine else "counts") for (t, j), (*x, by_cosine) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", p: Params = Params()) -> DataFrame:  # noqa: B008
    """(id, item_id, cosine, lcs, answer, found_by): a row for each pair of document and benchmark item that leaked into it. found_by is `latent` where the
    latent search proposed the place and `counts` where only the exact way did. No shuffle of documents.

    A benchmark of more than benchmark_bytes is searched for in parts of about half of that, each with its own basis and broadcast, one
    after another. Null or empty texts and items match nothing; repeated rows give their pairs again; empty tables give an empty result.
    """
    short_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = 1 if size <= p.benchmark_bytes else -(-2 * size // p.benchmark_bytes)
    out = None
    for k in range(parts):
        found = _search(src, bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k), p)
        if parts > 1:
            found = stored(found, "leaks-part")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def _search(src: DataFrame, bench: DataFrame, p: Params) -> DataFrame:
    """(id, item_id, cosine, lcs, answer, found_by) for a benchmark that fits the driver and a broadcast."""
    space, items = fit(src, sorted([(r["i"], r["t"]) for r in bench.collect()], key=str), p)
    shared = src.sparkSession.sparkContext.broadcast((space, items))

    def op(batches):
        memo = WordHash()
        space, items = shared.value
        for b in batches:
            rows, ids, texts, size = [], [], [], 0
            for row, (i, t) in enumerate(zip(b["id"], b["text"], strict=True), 1):
                if isinstance(t, str):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                if row == len(b) or size >= TOGETHER:
                    rows += [(ids[x], None if item is None else str(item), *hit) for x, item, *hit in leaks(plain_hashes_each(texts, memo), space, items, p)]
                    ids, texts, size = [], [], 0
            yield pd.DataFrame(rows, columns=["id", "item_id", "cosine", "lcs", "answer", "found_by"])

    out = map_rows(src, op, "item_id string, cosine double, lcs double, answer boolean, found_by string")
    return out.withColumn("item_id", F.col("item_id").cast(bench.schema["i"].dataType))
