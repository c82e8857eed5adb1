"""Exact self-join of texts on the Jaccard similarity of their word shingles, with signature trees.

1. Each text becomes its set of hashed shingles; texts with equal sets share a node, so copies are never paired.
2. Sets that can have no partner leave: of n shingles a partner shares ceil(t n) at least, so a set with more than n - ceil(t n) shingles that
   no other set has is alone. A fixed part of the hash range (LOW) is counted for that, by one aggregation over (shingle, node); this
   takes away all but families of near copies, short texts and texts made of common passages.
3. Routing of the rest. Under one order of all shingles two sets with similarity t share a shingle among the first n - ceil(t n) + 1 of each,
   whatever the order. Counted shingles come first here, the rarest first, so passages that many texts share route nothing. Nodes that
   share such a shingle are connected, and the connected parts are the regions in which links can lie: no link is lost.
4. In each region a signature tree is built: leaves are sets by size, inner nodes hold OR-combined bitmaps and size ranges. A traversal of
   node pairs from (root, root) drops pairs whose size ranges or whose largest possible overlap rule out similarity t, and pairs
   that links already connect. What is left is compared exactly. Small regions share tasks.
5. Regions of more than BLOCK_SETS sets or BLOCK_SHINGLES shingles are cut into blocks of like sizes, twice and in two ways; each block is a tree and
   each set is in one block a time, so this is linear. Nearly always it connects a whole family of near copies. Then blocks are cut
   along what is connected, and the roots of two blocks (bitmap, size range, components) decide whether any link between them is still to
   be found; only then are their sets brought together. No pair of sets that may link is left out.
6. Links span each connected group; components follow from them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import map_rows, short_batches, stored
from lakeloom.llm.components import components
from lakeloom.llm.shingles import WordHash, shingle_set, word_hashes

#: Similarity as a fraction: 75 / 100.
NUM, DEN = 3, 4
LOW = np.uint64(int(0.36 * 2**64))
BLOCK_SETS, BLOCK_SHINGLES = 750, 750_000
#: Shingles of small regions that share a task.
PACK_SHINGLES = 150_000
FAN = 8
#: Bits of a block's root when pairs of blocks are weighed.
ROOT_BITS = 1 << 15
#: Bits of a shingle that are counted and routed by.
CUT_BITS = 46


# ---- the tree


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, dtype=bool)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.uint64)


class SignatureTree:
    """Sets by size. level[0] are the sets; a node of level k stands for up to FAN nodes of level k - 1."""

    def __init__(self, sets: list[np.ndarray], num: int = NUM, den: int = DEN, known: list[int] | None = None):
        """known: for each set a number, equal where sets are known to be connected."""
        self.num, self.den = num, den
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sets = [sets[i] for i in self.order]
        n = np.array([len(s) for s in self.sets])
        bits = 1 << int(np.clip(np.ceil(np.log2(8 * max(np.median(n), 1))), 9, 14))
        maps = np.array([bitmap(s, bits) for s in self.sets])
        extra = n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, n, n, extra)]
        self.root = np.arange(len(sets))
        if known is not None:
            _, first, own = np.unique(np.array(known)[self.order], return_index=True, return_inverse=True)
            self.root = first[own]
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, ex = self.levels[-1]
            cut = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ex, cut)))
        self._colour()

    def _colour(self) -> None:
        """The least and the greatest component number below each node."""
        self.colours = [(self.root, self.root)]
        for _ in self.levels[1:]:
            lo, hi = self.colours[-1]
            cut = np.arange(0, len(lo), FAN)
            self.colours.append((np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    def may_link(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False where no set below a and set below b can be similar and unconnected."""
        m, lo, hi, ex = self.levels[k]
        clo, chi = self.colours[k]
        ok = ~((clo[a] == chi[a]) & (clo[b] == chi[b]) & (clo[a] == clo[b]))
        ok &= (self.den * hi[a] >= self.num * lo[b]) & (self.den * hi[b] >= self.num * lo[a])
        at = np.flatnonzero(ok)
        # sets that share o elements share o bits at least, but for elements that fell on a bit already set
        most = np.bitwise_count(m[a[at]] & m[b[at]]).sum(axis=1).astype(np.int64) + np.minimum(ex[a[at]], ex[b[at]])
        ok[at] = (self.num + self.den) * most >= self.num * (lo[a[at]] + lo[b[at]])
        return ok

    def similar(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        return (self.num + self.den) * both >= self.num * (len(x) + len(y))

    def links(self) -> list[tuple[int, int]]:
        """Links that span each group of connected sets, as places in the list given."""
        out: list[tuple[int, int]] = []
        top = len(self.levels) - 1
        stack = [(top, np.array([0]), np.array([0]))]
        while stack:
            k, a, b = stack.pop()
            if k == 0:
                found = len(out)
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    rx, ry = self.root[x], self.root[y]
                    if rx != ry and self.similar(x, y):
                        self.root[self.root == max(rx, ry)] = min(rx, ry)
                        out.append((self.order[x], self.order[y]))
                if len(out) > found:
                    self._colour()
                continue
            if len(a) > 256:
                half = len(a) // 2
                stack += [(k, a[half:], b[half:]), (k, a[:half], b[:half])]
                continue
            width = len(self.levels[k - 1][1])
            i, j = np.divmod(np.arange(FAN * FAN), FAN)
            x, y = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
            keep = (x < width) & (y < width) & (x <= y if k > 1 else x < y)
            x, y = x[keep], y[keep]
            keep = self.may_link(k - 1, x, y)
            if keep.any():
                stack.append((k - 1, x[keep], y[keep]))
        return out


# ---- the join


def _node(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def _set_of(text: object, memo: WordHash) -> np.ndarray:
    return shingle_set(word_hashes(text, memo)) if isinstance(text, str) else np.zeros(0, np.uint64)


def _sets(docs: DataFrame) -> DataFrame:
    """(id, key, n, node): key is a hash of the text, node one of the whole set, null without words."""

    def op(batches):
        memo = WordHash()
        for b in batches:
            found = [_set_of(t, memo) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "key": b["key"], "n": [len(s) for s in found], "node": pd.array([_node(s) for s in found], dtype="Int64")})

    return map_rows(docs.withColumn("key", F.xxhash64("text")), op, "key long, n long, node long")


def _cut(s: np.ndarray, bits: int) -> np.ndarray:
    """Shingles in fewer bits, for counting and routing: what falls together there only counts as shared."""
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _low(s: np.ndarray, bits: int) -> np.ndarray:
    return np.unique(_cut(s[: np.searchsorted(s, LOW)], bits))


def _counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over the low shingles of all texts: (o, own), how many of each node's no other has, and (k, cnt), how often each shared one is found."""
    bits = CUT_BITS

    def op(batches):
        memo = WordHash()
        for b in batches:
            low = [(_low(s, bits), _node(s)) for s in (_set_of(t, memo) for t in b["text"]) if len(s)]
            if low:
                yield pd.DataFrame({"s": np.concatenate([s for s, _ in low]), "o": np.repeat(np.array([n for _, n in low], np.int64), [len(s) for s, _ in low])})

    found = docs.mapInPandas(op, "s long, o long").groupBy("s").agg(F.min("o").alias("o"), F.max("o").alias("most"), F.count("*").alias("c"))
    alone = F.col("o") == F.col("most")
    both = stored(found.groupBy(F.when(alone, F.col("o")).alias("o"), F.when(~alone, F.col("s")).alias("k")).agg(F.count("*").alias("own"), F.max("c").alias("cnt")), "jaccard-low")
    return both.where("k IS NULL").select("o", "own"), both.where("k IS NOT NULL").select("k", "cnt")


def _partnered(sets: DataFrame, own: DataFrame) -> DataFrame:
    """(node, n, at, own): the nodes that may have a partner; `at` is where one of a node's texts is found."""
    nodes = sets.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "key")).alias("at"), F.first("n").alias("n"))
    spare = F.col("n") - F.ceil(F.col("n") * F.lit(NUM) / F.lit(DEN))
    return nodes.join(own, F.col("node") == F.col("o"), "left").withColumn("own", F.coalesce("own", F.lit(0))).where(F.col("own") <= spare).select("node", "n", "at", "own")


def _tokens(docs: DataFrame, partnered: DataFrame) -> DataFrame:
    """(node, n, own, tokens) of these nodes, once each but for rows that repeat in id and text. Texts are found by id and hash: an id, null among
    them, may stand for any number of texts."""

    def op(batches):
        memo, last = WordHash(), None
        for b in batches:
            rows = []
            for text, node, n, own in zip(b["text"], b["node"], b["n"], b["own"], strict=True):
                if node != last and _node(s := _set_of(text, memo)) == node:
                    rows.append((node, n, own, s.tobytes()))
                    last = node  # repeated rows stand one after another
            yield pd.DataFrame(rows, columns=["node", "n", "own", "tokens"])

    # always by shuffle: the table of partnered nodes grows with the input, so no size of it should be broadcast
    found = F.col("id").eqNullSafe(F.col("at.id")) & (F.xxhash64("text") == F.col("at.key"))
    return docs.join(partnered.hint("merge"), found).select("text", "node", "n", "own").mapInPandas(op, "node long, n long, own long, tokens binary")


def _regions(tokens: DataFrame, shared: DataFrame) -> DataFrame:
    """(v, c): the region c of each node v that shares one of its first shingles with another node.

    The order of shingles: low ones by count, then the rest by hash. A set's own ones come first and route nowhere; `need` is how many of
    the shared ones follow them. Where the low ones do not suffice, Python adds the first of the rest.
    """
    bits = CUT_BITS

    def op(batches):
        for b in batches:
            parts = []
            for node, n, own, raw in zip(b["node"], b["n"], b["own"], b["tokens"], strict=True):
                s = np.frombuffer(raw, np.uint64)
                low, need = _low(s, bits), n + 1 - -(-NUM * n // DEN) - own
                rest = _cut(s[np.searchsorted(s, LOW) :][: max(need - (len(low) - own), 0)], bits)
                parts += [(low, node, need, False), (rest, node, need, True)]
            sizes = [len(x[0]) for x in parts]
            yield pd.DataFrame({"s": np.concatenate([x[0] for x in parts]), "node": np.repeat(np.array([x[1] for x in parts], np.int64), sizes), "need": np.repeat(np.array([x[2] for x in parts], np.int64), sizes), "rest": np.repeat(np.array([x[3] for x in parts], bool), sizes)})

    rows = tokens.mapInPandas(op, "s long, node long, need long, rest boolean")
    low = rows.where("NOT rest").join(shared, F.col("s") == F.col("k")).withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("cnt", "s")))
    first = stored(low.where("at <= need").select("s", "node").unionByName(rows.where("rest").select("s", "node")), "jaccard-first")
    least = first.groupBy("s").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select(F.col("s").alias("k"), "least")
    pairs = first.join(least, F.col("s") == F.col("k")).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    return components(pairs, "jaccard-regions")


def _trees(rows: DataFrame, by: list[str], region: str, known: str | None = None) -> DataFrame:
    """(a, b): links of a signature tree for each region within each group of rows (by..., region, node, tokens)."""

    def join(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in g.drop_duplicates("node").groupby(region, sort=False):
            nodes = part["node"].tolist()
            tree = SignatureTree([np.frombuffer(t, np.uint64) for t in part["tokens"]], known=part[known].tolist() if known else None)
            out += [(nodes[a], nodes[b]) for a, b in tree.links()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.select(*dict.fromkeys([*by, region, "node", "tokens", *([known] if known else [])])).groupBy(*by).applyInPandas(join, "a long, b long")


def _class(shift: float) -> Column:
    """Sets in classes further apart than next to each other are too unlike in size to link."""
    return F.floor(F.log(F.col("n")) / F.log(F.lit(DEN / NUM)) + shift).cast("int")


def _cut_up(rows: DataFrame, by: list[str], seed: int) -> DataFrame:
    """rows (..., node, n) with `part`, so that no (by..., part) has many more than BLOCK_SETS sets or BLOCK_SHINGLES shingles."""
    size = rows.groupBy(*[F.col(c).alias(f"{c}_") for c in by]).agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("parts"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by]
    return rows.join(size, same).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("parts")).cast("int")).drop("parts", *[f"{c}_" for c in by])


def _roots(rows: DataFrame) -> DataFrame:
    """(c, block, lo, hi, first, last, extra, bits): what a block's root holds; rows: c, block, n, known, tokens. Tasks combine what they hold before it is shuffled."""

    def joined(parts: list[tuple]) -> tuple:
        lo, hi, first, last, extra, bits = zip(*parts, strict=True)
        return min(lo), max(hi), min(first), max(last), max(extra), np.bitwise_or.reduce([np.frombuffer(x, np.uint64) for x in bits]).tobytes()

    names = ["c", "block", "lo", "hi", "first", "last", "extra", "bits"]

    def local(batches):
        for b in batches:
            found: dict[tuple, list] = {}
            for c, block, n, known, raw in zip(b["c"], b["block"], b["n"], b["known"], b["tokens"], strict=True):
                m = bitmap(np.frombuffer(raw, np.uint64), ROOT_BITS)
                found.setdefault((c, block), []).append((n, n, known, known, n - int(np.bitwise_count(m).sum()), m.tobytes()))
            yield pd.DataFrame([(*k, *joined(v)) for k, v in found.items()], columns=names)

    def total(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *joined(list(g[names[2:]].itertuples(index=False))))], columns=names)

    schema = "c long, block long, lo long, hi long, first long, last long, extra long, bits binary"
    return rows.select("c", "block", "n", "known", "tokens").mapInPandas(local, schema).groupBy("c", "block").applyInPandas(total, schema)


def _pairs(roots: DataFrame) -> DataFrame:
    """(x, y): pairs of blocks of a region, x <= y, between which a link may be missing. Sizes and components are weighed before bitmaps meet."""
    a, b = roots.drop("bits").alias("a"), roots.drop("bits").alias("b")
    one = F.expr("a.first = a.last AND b.first = b.last AND a.first = b.first")
    sizes = F.expr(f"a.block <= b.block AND {DEN} * a.hi >= {NUM} * b.lo AND {DEN} * b.hi >= {NUM} * a.lo")
    few = a.join(b, F.expr("a.c = b.c") & sizes & ~one).select(F.col("a.block").alias("x"), F.col("b.block").alias("y"), F.least("a.extra", "b.extra").alias("extra"), F.expr("a.lo + b.lo").alias("lo"))
    bits = lambda k: roots.select(F.col("block").alias(k), F.col("bits").alias(f"{k}_bits"))

    def may_link(batches):
        for p in batches:
            most = [int(np.bitwise_count(np.frombuffer(x, np.uint64) & np.frombuffer(y, np.uint64)).sum()) for x, y in zip(p["x_bits"], p["y_bits"], strict=True)]
            yield p.loc[(NUM + DEN) * (np.array(most, np.int64) + p["extra"].to_numpy()) >= NUM * p["lo"].to_numpy(), ["x", "y"]]

    return few.join(bits("x"), "x").join(bits("y"), "y").mapInPandas(may_link, "x long, y long")


def _large_links(rows: DataFrame) -> DataFrame:
    """(a, b): links that span the similar nodes of each large region. rows: c, node, n, tokens, stored."""
    tries = [_trees(_cut_up(rows.withColumn("cls", _class(k / 2)), ["c", "cls"], k), ["c", "cls", "part"], "c") for k in range(2)]
    links = stored(tries[0].unionByName(tries[1]), "jaccard-tries")
    known = components(links, "jaccard-known")
    rows = rows.join(known.select(F.col("v"), F.col("c").alias("of")), F.col("node") == F.col("v"), "left").drop("v").withColumn("known", F.coalesce("of", "node"))
    # blocks of one component each where that fills them, and of all others
    large = rows.groupBy(F.col("known").alias("k")).agg(F.count("*").alias("m")).where(F.col("m") >= max(BLOCK_SETS // 8, 2)).select("k")
    rows = rows.join(large, F.col("known") == F.col("k"), "left").withColumn("cls", _class(0.0))
    rows = _cut_up(rows, ["c", "k", "cls"], 2).withColumn("block", F.xxhash64("c", "k", "cls", "part"))
    rows = stored(rows.select("c", "node", "n", "known", "block", "tokens"), "jaccard-blocks")
    pairs = stored(_pairs(stored(_roots(rows), "jaccard-roots")), "jaccard-pairs")
    meet = pairs.withColumn("z", F.explode(F.array_distinct(F.array("x", "y"))))
    both = rows.join(meet, F.col("block") == F.col("z"))
    return links.unionByName(_trees(both, ["x", "y"], "c", "known"))


def _links(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """(a, b): links that span the similar nodes of each region."""
    members = stored(tokens.select("node", "n").join(regions, F.col("node") == F.col("v")).select("v", "n", "c").distinct(), "jaccard-members")
    large = (F.count("*") > BLOCK_SETS) | (F.sum("n") > BLOCK_SHINGLES)
    place = members.join(members.groupBy(F.col("c").alias("c2")).agg(large.alias("large")), F.col("c") == F.col("c2")).select("v", "c", "large")
    sizes = {r["large"]: r["n"] for r in place.join(members.select(F.col("v").alias("w"), "n"), F.col("v") == F.col("w")).groupBy("large").agg(F.sum("n").alias("n")).collect()}  # two rows
    # by shuffle at every size, as above: places grow with the input
    near = lambda which: tokens.join(place.where(which).hint("merge"), F.col("node") == F.col("v")).select("c", "node", "n", "tokens")
    packs = int(sizes.get(False, 0) // PACK_SHINGLES) + 1
    links = _trees(near("NOT large").withColumn("g", F.pmod(F.xxhash64("c"), F.lit(packs))), ["g"], "c")
    return links.unionByName(_large_links(stored(near("large"), "jaccard-large"))) if sizes.get(True) else links


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs: component_id is the least id reachable by links.

    Texts that are null or hold no word have no shingles and are linked with nothing. Repeated rows give a row each; rows without an id
    take part as any other, but a component takes its name from those with one; an id may repeat with other texts. An empty table gives an
    empty result.
    """
    short_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = stored(_sets(src), "jaccard-sets")
    own, shared = _counts(src)
    tokens = stored(_tokens(src, _partnered(sets, own)), "jaccard-tokens")
    links = _links(tokens, _regions(tokens, shared))
    groups = components(links, "jaccard-groups")
    least = sets.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"))
    least = least.join(groups, F.col("node") == F.col("v"), "left").select("node", "rep", F.coalesce("c", "node").alias("c"))
    names = least.groupBy("c").agg(F.min("rep").alias("name"))
    named = least.join(names.withColumnRenamed("c", "c2"), F.col("c") == F.col("c2")).select(F.col("node").alias("node2"), "name")
    out = sets.select("id", "n", "node").join(named, F.col("node") == F.col("node2"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "id").alias("component_id"))


#: The same rows in DuckDB by plain self-join, for tables of a size where that ends.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))
), reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT y, c FROM reach JOIN links ON x = reach.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, MIN(c) AS component_id FROM s JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""
