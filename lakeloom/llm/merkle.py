"""Merkle manifest of a table: a leaf for each row, a tree for each group, a tree over the groups' roots, and a proof for each row.

1. Rows become leaves (JVM). One sort by range numbers the leaves of each group; only hashes and ids move.
2. Aligned blocks of FAN^levels leaves send their roots up, block roots make blocks of their own, and so on until one node is left in every
   group. The groups' roots, in order, are the leaves of the last tree.
3. Down again: each block is walked by a fractal traversal (Traversal). It gives the successive authentication paths from stacked existing and
   desired subtrees, whose memory does not grow with the leaves, and appends what the block's root has above it.

A level of blocks divides the nodes by FAN^levels, so a million million rows take four of them. Only one number, the most nodes that a group
has left, reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import CRC32, stored

#: Children of a node.
FAN = 8
#: Levels of a block, and of the subtrees that its traversal keeps.
LEVELS, STEP = 4, 2


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int, fan: int = FAN) -> int:
    """Levels above n leaves, until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


# ---- one tree


class Subtree:
    """Hashes leaves, given in order, into nodes up to level `high`, and keeps the nodes of levels `low` to `high` - 1. Of lower levels only the open run is held."""

    def __init__(self, low: int, high: int, fan: int = FAN):
        self.low, self.fan, self.root = low, fan, None
        self.runs: list[list[str]] = [[] for _ in range(high)]
        self.kept: list[list[str]] = [[] for _ in range(high - low)]

    def add(self, node: str, level: int = 0) -> None:
        if level == len(self.runs):
            self.root = node
            return
        if level >= self.low:
            self.kept[level - self.low].append(node)
        self.runs[level].append(node)
        if len(self.runs[level]) == self.fan:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self.add(digest("".join(run)), level + 1)

    def finish(self) -> Subtree:
        """No leaf follows: runs that are open become nodes, however short."""
        for level in range(len(self.runs)):
            if self.runs[level]:
                self._close(level)
        return self


class Traversal:
    """The authentication paths of all leaves of a tree of `height` levels, in order.

    The levels are cut into layers of `step`. Each layer keeps its existing subtree, the one above the present leaf, and but for the top its
    desired one, the next to the right: that takes one leaf with each path given, and so is whole when the existing one is left and gives
    way to it. Nodes that are kept: at most 2 * layers * FAN^step and their ancestors.
    """

    def __init__(self, leaves: Sequence[str], height: int, fan: int = FAN, step: int = STEP):
        self.leaves, self.fan = leaves, fan
        self.layers = [(low, min(low + step, height)) for low in range(0, height, step)]
        self.exist = [self._first(low, high) for low, high in self.layers]
        self.desire = [Subtree(low, high, fan) for low, high in self.layers]
        self.root = self.exist[-1].root if self.layers else leaves[0]

    def _first(self, low: int, high: int) -> Subtree:
        tree = Subtree(low, high, self.fan)
        for leaf in self.leaves[: self.fan**high]:
            tree.add(leaf)
        return tree.finish()

    def paths(self) -> Iterator[list[str]]:
        """For each leaf: the siblings on its left, joined, then those on its right, for each level from below."""
        fan = self.fan
        for x in range(len(self.leaves)):
            path: list[str] = []
            for k, (low, high) in enumerate(self.layers):
                span = fan**high
                if x and x % span == 0:
                    self.exist[k], self.desire[k] = self.desire[k].finish(), Subtree(low, high, fan)
                if x + span < len(self.leaves):
                    self.desire[k].add(self.leaves[x + span])
                for level in range(low, high):
                    at = x % span // fan**level
                    start = at - at % fan
                    run = self.exist[k].kept[level - low][start : start + fan]
                    path += ["".join(run[: at - start]), "".join(run[at - start + 1 :])]
            yield path


# ---- many rows


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with idx, the place (from 0) in its group by `order`, nulls first, and n, the group's rows. One sort by range, so a group of any size
    is dealt over many tasks; then each task's share learns what the tasks before it hold of the group."""
    keys = [group, *order]
    # a partition's number stands above bit 33 of the ids given here, a row's place in it below
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_g", F.monotonically_increasing_id()), f"{name}-order").withColumn("_p", F.shiftright("_g", 33))
    starts = placed.groupBy(F.col(group).alias("_group"), F.col("_p").alias("_part")).agg(F.count("*").alias("_n"), F.min("_g").alias("_first"))
    w = W.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(starts.select("_group", "_part", "_first", before.alias("_before"), F.sum("_n").over(w).alias("n")), f"{name}-starts")
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_p") == F.col("_part")))
    return joined.withColumn("idx", F.col("_g") - F.col("_first") + F.col("_before")).select(*rows.columns, "idx", "n")


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / F.lit(size)).cast("long"))


def _roots(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """(g, idx, n, hash): the roots of the blocks of nodes (g, idx, n, hash)."""
    size = fan**levels

    def root(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        n = int(b["n"].iloc[0])
        height = min(levels, depth(n, fan))
        tree = Subtree(height, height, fan)
        for node in b.sort_values("idx")["hash"]:
            tree.add(node)
        return pd.DataFrame({"g": [key[0]], "idx": [key[1]], "n": [-(-n // size)], "hash": [tree.finish().root]})

    return _blocks(nodes.select("g", "idx", "n", "hash"), size).groupBy("g", "block").applyInPandas(root, "g string, idx long, n long, hash string")


def _walked(nodes: DataFrame, above: DataFrame, fan: int, levels: int) -> DataFrame:
    """nodes (g, idx, n, hash, ...) with path and root; above: (g, idx, path, root) of their blocks. What a block has above it is sent once."""
    size = fan**levels
    kept = [c for c in nodes.columns if c not in ("n", "hash")]

    def walk(_: tuple, b: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("idx")
        tree = Traversal(b["hash"].tolist(), min(levels, depth(int(b["n"].iloc[0]), fan)), fan)
        rest = list(up["path"].iloc[0])
        return b[kept].assign(path=[p + rest for p in tree.paths()], root=up["root"].iloc[0])

    schema = ", ".join(f"{c} {t}" for c, t in nodes.select(kept).dtypes) + ", path array<string>, root string"
    tops = above.select("g", F.col("idx").alias("block"), "path", "root")
    return _blocks(nodes, size).groupBy("g", "block").cogroup(tops.groupBy("g", "block")).applyInPandas(walk, schema)


def _above(nodes: DataFrame, name: str, fan: int, levels: int) -> DataFrame:
    """(g, idx, path, root) for the blocks of nodes (g, idx, n, hash): what stands between a block and the root of its group."""
    roots = stored(_roots(nodes, fan, levels), f"{name}-roots")
    if (roots.agg(F.max("n")).first()[0] or 0) <= 1:
        return roots.select("g", "idx", F.array().cast("array<string>").alias("path"), F.col("hash").alias("root"))
    return stored(_walked(roots, _above(roots, name, fan, levels), fan, levels), f"{name}-paths")


def field(value: Column) -> Column:
    """A value as it goes into a leaf: `-` if null, else its length in bytes of UTF-8, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    pairs = F.transform(F.filter(path, lambda _, i: i % 2 == 0), lambda left, i: F.struct(left.alias("l"), F.element_at(path, (2 * i + 2).cast("int")).alias("r")))
    return F.aggregate(pairs, leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]).cast("binary"), 256))


def manifest(docs: DataFrame, leaf: Column, claimed: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, claimed, subroot, root, path) for each row of docs.

    leaf: the row's digest (see leaf_of); claimed: another one that is carried along, to be held against the proof, null where none is given.
    A group's leaves ascend by id, null ids first, rows that agree in group and id by leaf; groups ascend bytewise, null first. While several
    nodes remain, every `fan` consecutive ones become their digest, the last run fewer. path holds, for each level up to the root of all, the
    digests left and right of the row's own, joined. Rows that repeat are leaves of their own; texts may be null, empty or of any length;
    other columns are not read; an empty table gives an empty result.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    ids = F.col(id_col)
    rows = docs.select(g.alias("g"), ids.alias("id"), leaf.alias("hash"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    kind = rows.schema["id"].dataType
    # as text the ids go through Python as they are
    nodes = numbered(stored(rows, "merkle-leaves"), "g", ["id", "hash"], "merkle").withColumn("id", F.col("id").cast("string")).withColumn("leaf", F.col("hash"))
    above = stored(_above(nodes, "merkle", fan, levels), "merkle-above")
    subroots = above.select(F.col("g").alias("group"), F.col("root").alias("hash")).distinct().withColumn("g", F.lit("all"))
    subroots = stored(numbered(subroots, "g", ["group"], "merkle-groups"), "merkle-subroots")
    top = stored(_walked(subroots, _above(subroots, "merkle-top", fan, levels), fan, levels), "merkle-top")
    top = top.select(F.col("group").alias("g2"), F.col("path").alias("last"), F.col("root").alias("whole"))
    # the root of all and the group's own travel as one text
    both = above.join(top, F.col("g") == F.col("g2")).select("g", "idx", F.concat("path", "last").alias("path"), F.concat_ws(":", "root", "whole").alias("root"))
    out = _walked(nodes, both, fan, levels)
    split = F.split("root", ":")
    return out.select(F.col("id").cast(kind).alias(id_col), "leaf", "claimed", split[0].alias("subroot"), split[1].alias("root"), "path")


# A-Z and their lower case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tamper_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): documents with their proofs, where a third of them was tampered with
    after the manifest was made: of those whose crc32 of the id is divisible by 3, A-Z of the text is in lower case. A row without an id is
    not tampered with."""
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    forged = F.translate("text", UPPER, UPPER.lower())
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = manifest(docs, leaf_of(*cols, F.col("text")), F.when(hit, leaf_of(*cols, forged)))
    made = made.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path", "").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    part = lambda c: f"COALESCE(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    up = lambda: f"list_transform(range(0, CAST((len(nodes) + {FAN - 1}) // {FAN} AS BIGINT)), lambda i: sha256(array_to_string(nodes[{FAN} * i + 1:{FAN} * i + {FAN}], '')))"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({head} || {part("text")}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({head} || {part(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}) END AS forged FROM documents
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
t AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY idx) AS nodes FROM r GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, {up()} FROM t WHERE len(nodes) > 1
), sub AS (SELECT lang, nodes[1] AS subroot, lvl AS height, ROW_NUMBER() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS lvl, list(subroot ORDER BY place) AS nodes FROM sub
  UNION ALL SELECT lvl + 1, {up()} FROM top WHERE len(nodes) > 1
), runs AS (
  SELECT s.lang, t.lvl, t.nodes, 0 AS cut FROM t JOIN sub s ON s.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
  UNION ALL SELECT s.lang, s.height + top.lvl, top.nodes, 1 FROM top, sub s WHERE len(top.nodes) > 1
), sib AS (
  SELECT doc_id, idx, r.lang, lvl, nodes[run + 1:pos] AS l, nodes[pos + 2:run + {FAN}] AS rt FROM (
    SELECT r.*, lvl, nodes, CASE WHEN cut = 0 THEN idx // CAST({FAN}**lvl AS BIGINT) ELSE place // CAST({FAN}**(lvl - height) AS BIGINT) END AS pos, pos - pos % {FAN} AS run
    FROM r JOIN sub s ON s.lang IS NOT DISTINCT FROM r.lang JOIN runs ON runs.lang IS NOT DISTINCT FROM r.lang) r
), paths AS (SELECT lang, idx, list({{'l': array_to_string(l, ''), 'r': array_to_string(rt, '')}} ORDER BY lvl) AS p FROM sib GROUP BY lang, idx),
w AS (
  SELECT r.*, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, COALESCE(p, []) AS p
  FROM r JOIN sub s ON s.lang IS NOT DISTINCT FROM r.lang LEFT JOIN paths ON paths.lang IS NOT DISTINCT FROM r.lang AND paths.idx = r.idx
), fold AS (
  SELECT lang, idx, 0 AS k, COALESCE(forged, leaf) AS cur, p FROM w
  UNION ALL SELECT lang, idx, k + 1, sha256(p[k + 1].l || cur || p[k + 1].r), p FROM fold WHERE k < len(p)
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(w.p, lambda x: x.l || x.r), '')) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM w JOIN fold f ON f.lang IS NOT DISTINCT FROM w.lang AND f.idx = w.idx AND f.k = len(f.p)
"""


#: The rows of tamper_digest(documents) in DuckDB.
SQL = _sql()
