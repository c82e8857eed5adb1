"""Merkle manifest, conversation repair and substring removal against brute force and their SQL."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from lakeloom.llm import merkle, repair, substrings
from lakeloom.llm.shingles import WordHash, word_hashes


def as_rows(df):
    return sorted(map(str, df.itertuples(index=False, name=None)))


def same_as_sql(spark_df, sql, **tables):
    """The rows of both, with whole numbers as they are where nulls are among them."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    want = con.sql(sql)
    got = spark_df.select(want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


# ---- merkle


def naive(leaves, fan):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


@pytest.mark.parametrize("fan, step", [(2, 1), (2, 3), (3, 2), (8, 1), (8, 2)])
def test_traversal_gives_all_paths(fan, step):
    for n in [*range(1, 30), 63, 64, 65, 130, 513]:
        leaves = [merkle.digest(str(i)) for i in range(n)]
        levels = naive(leaves, fan)
        height = merkle.depth(n, fan)
        assert height == len(levels) - 1
        tree = merkle.Traversal(leaves, height, fan, step)
        paths = list(tree.paths())
        assert tree.root == levels[-1][0] and len(paths) == n
        for x, path in enumerate(paths):
            want, at = [], x
            for nodes in levels[:-1]:
                start = at - at % fan
                want += ["".join(nodes[start:at]), "".join(nodes[at + 1 : start + fan])]
                at //= fan
            assert path == want


def test_traversal_holds_few_nodes():
    leaves = [merkle.digest(str(i)) for i in range(4096)]
    tree, most = merkle.Traversal(leaves, 4, 8, 1), 0
    held = lambda t: sum(map(len, t.kept)) + sum(map(len, t.runs))
    for _ in tree.paths():
        most = max(most, sum(map(held, [*tree.exist, *tree.desire])))
    assert most <= 4 * (2 * 8 + 4 * 8)  # of 4,096 leaves


def test_manifest_as_sql(spark, messy):
    same_as_sql(merkle.tamper_digest(messy), merkle.SQL, documents=messy)
    rows = [(i if i % 50 else None, f"Text {i % 700}", None if i % 11 == 0 else "é" if i % 7 == 0 else f"l{i % 3}", f"s{i % 4}", i) for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    same_as_sql(merkle.tamper_digest(docs), merkle.SQL, documents=docs)


def test_small_blocks_and_deep_trees(spark):
    """Blocks of 4 leaves, so that several levels of blocks stand above each other."""
    rows = [(i, f"t{i}", "a" if i < 300 else "b") for i in range(320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    out = merkle.manifest(docs, merkle.leaf_of(F.col("doc_id"), F.col("text")), fan=2, levels=2).withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    leaves = {g: [merkle.digest(f"{len(str(i))}:{i}{len(t)}:{t}") for i, t, lang in rows if lang == g] for g in "ab"}
    roots = {g: naive(x, 2)[-1][0] for g, x in leaves.items()}
    whole = merkle.digest(roots["a"] + roots["b"])
    assert all(r["root"] == whole == r["back"] and r["subroot"] == roots["a" if r["doc_id"] < 300 else "b"] for r in out) and len(out) == 320
    assert {len(r["path"]) for r in out if r["doc_id"] < 300} == {2 * 10} and {len(r["path"]) for r in out if r["doc_id"] >= 300} == {2 * 6}


# ---- repair


def brute(signature):
    """Every way to edit, with at most two inserts in a row."""
    best = None
    for gaps in itertools.product(("", "I", "II"), repeat=len(signature) + 1):
        for letters in itertools.product("DKR", repeat=len(signature)):
            if any(s == "d" and x != "D" for s, x in zip(signature, letters, strict=True)):
                continue
            text = "".join(g + x for g, x in zip(gaps, (*letters, ""), strict=True))
            cost = 3 * text.count("I") + 3 * text.count("R") + 4 * text.count("D") + sum(3 for s, x in zip(signature, letters, strict=True) if s.isupper() and x != "D")
            if best and (cost, text) >= best:
                continue
            slots = [["u", "a"]] * len(gaps[0])
            for s, x, g in zip(signature, letters, gaps[1:], strict=True):
                slots = slots + ([[s.lower()]] if x == "K" else [["u", "a"]] if x == "R" else []) + [["u", "a"]] * len(g)
            if any(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in itertools.product(*slots)):
                best = (cost, text)
    return best


def test_trie_finds_the_cheapest_edits():
    rng = random.Random(4)
    found = sorted({"".join(rng.choice("suaoSUAOd") for _ in range(rng.randint(0, 3))) for _ in range(160)} | {"", "suau", "aauu", "sdua", "uuAa"})
    trie = repair.Trie()
    assert [trie.answer(s) for s in found] == [brute(s) for s in found]
    assert trie.made < sum(map(len, found))  # shared prefixes are computed once


def test_layers_are_computed_once_a_prefix():
    trie = repair.Trie()
    for tail in ("", "a", "au", "aua"):
        trie.answer("u" * 50 + tail)
    assert trie.made == 53 and repair.Trie().answer("ua" * 5000) == (0, "K" * 10_000)


def test_repair_as_sql(spark):
    rng = random.Random(9)
    words = ["Yes.", "No?", "cut off", "", " \t", "Fine!", None, "one. two. three", "é."]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(words), rng.choice([None, "z"])) for _ in range(700)]
    rows += [(900 + i, i % 3, "user", "Same text.", None) for i in range(40)] + [(2**60 + i, None, "user", "a.", None) for i in (1, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string").repartition(5)
    same_as_sql(repair.repair_digest(df), repair.SQL, conversations=df)
    assert repair.repair_digest(df.where("false")).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "cut"), (1, 3, "user", "Hm?"), (2, 5, "tool", " "), (3, 1, "user", "Q?"), (3, 1, "user", "Q?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {}
    for r in repair.repair(df).orderBy("conv_id", "turn").collect():
        out.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    # another role costs less than a turn put in before and one deleted; the duplicate goes, an answer is put in; nothing is left of a blank turn
    assert out == {1: [(0, "system", "Be kind."), (1, "user", "Hello."), (2, "assistant", "cut"), (3, "user", "Hm?"), (4, "assistant", "")], 3: [(0, "user", "Q?"), (1, "assistant", "")]}


# ---- windows


def test_windows_as_sql(spark, messy):
    short = messy.where("doc_id IS NULL OR doc_id <> 28")  # the SQL is slow on very long texts
    same_as_sql(substrings.dedup_digest(short), substrings.SQL, documents=short)


def test_windows_by_blocks_and_shards(spark):
    """Passages shared within and across blocks, repeated inside one text, ids near 2^62 with nulls among them; small blocks and many shards."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["é", "x" * 200]
    shared = [" ".join(rng.choice(vocab) for _ in range(rng.randint(10, 40))) for _ in range(12)]
    rows = []
    for i in range(240):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(3)] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(parts)
        rows.append((None if i % 40 == 7 else 2**62 + i // 2 * 2 + (i % 3 == 0), rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(5, None), (6, ""), (7, shared[0] + " " + shared[0]), (2**62 + 999, shared[0]), (None, shared[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substrings.dedup_windows(docs, block_bytes=4_000, per_shard=500)
    from pyspark.sql import functions as F

    same_as_sql(got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")), substrings.SQL, documents=docs)
    assert got.agg(F.sum("n_removed")).first()[0] > 1000


def test_sketch_never_says_too_little():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    blocks = [np.unique(rng.choice(pool, 900)) for _ in range(6)]
    for shards in (1, 3, 7):
        for shard in range(shards):
            own = [b[substrings.shard_of(b, shards) == shard] for b in blocks]
            cells = [substrings.cells_of(b, shards) for b in own]
            assert all((substrings.unpacked(substrings.packed(c)) == c).all() for c in cells)
            twice = [np.zeros(len(b), bool) for b in own]
            if len(own[0]):
                twice[0][0] = True
            sketch = substrings.Sketch(list(zip(cells, twice, strict=True)))
            count = {x: sum(x in set(b.tolist()) for b in own) for b in own for x in b.tolist()}
            for b, c, t in zip(own, cells, twice, strict=True):
                said = sketch.repeated(c)
                assert all(said[i] for i, x in enumerate(b.tolist()) if count[x] > 1 or t[i])


def test_words_are_told_apart():
    """Periodic words on which sums of powers modulo 2^64 agree; short and long words next to each other, across stretches."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    memo, other = WordHash(), word.translate(str.maketrans("ab", "ba"))
    assert word_hashes(word, memo) != word_hashes(other, memo)
    parts = ["y" * 64, "y" * 65, word, "é" * 40, "z" * (1 << 21), "q"]
    alone = [int(word_hashes(p, memo)[0]) for p in parts]
    assert word_hashes("  ".join(parts) + "\n", memo).tolist() == alone and len(set(alone)) == len(alone)
