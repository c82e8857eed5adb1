"""Repair of conversation structure: the cheapest edits after which a conversation reads system?, user, assistant, user, assistant, ...

1. Turns become symbols: what their role is and what is wrong with them. Copies of a turn are counted before they are ordered, and a turn is a
   copy of an earlier one by a rank among the equal texts of its conversation. A conversation's symbols in order are its signature.
2. Distinct signatures are sorted by range. Each task walks its share as a prefix trie (Trie): one layer of the dynamic program for each node,
   computed once however many signatures pass it; answers are given at the nodes where signatures end. Only the path to the present node
   is held.
3. The answer, one letter an edit, meets the turns again in order and rewrites them.

A signature that very many conversations share is dealt to SALTS keys, so neither its join nor its rows meet in one task. A conversation's own turns
stream through one task in order, since the digest of what is repaired is one hash over all of it: texts are never gathered, a letter a turn is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import CRC32, short_batches, stored

# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Keys that one signature is dealt to.
SALTS = 32
WHITE = r"[\x20\x09-\x0D]"

# States of what has been given out: nothing, a system turn alone, ended by a user, ended by an assistant.
START, SYSTEM, USER, DONE = range(4)
#: Where a role's initial leads from a state.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, DONE: USER}, "a": {USER: DONE}}
#: The turn that may be inserted in a state, or that any turn may become.
WANTED = {START: "u", SYSTEM: "u", USER: "a", DONE: "u"}
#: Inserts that can pay, from a state: a third one would come back to a state at a cost.
INSERTS = {q: [(q, "", 0), (NEXT[WANTED[q]][q], "I", INSERT), *([(DONE, "II", 2 * INSERT)] if q != USER else [])] for q in range(4)}

#: Symbols: a turn that must go, and others by their role's initial, in upper case if truncated.
GONE = "d"
Layer = dict[int, tuple[int, int, int, str]]


def grown(layer: Layer, symbol: str) -> Layer:
    """The layer after one more turn. Layer: by state the cost, the rank of its letters among those of all states, the state before and the letters
    since. Letters up to a turn all end with that turn's own, so none is the start of another, and ranks and added letters order them."""
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    best: dict[int, tuple[int, tuple[int, str], int]] = {}
    for q, (cost, rank, _, _) in layer.items():
        for at, letters, paid in INSERTS[q]:
            steps = [("D", at, DELETE)]
            if symbol != GONE:
                steps.append(("R", NEXT[WANTED[at]][at], REROLE + extra))
                if at in NEXT.get(role, {}):
                    steps.append(("K", NEXT[role][at], extra))
            for letter, to, price in steps:
                found = (cost + paid + price, (rank, letters + letter), q)
                if to not in best or found < best[to]:
                    best[to] = found
    ranks = {key: i for i, key in enumerate(sorted(x[1] for x in best.values()))}
    return {to: (cost, ranks[key], q, key[1]) for to, (cost, key, q) in best.items()}


class Trie:
    """Signatures in sorted order, as the path to the present node: symbols and the layer of each. A signature keeps the layers of the prefix
    that it shares with the one before it."""

    def __init__(self) -> None:
        self.path: list[str] = []
        self.layers: list[Layer] = [{START: (0, 0, START, "")}]
        self.made = 0

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, letters) of the cheapest edits, of equal cost the least letters."""
        shared = 0
        for a, b in zip(self.path, signature, strict=False):
            if a != b:
                break
            shared += 1
        del self.path[shared:], self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append(grown(self.layers[-1], symbol))
            self.path.append(symbol)
            self.made += 1
        ends = [(cost + paid, (rank, letters), q) for q, (cost, rank, _, _) in self.layers[-1].items() for at, letters, paid in INSERTS[q] if at in (START, DONE)]
        cost, (_, tail), q = min(ends)
        parts = [tail]
        for layer in reversed(self.layers[1:]):
            _, _, before, letters = layer[q]
            parts.append(letters)
            q = before
        return cost, "".join(reversed(parts))


# ---- tables


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, t, r, x) of the turns as they are damaged by the crc32 of `conv:turn`; a null role or text, and a null in that key, count as one space.
    A conversation all of whose turns are lost leaves no row."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    x = blank(text_col)
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), F.when(kind == 4, F.lit("user")).otherwise(blank(role_col)).alias("r"), F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(x, ".!?", "")).otherwise(x).alias("x"), kind.alias("kind"))
    return rows.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("c", "t", "r", "x")


def _symbols(rows: DataFrame) -> DataFrame:
    """(c, t, r, h, n, symbol, first): the turns in order of (t, r, h), equal ones counted. h: a hash of the text; first: whether the first of the n
    is no copy of an earlier turn."""
    x = F.col("x")
    blank = ~x.rlike(r"[^\x20\x09-\x0D]")
    cut = ~x.rlike(rf"[.!?]{WHITE}*\z")
    role = F.substring("r", 1, 1)
    known = F.when(role.isin("s", "u", "a"), role).otherwise(F.lit("o"))
    symbol = F.when(blank, F.lit("b")).when(cut, F.upper(known)).otherwise(known)
    light = rows.select("c", "t", "r", F.md5(x.cast("binary")).alias("h"), symbol.alias("symbol")).groupBy("c", "t", "r", "h").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol"))
    return light.withColumn("first", F.row_number().over(W.partitionBy("c", "r", "h").orderBy("t")) == 1)


_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _signatures(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, sig, gaps, blank, duplicate, truncated, illegal) of each conversation of convs (c). Its turns are read in order, one after another."""
    schema = f"c {rows.schema['c'].dataType.simpleString()}, sig string, " + ", ".join(f"{f} long" for f in _FACTS)
    none = convs.select("c", *[F.lit(None).cast(t).alias(n) for n, t in _symbols(rows).dtypes if n != "c"])
    both = _symbols(rows).unionByName(none)
    ordered = both.repartition("c").sortWithinPartitions("c", F.col("n").isNotNull(), "t", "r", "h").select("c", "t", "r", "n", "symbol", "first")
    allowed = {("s", "u"), ("u", "a"), ("a", "u")}

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, sig, facts, last, turn, least = None, False, [], [0] * 5, None, None, None
        out: list[tuple] = []

        def close() -> None:
            if held:
                gaps = turn - least + 1 + facts[0] if turn is not None else 0
                out.append((conv, "".join(sig), gaps, *facts[1:]))

        for b in batches:
            for c, t, r, n, symbol, first in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if not held or c != conv:
                    close()
                    conv, held, sig, facts, last, turn, least = c, True, [], [0] * 5, None, None, None
                if n is None:
                    continue
                if t is not None and t != turn:
                    facts[0] -= 1
                    turn, least = t, t if least is None else least
                if symbol == "b":
                    facts[1] += n
                    sig.append(GONE * n)
                else:
                    facts[2] += n - first
                    facts[3] += bool(first and symbol.isupper())
                    sig.append((symbol if first else GONE) + GONE * (n - 1))
                initial = r[:1]
                facts[4] += (last is not None and (last, initial) not in allowed) + (n - 1) * ((initial, initial) not in allowed)
                last = initial
            yield _batch(out, columns)
            out.clear()
        close()
        yield _batch(out, columns)

    columns = [("c", _arrow(rows, "c")), ("sig", pa.string()), *[(f, pa.int64()) for f in _FACTS]]
    return ordered.mapInArrow(op, schema)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


def solve(signatures: DataFrame) -> DataFrame:
    """(sig, salt, cost, audit) for each row of signatures (sig, salt), distinct pairs: sorted by range, each task walks its share as a trie."""
    columns = [("sig", pa.string()), ("salt", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, found = Trie(), None, (0, "")
        for b in batches:
            out = []
            for sig, salt in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if sig != last:
                    last, found = sig, trie.answer(sig)
                out.append((sig, salt, *found))
            yield _batch(out, columns)

    return signatures.select("sig", F.col("salt").cast("long")).repartitionByRange("sig", "salt").sortWithinPartitions("sig", "salt").mapInArrow(op, "sig string, salt long, cost long, audit string")


def _rewritten(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (c, audit, ...) with `repaired`, a row for each conversation and turn that is left: (c, at, role, text); at counts from 0."""
    kind = rows.schema["c"].dataType.simpleString()
    columns = [("c", _arrow(rows, "c")), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _edits(batches):
            yield _batch([(c, at, role, text) for c, at, role, text in batch if at is not None], columns)

    return _ordered(rows, answers).mapInArrow(op, f"c {kind}, at long, role string, text string")


def _ordered(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each conversation's letters, then its turns in order: (c, audit, r, x)."""
    heads = answers.select("c", F.lit(0).alias("k"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("r"), F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("x"), "audit")
    body = rows.select("c", F.lit(1).alias("k"), "t", "r", F.md5(F.col("x").cast("binary")).alias("h"), "x", F.lit(None).cast("string").alias("audit"))
    return heads.unionByName(body).repartition("c").sortWithinPartitions("c", "k", "t", "r", "h").select("c", "audit", "r", "x")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (c, at, role, text) of the turns that are left, and (c, None, None, None) where a conversation ends."""
    conv, letters, at, state, n = None, None, 0, START, 0
    for b in batches:
        out: list[tuple] = []

        def inserts(out=out) -> None:
            nonlocal at, state, n
            while at < len(letters) and letters[at] == "I":
                out.append((conv, n, {"u": "user", "a": "assistant"}[WANTED[state]], ""))
                state, at, n = NEXT[WANTED[state]][state], at + 1, n + 1

        for c, audit, r, x in zip(*(col.to_pylist() for col in b.columns), strict=True):
            if audit is not None:
                if letters is not None:
                    inserts()
                    out.append((conv, None, None, None))
                conv, letters, at, state, n = c, audit, 0, START, 0
                continue
            inserts()
            letter = letters[at]
            at += 1
            if letter != "D":
                initial = r[:1] if letter == "K" else WANTED[state]
                out.append((conv, n, r if letter == "K" else {"u": "user", "a": "assistant"}[initial], x))
                state, n = NEXT[initial][state], n + 1
        yield out
    if letters is not None:
        out = []
        while at < len(letters):  # what is left are inserts
            out.append((conv, n, {"u": "user", "a": "assistant"}[WANTED[state]], ""))
            state, at, n = NEXT[WANTED[state]][state], at + 1, n + 1
        yield [*out, (conv, None, None, None)]


def plan(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of convs (c, distinct), whose turns are rows (c, t, r, x)."""
    found = stored(_signatures(rows, convs).withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS))), "repair-signatures")
    answers = stored(solve(found.select("sig", "salt").distinct()), "repair-answers").select(F.col("sig").alias("sig2"), F.col("salt").alias("salt2"), "cost", "audit")
    # of one key with a part of a signature's conversations each
    return stored(found.join(answers.hint("merge"), (F.col("sig") == F.col("sig2")) & (F.col("salt") == F.col("salt2"))).select("c", *_FACTS, "cost", "audit"), "repair-plan")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text): the turns of all conversations after the cheapest edits, numbered from 0. Deleted turns are gone, inserted ones have an
    empty text. See repair_digest for ties, nulls and empty tables."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    short_batches(turns.sparkSession)
    rows = stored(turns.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), blank(role_col).alias("r"), blank(text_col).alias("x")), "repair-turns")
    done = _rewritten(rows, plan(rows, rows.select("c").distinct()))
    return done.select(F.col("c").alias(conv_col), F.col("at").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col))


def repair_digest(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation, whose turns are damaged first.

    Turns are ordered by number, null numbers first, then by role and a hash of the text; rows that repeat are turns, all but the first of
    them duplicates. A null role or text is one space; null conversations are one conversation; other columns are not read. A
    conversation without a turn after the damage has zeros, no edit and the hash of nothing; an empty table gives an empty result.
    """
    short_batches(turns.sparkSession)
    rows = stored(damaged(turns), "repair-turns")
    answers = plan(rows, turns.select(F.col("conv_id").alias("c")).distinct())
    kind = rows.schema["c"].dataType.simpleString()
    columns = [("c2", _arrow(rows, "c")), ("repaired_sha256", pa.string())]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in _edits(batches):
            out = []
            for c, at, role, text in batch:
                if at is None:
                    out.append((c, digest.hexdigest()))
                    digest = hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if at else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _batch(out, columns)

    hashes = _ordered(rows, answers).mapInArrow(op, f"c2 {kind}, repaired_sha256 string")
    out = answers.join(hashes, F.col("c").eqNullSafe(F.col("c2")))
    return out.select(F.col("c").alias("conv_id"), *_FACTS, "cost", "audit", "repaired_sha256")


def _sql() -> str:
    add = lambda s, cost, letters: f"CASE WHEN {s} IS NOT NULL THEN {{'cost': {s}.cost + {cost}, 'a': {s}.a || '{letters}'}} END"
    least = lambda *options: f"least({', '.join(options)})"
    stay = lambda s, letter, cost: f"CASE WHEN NOT gone THEN {add(s, cost, letter)} END"
    keep = lambda s, initial: f"CASE WHEN ini = '{initial}' THEN {stay(s, 'K', 'extra')} END"
    crc = CRC32.format("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")
    blank, cut = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*$"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id AS c, turn AS t, COALESCE(role, ' ') AS r, COALESCE(text, ' ') AS x, {crc} % 20 AS kind FROM conversations),
e AS (
  SELECT c, t, CASE WHEN kind = 4 THEN 'user' ELSE r END AS r, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
), o AS (
  SELECT *, substr(r, 1, 1) AS ini, ROW_NUMBER() OVER (PARTITION BY c ORDER BY t NULLS FIRST, r, md5(x), copy) AS n FROM e
), q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c, r, x ORDER BY n) AS seen FROM o),
f AS (
  SELECT *, LAG(ini) OVER (PARTITION BY c ORDER BY n) AS prev, CASE WHEN NOT regexp_matches(x, '{blank}') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(x, '{cut}') THEN 'truncated' ELSE '' END AS fault FROM q
), facts AS (
  SELECT c, COUNT(*) AS turns, COALESCE(MAX(t) - MIN(t) + 1 - COUNT(DISTINCT t), 0) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate,
    COUNT(*) FILTER (fault = 'truncated') AS truncated, COUNT(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c
), every AS (SELECT DISTINCT c FROM k),
dp AS (
  SELECT c, CAST(0 AS BIGINT) AS i, {{'cost': CAST(0 AS BIGINT), 'a': ''}} AS s0, CAST(NULL AS STRUCT(cost BIGINT, a VARCHAR)) AS s1, CAST(NULL AS STRUCT(cost BIGINT, a VARCHAR)) AS s2, CAST(NULL AS STRUCT(cost BIGINT, a VARCHAR)) AS s3 FROM every
  UNION ALL
  SELECT c, i + 1, {add("s0", DELETE, "D")}, {least(add("s1", DELETE, "D"), keep("s0", "s"))},
    {least(add("c2", DELETE, "D"), stay("c0", "R", f"{REROLE} + extra"), keep("c0", "u"))}, {least(add("c3", DELETE, "D"), stay("c2", "R", f"{REROLE} + extra"), keep("c2", "a"))}
  FROM (
    SELECT *, {least("s0", "s1", "c3")} AS c0 FROM (
      SELECT dp.*, f.ini, f.fault IN ('blank', 'duplicate') AS gone, CASE WHEN f.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra,
        {least("s2", *[add(s, INSERT, "I") for s in ("s0", "s1", "s3")])} AS c2, {least("s3", add("s2", INSERT, "I"), *[add(s, 2 * INSERT, "II") for s in ("s0", "s1")])} AS c3
      FROM dp JOIN f ON f.c IS NOT DISTINCT FROM dp.c AND f.n = dp.i + 1))
), best AS (
  SELECT c, {least("s0", "s3", add("s2", INSERT, "I"), *[add(s, 2 * INSERT, "II") for s in ("s0", "s1")])} AS b FROM dp
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.c IS NOT DISTINCT FROM dp.c AND f.n = dp.i + 1)
), letters AS (
  SELECT c, pos, letter, COUNT(*) FILTER (letter <> 'I') OVER w AS n, COUNT(*) FILTER (letter <> 'D') OVER w AS m
  FROM (SELECT c, unnest(range(1, length(b.a) + 1)) AS pos, b.a[pos] AS letter FROM best) WINDOW w AS (PARTITION BY c ORDER BY pos)
), outs AS (
  SELECT l.c, m, letter, CASE WHEN letter = 'I' THEN '' ELSE x END AS x, r, MAX(CASE WHEN m = 1 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.c) AS sys
  FROM letters l LEFT JOIN f ON f.c IS NOT DISTINCT FROM l.c AND f.n = l.n WHERE letter <> 'D'
), texts AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN r WHEN (m - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || x, chr(10) ORDER BY m) AS s FROM outs GROUP BY c
)
SELECT best.c AS conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
  b.cost AS cost, b.a AS audit, sha256(COALESCE(s, '')) AS repaired_sha256
FROM best LEFT JOIN facts ON facts.c IS NOT DISTINCT FROM best.c LEFT JOIN texts ON texts.c IS NOT DISTINCT FROM best.c
"""


#: The rows of repair_digest(conversations) in DuckDB.
SQL = _sql()
