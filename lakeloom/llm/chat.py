"""Chat formatting by perspective rotation: a dialogue is rendered once for every participant, who speaks as the assistant there while the
others are named users; masks mark what the assistant says. Column expressions only.

A conversation's turns are numbered in order and cut into parts of PART_TURNS, so that a conversation of any length, or of any number of
turns without a number, is made of rows of bounded size. Numbers come from one sort of all turns by range, of keys and hashes and not of texts:
a turn's place in its sorted partition, less where its conversation starts there, and what earlier partitions hold of it. `base` is
where a part starts in the whole rendering; it follows from the lengths of names and texts, so nothing that is rendered is moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import stored

PART_TURNS = 256

# The markup of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, OWN, OTHER = "system", "assistant", "user name="


def turn_head(role: Column, perspective: Column) -> Column:
    """What stands before a turn's text."""
    who = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == perspective, F.lit(OWN)).otherwise(F.concat(F.lit(OTHER), role))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def _numbered(rows: DataFrame) -> DataFrame:
    """(c, r, id, size, part, k): each turn's part and its place there. rows: c, t, r, x, id."""
    keys = [F.col("c"), F.col("t").isNull(), F.col("t"), F.col("r"), F.md5(F.col("x").cast("binary")), F.col("id")]
    light = rows.select(*[k.alias(f"o{i}") for i, k in enumerate(keys)], F.length("x").cast("long").alias("size"))
    order = [f"o{i}" for i in range(len(keys))]
    # a partition's number stands above bit 33 of the ids given here, a row's place in it below
    placed = stored(light.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("o0").alias("c"), F.col("o3").alias("r"), F.col("o5").alias("id"), "size", F.monotonically_increasing_id().alias("g")), "chat-order")
    placed = placed.withColumn("p", F.shiftright("g", 33))
    starts = placed.groupBy(F.col("c").alias("c2"), F.col("p").alias("p2")).agg(F.count("*").alias("n"), F.min("g").alias("g0"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("c2").orderBy("p2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = F.col("g") - F.col("g0") + F.col("before")
    joined = placed.join(starts.select("c2", "p2", "g0", before.alias("before")), F.col("c").eqNullSafe(F.col("c2")) & (F.col("p") == F.col("p2")))
    return joined.select("c", "r", "id", "size", F.floor(at / PART_TURNS).cast("long").alias("part"), (at % PART_TURNS).cast("int").alias("k"))


def _places(turns: DataFrame) -> DataFrame:
    """(c2, part2, who, n_turns, n_chars, base) of each part and participant, from numbers alone."""
    frame = len(OPEN) + 1 + len(CLOSE)
    name = F.when(F.col("r") == SYSTEM, F.lit(len(SYSTEM))).otherwise(F.length("r") + len(OTHER))
    roles = turns.groupBy("c", "part", "r").agg(F.count("*").alias("m"), F.sum("size").alias("chars"))
    parts = roles.groupBy("c", "part").agg(F.sum("m").alias("n_turns"), F.sum(F.col("chars") + F.col("m") * (name + frame)).alias("chars"))
    spoken = roles.where(F.col("r") != SYSTEM)
    people = spoken.select(F.col("c").alias("c2"), F.col("r").alias("who")).distinct()
    own = spoken.select(F.col("c").alias("c3"), F.col("part").alias("part3"), F.col("r").alias("who3"), "m")
    rows = parts.join(people, F.col("c").eqNullSafe(F.col("c2"))).join(own, F.col("c").eqNullSafe(F.col("c3")) & (F.col("part") == F.col("part3")) & (F.col("who") == F.col("who3")), "left")
    chars = F.col("chars") - F.coalesce("m", F.lit(0)) * (F.length("who") + len(OTHER) - len(OWN))
    before = F.coalesce(F.sum("n_chars").over(W.partitionBy("c2", "who").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("c2", F.col("part").alias("part2"), "part", "who", "n_turns", chars.alias("n_chars")).withColumn("base", before).drop("part")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, perspective, part, n_turns, n_chars, base, rendered, mask) for each conversation, participant and part.

    mask: start:end of the perspective's own texts with their closing mark, joined by commas; code points within `rendered`, from 0, end
    exclusive. The system is no participant; a conversation of system turns alone has no row. A null role is `unknown`, a null
    text empty, null turns stand last in the conversation, ties go by role and then by a hash of the text, repeated rows are turns of their
    own. Null conversations form one. A conversation's participants are few next to its turns; they meet its parts as numbers.
    """
    src = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    rows = stored(src.withColumn("id", F.monotonically_increasing_id()), "chat-turns")
    numbered = stored(_numbered(rows), "chat-numbers")
    texts = rows.select("id", "x").join(numbered.select("c", "part", "k", "r", F.col("id").alias("id2")), F.col("id") == F.col("id2"))
    parts = texts.groupBy("c", "part").agg(F.array_sort(F.collect_list(F.struct("k", "r", "x"))).alias("turns"))
    both = parts.join(_places(numbered).hint("merge"), F.col("c").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("part2")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("bits"), F.array().cast("array<string>").alias("mask"))

    def step(acc: Column, s: Column) -> Column:
        head, tail = turn_head(s["r"], F.col("who")), F.concat(s["x"], F.lit(CLOSE))
        start = acc["at"] + F.length(head)
        end = start + F.length(tail)
        mask = F.when(s["r"] == F.col("who"), F.concat(acc["mask"], F.array(F.concat_ws(":", start.cast("string"), end.cast("string"))))).otherwise(acc["mask"])
        return F.struct(end.alias("at"), F.concat(acc["bits"], F.array(head, tail)).alias("bits"), mask.alias("mask"))

    done = both.select("c", "who", "part", "n_turns", "n_chars", "base", F.aggregate("turns", zero, step).alias("a"))
    return done.select(F.col("c").alias(conv_col), F.col("who").alias("perspective"), "part", "n_turns", "n_chars", "base", F.array_join("a.bits", "").alias("rendered"), F.array_join("a.mask", ",").alias("mask"))


#: The same rows in DuckDB, over a view `conversations`.
SQL = f"""
WITH t AS (
  SELECT conv_id, r, x, CAST(n // {PART_TURNS} AS BIGINT) AS part, n FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, r, md5(x)) - 1 AS n
    FROM (SELECT conv_id, turn, COALESCE(role, 'unknown') AS r, COALESCE(text, '') AS x FROM conversations))
), people AS (SELECT DISTINCT conv_id, r AS who FROM t WHERE r <> '{SYSTEM}'),
h AS (
  SELECT t.conv_id, who, part, n, r, x,
    '{OPEN}' || CASE WHEN r = '{SYSTEM}' THEN '{SYSTEM}' WHEN r = who THEN '{OWN}' ELSE '{OTHER}' || r END || chr(10) AS head,
    x || '<|im_end|>' || chr(10) AS tail
  FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, SUM(length(head) + length(tail)) OVER (PARTITION BY conv_id, who, part ORDER BY n ROWS UNBOUNDED PRECEDING) AS stop FROM h
), g AS (
  SELECT conv_id, who AS perspective, part, COUNT(*) AS n_turns, CAST(MAX(stop) AS BIGINT) AS n_chars, string_agg(head || tail, '' ORDER BY n) AS rendered,
    COALESCE(string_agg(CASE WHEN r = who THEN CAST(stop - length(tail) AS BIGINT) || ':' || CAST(stop AS BIGINT) END, ',' ORDER BY n), '') AS mask
  FROM o GROUP BY conv_id, who, part
)
SELECT conv_id, perspective, part, n_turns, n_chars,
  CAST(COALESCE(SUM(n_chars) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, rendered, mask
FROM g
"""
