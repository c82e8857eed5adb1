"""Mix sources to target weights: capped water-filling, then whole and fractional seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import WORD, stored, unit_hash
from lakeloom.operators.windows import running_sum


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, max_epochs: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Targets of sources. sizes: (source, source_size), one row per source; the result adds target (double).

    Sources in code point order, null last, weigh `weights` in turn and share the total of all sizes. A target never exceeds
    max_epochs times its source; excess goes to the others by weight until none is above. The fixed point of that resharing
    has one water level L: target = min(cap, L * weight). With sources in order of cap / weight, L is the level at the first
    source that stays below its cap, so a running sum finds it; of sources that are alike in that the first one counts. A row per source goes
    through sums that are dealt by range, never documents.
    """
    by_name = F.struct(F.col("source").isNull().alias("last"), "source")
    rows = running_sum(sizes.withColumn("__o", by_name).withColumn("__one", F.lit(1)), [], "__o", {"__k": "__one"})
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__k") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("__o", F.struct((F.col("cap") / F.col("w")).alias("fill"), "__o"))
    rows = stored(running_sum(rows, [], "__o", {"caps": "cap", "ws": "w"}), "mix-sources")
    every = rows.agg(F.sum(F.col("source_size").cast("double")).alias("all"), F.sum("w").alias("all_w"))
    rows = rows.crossJoin(F.broadcast(every)).withColumn("level", (F.col("all") - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - (F.col("ws") - F.col("w"))))
    water = rows.where(F.col("cap") >= F.col("w") * F.col("level")).agg(F.min(F.struct(F.col("cap") / F.col("w"), -F.col("level")))["col2"].alias("down"))
    return rows.crossJoin(F.broadcast(water)).select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.coalesce(-F.col("down"), F.lit(0.0))).alias("target"))


def _plan(classes: DataFrame) -> DataFrame:
    """How many documents of each size class get one more repetition.

    classes: (source, cls, n, words, part). From the largest class down, each takes what brings the words taken so far nearest
    to part times the words seen so far, so an error of a large class is made good by the smaller ones. The array folded here
    holds size classes of one source: at most eight for each bit of a size.
    """
    steps = F.array_sort(
        F.collect_list(F.struct("cls", "n", "words", "part")),
        lambda a, b: F.when(a["cls"] > b["cls"], F.lit(-1)).when(a["cls"] < b["cls"], F.lit(1)).otherwise(F.lit(0)),
    )
    zero = F.struct(F.lit(0.0).alias("seen"), F.lit(0.0).alias("got"), F.array().cast("array<struct<cls:bigint,m:bigint>>").alias("out"))

    def fold(acc, x):
        seen, mean = acc["seen"] + x["words"], x["words"] / x["n"]
        m = F.least(F.greatest(F.round((seen * x["part"] - acc["got"]) / mean).cast("long"), F.lit(0).cast("long")), x["n"])
        return F.struct(seen.alias("seen"), (acc["got"] + m * mean).alias("got"), F.concat(acc["out"], F.array(F.struct(x["cls"].alias("cls"), m.alias("m")))).alias("out"))

    return classes.groupBy("source").agg(F.aggregate(steps, zero, fold)["out"].alias("out")).select("source", F.explode("out").alias("o")).select("source", "o.cls", "o.m")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 17, group_rows: int = 1_000) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of docs.

    Every document is taken whole floor(target / source_size) times; the rest of the target is met by documents taken once more:
    within size classes, those with the smallest seeded hash of id and text. Ranks are counted in parts of about group_rows rows, so that a
    source with a third of all rows is never ordered in one task. Null texts have size 0, null sources form one source, an empty table an
    empty result; rows equal in id, source and size are alike, so which of them is taken does not show. Reruns agree.
    """
    key = unit_hash(seed, F.col(id_col), F.md5(F.col(text_col).cast("binary")))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("h")), "mix")
    targets = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs, weights)
    bits = F.length(F.bin(F.col("size")))
    cls = (bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")).cast("long")
    rows = rows.withColumn("cls", cls)
    counts = rows.groupBy("source", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    classes = counts.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select("c.source", "cls", "n", "words", "source_size", "target", F.least(F.floor(rate), F.lit(int(max_epochs))).cast("long").alias("whole"), (rate - F.floor(rate)).alias("part"))
    classes = stored(classes.withColumn("parts", F.ceil(F.col("n") / F.lit(group_rows)).cast("long")), "mix-classes")
    plan = classes.alias("c").join(_plan(classes.where(F.col("words") > 0)).alias("p"), F.expr("c.source <=> p.source and c.cls = p.cls"), "left").select("c.*", F.coalesce("m", F.lit(0).cast("long")).alias("m"))

    # the parts of a class, in hash order; each learns how many of its own rows are to be taken
    placed = rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source and r.cls = p.cls")).select("id", "r.source", "size", "r.cls", "h", "source_size", "target", "whole", "m", F.floor(F.col("h") * F.col("parts") / F.lit(2.0**32)).cast("long").alias("bucket"))
    buckets = placed.groupBy("source", "cls", "bucket").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("source", "cls").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("skip", before)
    rank = F.row_number().over(W.partitionBy("source", "cls", "bucket").orderBy("h", F.col("id").asc_nulls_last(), "size"))
    ranked = placed.withColumn("rank", rank)
    out = ranked.alias("a").join(buckets.alias("b"), F.expr("a.source <=> b.source and a.cls = b.cls and a.bucket = b.bucket"))
    copies = F.col("whole") + F.when(F.col("skip") + F.col("rank") <= F.col("m"), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), F.col("a.source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: The rows of mix(documents) in DuckDB; without parts, since one task ranks all.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || COALESCE(CAST(doc_id AS VARCHAR), '\N') || ':' || COALESCE(md5(text), '\N')), 1, 8) AS UBIGINT) AS h FROM documents
), c AS (SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS cls FROM d),
src AS (SELECT source, CAST(SUM(size) AS BIGINT) AS ss FROM d GROUP BY source),
wt AS (SELECT source, ss, ss * 3e0 AS cap, CAST((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM src),
lv AS (
  SELECT *, (SUM(CAST(ss AS DOUBLE)) OVER () - COALESCE(SUM(cap) OVER o, 0e0)) / (SUM(w) OVER () - COALESCE(SUM(w) OVER o, 0e0)) AS level
  FROM wt WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), wl AS (SELECT level AS l FROM lv WHERE cap >= w * level ORDER BY cap / w, level DESC LIMIT 1),
tg AS (SELECT source, ss, least(cap, w * COALESCE((SELECT l FROM wl), 0e0)) AS target FROM wt),
rt AS (SELECT *, CASE WHEN ss > 0 THEN target / ss ELSE 0e0 END AS rate FROM tg),
cl AS (
  SELECT k.source, cls, n, words, rate - floor(rate) AS part, ROW_NUMBER() OVER (PARTITION BY k.source ORDER BY cls DESC) AS i
  FROM (SELECT source, cls, COUNT(*) AS n, CAST(SUM(size) AS DOUBLE) AS words FROM c GROUP BY source, cls) k JOIN rt ON rt.source IS NOT DISTINCT FROM k.source WHERE words > 0
), pl AS (
  SELECT source, cls, i, words AS seen, m, m * (words / n) AS got FROM (SELECT *, least(greatest(CAST(round((words * part) / (words / n)) AS BIGINT), 0), n) AS m FROM cl WHERE i = 1)
  UNION ALL
  SELECT source, cls, i, seen, m, got + m * (words / n) FROM (
    SELECT x.source, x.cls, x.i, pl.seen + x.words AS seen, pl.got, x.words, x.n, least(greatest(CAST(round(((pl.seen + x.words) * x.part - pl.got) / (x.words / x.n)) AS BIGINT), 0), x.n) AS m
    FROM pl JOIN cl x ON x.source IS NOT DISTINCT FROM pl.source AND x.i = pl.i + 1)
), rk AS (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY source, cls ORDER BY h, doc_id NULLS LAST, size) AS k FROM c)
SELECT doc_id, size, ss AS source_size, target, CAST((least(floor(rate), 3) + CASE WHEN k <= COALESCE(m, 0) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rk JOIN rt ON rt.source IS NOT DISTINCT FROM rk.source LEFT JOIN pl ON pl.source IS NOT DISTINCT FROM rk.source AND pl.cls = rk.cls
"""
