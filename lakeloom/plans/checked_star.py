"""Checked queries over the star schema, events, embeddings and labels, each with its DuckDB statement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions import exprs as X
from lakeloom.functions import metrics, strings
from lakeloom.operators import joins, similarity, upsert, windows
from lakeloom.plans import steps
from lakeloom.plans.checked_box import div, rnd
from lakeloom.sources.bucketed import BucketTable
from lakeloom.sources.tables import shared_dir


def _t(spark: SparkSession, d: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{table}.parquet")
    return df.select(*cols) if cols else df


# ---- vectors


def q14_similar(spark: SparkSession, d: str) -> DataFrame:
    """Q14: the ten vectors nearest to vector 7."""
    e = _t(spark, d, "embeddings", "vec_id", "embedding")
    r = similarity.nearest(e, e.where("vec_id = 7"), "vec_id", "embedding", 10)
    return r.select("vec_id", X.round_n("distance", 6).alias("distance"), X.round_n("similarity", 6).alias("similarity"))


_DIST = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
SQL_Q14 = f"SELECT vec_id, {rnd('dist', 6)} AS distance, {rnd('(1e0 / (1e0 + dist))', 6)} AS similarity FROM (SELECT a.vec_id, {_DIST} AS dist FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 7) b WHERE a.vec_id <> 7) ORDER BY dist, vec_id LIMIT 10"


def _members(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e.select("vec_id", "label", X.round_n(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("score"))


_MEM = f"mem AS (SELECT vec_id, label, {rnd('list_sum(CAST(embedding AS DOUBLE[]))', 4)} AS score FROM embeddings)"


def q15_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Q15: the three best of each class after one row a member."""
    m = _members(spark, d)
    once = m.unionByName(m).groupBy("vec_id", "label").agg(F.max("score").alias("score"))
    return windows.top_n(once, ["label"], [X.ordered("score", True), "vec_id"], 3)


SQL_Q15 = f"WITH {_MEM} SELECT * FROM mem QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, vec_id) <= 3"


def q16_summary(spark: SparkSession, d: str) -> DataFrame:
    """Q16: size and mean of each class, a missing class last."""
    m = _members(spark, d).withColumn("label", F.when(F.col("label") != 3, F.col("label")))
    return similarity.class_summary(m, "label", "score").withColumn("mean", X.round_n("mean", 4))


SQL_Q16 = f"WITH {_MEM} SELECT CASE WHEN label <> 3 THEN label END AS label, COUNT(*) AS n, {rnd('AVG(score)', 4)} AS mean FROM mem GROUP BY 1"


def _weights(spark: SparkSession, d: str) -> DataFrame:
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders", "o_custkey", "o_totalprice")
    w = o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice")).alias("w"))
    j = c.join(w, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("primary"), F.when(F.col("c_custkey") % 3 == 0, F.lit("HYBRID")).alias("secondary"), F.coalesce("w", F.lit(0.0)).alias("w"))


def q17_shares(spark: SparkSession, d: str) -> DataFrame:
    """Q17: share of each class by nation and overall, primary whole and secondary half, with the index."""
    s = similarity.class_shares(_weights(spark, d), "team", "primary", "secondary", "w", "member")
    return s.select("team", "class", "members", *[X.round_n(c, 6).alias(c) for c in ("group_weight", "group_share", "total_share", "index")])


_SHARES = f"""wt AS (SELECT c_nationkey AS team, c_custkey AS member, c_mktsegment AS p, CASE WHEN c_custkey % 3 = 0 THEN 'HYBRID' END AS s, COALESCE(w, 0e0) AS w FROM customer LEFT JOIN (SELECT o_custkey, ROUND(SUM(o_totalprice)) AS w FROM orders GROUP BY 1) ON o_custkey = c_custkey),
u AS (SELECT team, member, p AS class, w FROM wt UNION ALL SELECT team, member, s, w * 0.5e0 FROM wt WHERE s IS NOT NULL),
tot AS (SELECT class, SUM(w) AS tw FROM u GROUP BY 1), per AS (SELECT team, class, COUNT(DISTINCT member) AS members, SUM(w) AS gw FROM u GROUP BY 1, 2),
j AS (SELECT t.team, tot.class, COALESCE(members, 0) AS members, COALESCE(gw, 0e0) AS group_weight, tw FROM (SELECT DISTINCT team FROM per) t CROSS JOIN tot LEFT JOIN per ON per.team = t.team AND per.class = tot.class),
sh AS (SELECT *, COALESCE({div('group_weight', 'SUM(group_weight) OVER (PARTITION BY team)')}, 0e0) AS gs, COALESCE({div('tw', 'SUM(tw) OVER (PARTITION BY team)')}, 0e0) AS tsh FROM j)"""
SQL_Q17 = f"WITH {_SHARES} SELECT team, class, members, {rnd('group_weight', 6)} AS group_weight, {rnd('gs', 6)} AS group_share, {rnd('tsh', 6)} AS total_share, {rnd('(gs / NULLIF(tsh, 0e0))', 6)} AS index FROM sh"


def t2_identity(spark: SparkSession, d: str) -> DataFrame:
    """What a nation is known for (index 1.02, share 5 %; three strongest) and what it lacks (share 5 % overall, index 0.98; three weakest)."""
    s = similarity.class_shares(_weights(spark, d), "team", "primary", "secondary", "w", "member").withColumn("i", X.round_n("index", 9))
    known = windows.top_n(s.where("i >= 1.02 AND group_share >= 0.05"), ["team"], [X.ordered("i", True), "class"], 3).withColumn("kind", F.lit("identity"))
    gaps = windows.top_n(s.where("total_share >= 0.05 AND i <= 0.98"), ["team"], [X.ordered("i"), "class"], 3).withColumn("kind", F.lit("gap"))
    return known.unionByName(gaps).select("team", "kind", "class", X.round_n("index", 6).alias("index"))


SQL_T2 = f"WITH {_SHARES}, x AS (SELECT *, gs / NULLIF(tsh, 0e0) AS ix, {rnd('(gs / NULLIF(tsh, 0e0))', 9)} AS i FROM sh) SELECT team, 'identity' AS kind, class, {rnd('ix', 6)} AS index FROM (SELECT * FROM x WHERE i >= 1.02 AND gs >= 0.05 QUALIFY ROW_NUMBER() OVER (PARTITION BY team ORDER BY i DESC, class) <= 3) UNION ALL SELECT team, 'gap', class, {rnd('ix', 6)} FROM (SELECT * FROM x WHERE tsh >= 0.05 AND i <= 0.98 QUALIFY ROW_NUMBER() OVER (PARTITION BY team ORDER BY i, class) <= 3)"


def k5_archetypes(spark: SparkSession, d: str) -> DataFrame:
    """K5 and K6: clusters of whole standardised vectors with named classes and soft membership (no oracle: invariants are tested)."""
    e = _t(spark, d, "embeddings")
    n = e.select(F.max(F.size("embedding"))).first()[0] or 0
    dims = [f"v{i}" for i in range(n)]
    flat = similarity.standardize(e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(dims)]), dims)
    signatures = {f"class{i}": [1.0 if j % 12 == i else -1.0 / 11 for j in range(n)] for i in range(12)}
    r = similarity.archetypes(flat.select("vec_id", F.array(*dims).alias("v")), "vec_id", "v", signatures)
    return r.drop("affinity")


# ---- names, payloads, as-of


def d11_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Parts against parts of the same normalised name, brands that hold each other first."""
    p = _t(spark, d, "part", "p_partkey", "p_name", "p_brand")
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a_id"), F.concat(F.initcap("p_name"), F.lit(" Jr.")).alias("a_name"), F.col("p_brand").alias("a_team"))
    b = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b_id"), F.upper("p_name").alias("b_name"), F.substring("p_brand", 1, 7).alias("b_team"))
    return joins.fuzzy_match(a, b, "a_id", "a_name", "a_team", "b_id", "b_name", "b_team")


SQL_D11 = """WITH n AS (SELECT p_partkey, trim(regexp_replace(replace(replace(replace(lower(p_name), '.', ''), '''', ''), '’', ''), '\\s+', ' ', 'g')) AS nm, p_brand FROM part),
a AS (SELECT p_partkey AS a_id, nm AS k, lower(p_brand) AS t FROM n WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS b_id, regexp_replace(nm, ' (jr|sr|ii|iii|iv|v)$', '') AS k, lower(substring(p_brand, 1, 7)) AS t FROM n WHERE p_partkey % 2 = 1)
SELECT a_id, b_id, m AS team_match FROM (SELECT a_id, b_id, contains(a.t, b.t) OR contains(b.t, a.t) AS m FROM a JOIN b USING (k)) QUALIFY ROW_NUMBER() OVER (PARTITION BY a_id ORDER BY m DESC, b_id) = 1"""


def d13_asof(spark: SparkSession, d: str) -> DataFrame:
    """For each event the user's last purchase value at or before it."""
    e = _t(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_value"))
    out = joins.asof_join(e.where("event_type <> 'purchase'"), buys, ["user_id"], "ts", "at", ["last_value"])
    return out.select("event_id", "user_id", "last_value")


SQL_D13 = "SELECT e.event_id, e.user_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND e.ts >= b.ts"


def a6_payload(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in JSON properties, with a fallback key and coercion."""
    e = _t(spark, d, "events", "event_id", "props")
    return e.select("event_id", strings.json_number("props", "none", "k").alias("k"), strings.json_number(F.concat(F.lit('{"k": "'), (F.col("event_id") % 7).cast("string"), F.lit('.9"}')), "k", kind="int").alias("cut"))


SQL_A6 = "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(event_id % 7 AS INTEGER) AS cut FROM events"


def f1_events(spark: SparkSession, d: str) -> DataFrame:
    """mean and sum of a user's five events before each."""
    w = windows.prior(["user_id"], ["ts", "event_id"], 5)
    return _t(spark, d, "events").select("event_id", X.round_n(F.avg("value").over(w), 6).alias("mean5"), F.count("value").over(w).alias("n5"))


SQL_F1 = f"SELECT event_id, {rnd('AVG(value) OVER w', 6)} AS mean5, COUNT(value) OVER w AS n5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


def f7_dense(spark: SparkSession, d: str) -> DataFrame:
    """Dense rank of account balances and share of the nation's total, in whole numbers."""
    c = _t(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").withColumn("b", F.floor("c_acctbal").cast("long"))
    return c.select("c_custkey", windows.rank_of("b", ["c_nationkey"], True, True).alias("dense"), X.round_n(windows.share_of_total("b", ["c_nationkey"]), 6).alias("share"))


SQL_F7 = f"SELECT c_custkey, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY b DESC NULLS LAST) AS dense, {rnd(div('b', 'SUM(b) OVER (PARTITION BY c_nationkey)'), 6)} AS share FROM (SELECT *, CAST(floor(c_acctbal) AS BIGINT) AS b FROM customer)"


def e10_modal(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent market segment of each nation."""
    return steps.modal(_t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


SQL_E10 = "SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2) QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1"


def e1_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Counts, filtered counts, distinct counts, deviation, ratio of sums, conditional and weighted means, HAVING, global scalars."""
    li = _t(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag").withColumn("disc", X.zero_to_null("l_discount"))
    g = li.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("returned"), F.count_distinct("l_partkey").alias("parts"), X.round_n(F.stddev_samp("l_quantity"), 6).alias("sd"),
        X.round_n(X.wavg_all("disc", "l_quantity"), 6).alias("wavg_all"), X.round_n(X.wavg_nonnull("disc", "l_quantity"), 6).alias("wavg_nonnull"), X.round_n(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), 6).alias("mean_r"),
    ).where("n > 1")
    total = li.agg(X.round_n(F.avg("l_quantity"), 6).alias("mean_all"))
    return joins.with_scalars(g, total)


SQL_E1 = f"SELECT l_suppkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS returned, COUNT(DISTINCT l_partkey) AS parts, {rnd('stddev_samp(l_quantity)', 6)} AS sd, {rnd(div('SUM(disc * l_quantity)', 'SUM(l_quantity)'), 6)} AS wavg_all, {rnd(div('SUM(disc * l_quantity)', 'SUM(CASE WHEN disc IS NOT NULL THEN l_quantity END)'), 6)} AS wavg_nonnull, {rnd('''AVG(CASE WHEN l_returnflag = 'R' THEN l_quantity END)''', 6)} AS mean_r, (SELECT {rnd('AVG(l_quantity)', 6)} FROM lineitem) AS mean_all FROM (SELECT *, NULLIF(l_discount, 0) AS disc FROM lineitem) GROUP BY l_suppkey HAVING COUNT(*) > 1"


# ---- metrics


def _pred(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.select("o_orderkey", "o_orderstatus", "o_orderdate", (cents % 4001 - 2000).cast("double").alias("actual"), ((cents * 7 + F.col("o_custkey") * 31) % 4001 - 2000).cast("double").alias("guess"), (cents % 2).alias("y"), ((cents * 13 + F.col("o_orderkey")) % 1000 / 1000.0).alias("p"))


_PRED = "pr AS (SELECT o_orderkey, o_orderstatus, o_orderdate, CAST(c % 4001 - 2000 AS DOUBLE) AS actual, CAST((c * 7 + o_custkey * 31) % 4001 - 2000 AS DOUBLE) AS guess, c % 2 AS y, ((c * 13 + o_orderkey) % 1000) / 1e3 AS p FROM (SELECT *, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS c FROM orders))"
_ERR = f"COUNT(*) AS n, {rnd('AVG(abs(actual - guess))', 6)} AS mae, {rnd('sqrt(AVG((actual - guess) * (actual - guess)))', 6)} AS rmse, {rnd('(1 - SUM((actual - guess) * (actual - guess)) / (SUM(actual * actual) - SUM(actual) * SUM(actual) / COUNT(actual)))', 6)} AS r2, {rnd('AVG(CASE WHEN (actual > 0) = (guess > 0) THEN 1e0 ELSE 0e0 END)', 6)} AS sign_accuracy, " + ", ".join(f"{rnd(f'quantile_cont(abs(actual - guess), {q})', 6)} AS {n}" for q, n in ((0.5, "median_error"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95")))


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[X.round_n(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors and their exact quantiles."""
    return _rounded(metrics.errors(_pred(spark, d), "actual", "guess"))


SQL_P1 = f"WITH {_PRED} SELECT {_ERR} FROM pr"


def p4_auc(spark: SparkSession, d: str) -> DataFrame:
    """Log loss and exact AUC by order status."""
    df = _pred(spark, d)
    one = df.groupBy("o_orderstatus").agg(*metrics.classification_summary("y", "p"))
    return _rounded(one.join(metrics.auc(df, "y", "p", ["o_orderstatus"]), "o_orderstatus"))


SQL_P4 = f"""WITH {_PRED}, rk AS (SELECT *, RANK() OVER (PARTITION BY o_orderstatus ORDER BY p) + (COUNT(*) OVER (PARTITION BY o_orderstatus, p) - 1) / 2e0 AS r FROM pr)
SELECT o_orderstatus, COUNT(*) AS n, {rnd('AVG(CASE WHEN (p >= 0.5e0) = (y > 0) THEN 1e0 ELSE 0e0 END)', 6)} AS accuracy, {rnd('(-AVG(y * ln(greatest(p, 1e-15)) + (1 - y) * ln(1 - greatest(p, 1e-15))))', 6)} AS log_loss,
{rnd(div('(SUM(CASE WHEN y > 0 THEN r END) - SUM(y) * (SUM(y) + 1) / 2e0)', '(SUM(y) * (COUNT(*) - SUM(y)))'), 6)} AS auc FROM rk GROUP BY o_orderstatus"""


def e14_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Ten equal bins of predicted probability, with the expected calibration error."""
    bins = metrics.calibration(_pred(spark, d), "y", "p")
    return _rounded(joins.with_scalars(bins, metrics.expected_calibration_error(bins)))


SQL_E14 = f"WITH {_PRED}, b AS (SELECT CAST(greatest(ceil((p - lo) / (hi - lo) * 10) - 1, 0) AS BIGINT) AS bin, y, p FROM pr, (SELECT MIN(p) AS lo, MAX(p) AS hi FROM pr)), g AS (SELECT bin, COUNT(*) AS n, AVG(p) AS mp, AVG(CAST(y AS DOUBLE)) AS ob, abs(AVG(p) - AVG(CAST(y AS DOUBLE))) AS er FROM b GROUP BY bin) SELECT bin, n, {rnd('mp', 6)} AS mean_predicted, {rnd('ob', 6)} AS observed, {rnd('er', 6)} AS abs_error, (SELECT {rnd('(SUM(er * n) / SUM(n))', 6)} FROM g) AS ece FROM g"


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """P6 and C-11: errors by overlapping segments in one pass."""
    df = _pred(spark, d)
    parts = {"final": F.col("o_orderstatus") == "F", "open": F.col("o_orderstatus") == "O", "close": F.abs("guess").between(0, 500), "far": F.abs("guess") > 1500, "late": F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")}
    return _rounded(metrics.segments(df, parts, [F.avg(F.abs(F.col("actual") - F.col("guess"))).alias("mae"), F.avg("y").alias("rate")]))


SQL_P6 = f"WITH {_PRED}, s AS (SELECT 'final' AS segment, * FROM pr WHERE o_orderstatus = 'F' UNION ALL SELECT 'open', * FROM pr WHERE o_orderstatus = 'O' UNION ALL SELECT 'close', * FROM pr WHERE abs(guess) BETWEEN 0 AND 500 UNION ALL SELECT 'far', * FROM pr WHERE abs(guess) > 1500 UNION ALL SELECT 'late', * FROM pr WHERE o_orderdate >= TIMESTAMP '1998-01-01') SELECT segment, COUNT(*) AS rows, {rnd('AVG(abs(actual - guess))', 6)} AS mae, {rnd('AVG(CAST(y AS DOUBLE))', 6)} AS rate FROM s GROUP BY segment HAVING COUNT(*) >= 20"


def p7_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Two models on the games both predict: accuracies, errors, and how often they disagree."""
    a = _pred(spark, d)
    b = a.where("o_orderkey % 5 <> 0").select("o_orderkey", (-F.col("guess")).alias("guess2"), (1 - F.col("p")).alias("p2"))
    j = a.join(b, "o_orderkey")
    right = lambda p: F.avg(F.when((F.col(p) >= 0.5) == (F.col("y") > 0), 1.0).otherwise(0.0))
    differ = (F.col("p") >= 0.5) != (F.col("p2") >= 0.5)
    return _rounded(j.agg(F.count("*").alias("n"), right("p").alias("acc"), right("p2").alias("acc2"), F.avg(F.abs(F.col("actual") - F.col("guess2"))).alias("mae2"), F.avg(F.when(differ, 1.0).otherwise(0.0)).alias("disagree"), F.avg(F.when(differ, F.when((F.col("p") >= 0.5) == (F.col("y") > 0), 1.0).otherwise(0.0))).alias("acc_where_disagree")))


SQL_P7 = f"WITH {_PRED}, j AS (SELECT *, -guess AS guess2, 1 - p AS p2 FROM pr WHERE o_orderkey % 5 <> 0) SELECT COUNT(*) AS n, {rnd('AVG(CASE WHEN (p >= 0.5e0) = (y > 0) THEN 1e0 ELSE 0e0 END)', 6)} AS acc, {rnd('AVG(CASE WHEN (p2 >= 0.5e0) = (y > 0) THEN 1e0 ELSE 0e0 END)', 6)} AS acc2, {rnd('AVG(abs(actual - guess2))', 6)} AS mae2, {rnd('AVG(CASE WHEN (p >= 0.5e0) <> (p2 >= 0.5e0) THEN 1e0 ELSE 0e0 END)', 6)} AS disagree, {rnd('AVG(CASE WHEN (p >= 0.5e0) <> (p2 >= 0.5e0) THEN CASE WHEN (p >= 0.5e0) = (y > 0) THEN 1e0 ELSE 0e0 END END)', 6)} AS acc_where_disagree FROM j"


def p8_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two runs metric by metric."""
    s = _pred(spark, d)
    run = lambda df: df.agg(X.round_n(F.avg(F.abs(F.col("actual") - F.col("guess"))), 6).alias("mae"), X.round_n(F.avg(F.when((F.col("actual") > 0) == (F.col("guess") > 0), 1.0).otherwise(0.0)), 6).alias("accuracy")).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "accuracy")])).alias("x")).select("x.*")
    out = metrics.compare_runs(run(s.where("o_orderkey % 2 = 0")), run(s.where("o_orderkey % 2 = 1")), ["mae"])
    return _rounded(out)


_RUN = lambda k: f"SELECT {rnd('AVG(abs(actual - guess))', 6)} AS mae, {rnd('AVG(CASE WHEN (actual > 0) = (guess > 0) THEN 1e0 ELSE 0e0 END)', 6)} AS accuracy FROM pr WHERE o_orderkey % 2 = {k}"
SQL_P8 = f"WITH {_PRED}, a AS ({_RUN(0)}), b AS ({_RUN(1)}), j AS (SELECT 'mae' AS metric, a.mae AS old, b.mae AS new, a.mae - b.mae AS gain FROM a, b UNION ALL SELECT 'accuracy', a.accuracy, b.accuracy, b.accuracy - a.accuracy FROM a, b) SELECT metric, old, new, {rnd('(new - old)', 6)} AS change, CASE WHEN gain > 1e-12 THEN 'better' WHEN gain < -1e-12 THEN 'worse' ELSE 'same' END AS verdict FROM j"


def p9_parity(spark: SparkSession, d: str) -> DataFrame:
    """Greatest difference by column between two versions of a table, and where it is."""
    a = _pred(spark, d).select("o_orderkey", "actual", "guess", "p")
    b = a.select("o_orderkey", (F.col("actual") + (F.col("o_orderkey") % 97) / 8.0).alias("actual"), F.when(F.col("o_orderkey") % 3 != 0, F.col("guess")).alias("guess"), "p")
    return _rounded(metrics.parity(a, b, "o_orderkey", ["actual", "guess", "p"]))


SQL_P9 = f"WITH {_PRED}, x AS (SELECT 'actual' AS c, o_orderkey, (o_orderkey % 97) / 8e0 AS d FROM pr UNION ALL SELECT 'guess', o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 0e0 END FROM pr UNION ALL SELECT 'p', o_orderkey, 0e0 FROM pr) SELECT c AS \"column\", COUNT(d) AS n, COUNT(*) - COUNT(d) AS skipped, {rnd('MAX(d)', 6)} AS max_diff, MIN(o_orderkey) FILTER (WHERE d = m) AS worst, MAX(d) < 0.01 AS passed FROM (SELECT *, MAX(d) OVER (PARTITION BY c) AS m FROM x) GROUP BY c"


# ---- writes


def _slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    old = c.where("c_custkey % 3 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")))
    new = c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") + 1)).withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey") + 1))
    return old, new


_OLDNEW = "o AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey + 1 END AS c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


def j1_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """New values where they are there, else old ones."""
    return upsert.upsert(*_slices(spark, d), ["c_custkey"])


SQL_J1 = f"WITH {_OLDNEW} SELECT c_custkey, COALESCE(n.c_name, o.c_name) AS c_name, COALESCE(n.c_nationkey, o.c_nationkey) AS c_nationkey, COALESCE(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM o FULL JOIN n USING (c_custkey)"


def j1_buckets(spark: SparkSession, d: str) -> DataFrame:
    """J1 as a merge into a table in buckets, which writes the buckets of the new keys alone."""
    old, new = _slices(spark, d)
    table = BucketTable(spark, f"{shared_dir(spark).rstrip('/')}/lakeloom/{spark.sparkContext.applicationId}/buckets-{uuid.uuid4().hex}", ["c_custkey"])
    table.merge(old)
    table.merge(new)
    return table.read()


def j2_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """One column overwritten even with null, one kept where it is there."""
    return upsert.upsert(*_slices(spark, d), ["c_custkey"], overwrite=["c_acctbal"], keep=["c_nationkey"])


SQL_J2 = f"WITH {_OLDNEW} SELECT COALESCE(n.c_custkey, o.c_custkey) AS c_custkey, COALESCE(n.c_name, o.c_name) AS c_name, COALESCE(o.c_nationkey, n.c_nationkey) AS c_nationkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey"


def j4_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key is there are left alone."""
    return upsert.insert_ignore(*_slices(spark, d), ["c_custkey"])


SQL_J4 = f"WITH {_OLDNEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)"


def j5_replace(spark: SparkSession, d: str) -> DataFrame:
    """Slices of nations in the new table take the place of the old ones."""
    old, new = _slices(spark, d)
    return upsert.replace_slice(old, new.where("c_nationkey < 5"), "c_nationkey")


SQL_J5 = f"WITH {_OLDNEW} SELECT * FROM o WHERE c_nationkey NOT IN (SELECT c_nationkey FROM n WHERE c_nationkey < 5) UNION ALL SELECT * FROM n WHERE c_nationkey < 5"


def j6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Only nulls are filled."""
    old, new = _slices(spark, d)
    return upsert.fill_nulls(old, new, ["c_custkey"], ["c_name", "c_acctbal"])


SQL_J6 = f"WITH {_OLDNEW} SELECT o.c_custkey, COALESCE(o.c_name, n.c_name) AS c_name, o.c_nationkey, COALESCE(o.c_acctbal, n.c_acctbal) AS c_acctbal FROM o LEFT JOIN n ON o.c_custkey = n.c_custkey"


def j8_late(spark: SparkSession, d: str) -> DataFrame:
    """Customers that only orders know are added with a name of their own."""
    dim = _t(spark, d, "customer", "c_custkey", "c_name").where("c_custkey % 10 <> 0")
    return upsert.add_missing_dimension(dim, _t(spark, d, "orders"), {"c_custkey": "o_custkey"}, {"c_name": "unknown"})


SQL_J8 = "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT DISTINCT o_custkey, 'unknown' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)"


def j_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """A batch with several rows a key: by column the last value that is there."""
    e = _t(spark, d, "events", "user_id", "ts", "event_id", "value", "event_type").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return upsert.last_wins(e, ["user_id"], ["ts", "event_id"])


SQL_JL = "SELECT user_id, arg_max(CASE WHEN event_id % 3 <> 0 THEN value END, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


# ---- user-interface analytics and scalars


def t1_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Labels by cut points, expected wins, and seasons that begin in November."""
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    v = F.col("o_totalprice") / 20000.0
    tier = X.ladder(F.when(F.col("o_orderkey") % 11 != 0, v), [(20, "elite"), (15, "star"), (10, "starter"), (5, "rotation"), (0, "bench")], "below")
    return o.select("o_orderkey", tier.alias("tier"), X.round_n(X.pythagorean(F.col("o_custkey") % 40 + 60, F.col("o_orderkey") % 40 + 60), 6).alias("pythag"), X.default_season("o_orderdate").alias("season"))


SQL_T1 = f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN v >= 20 THEN 'elite' WHEN v >= 15 THEN 'star' WHEN v >= 10 THEN 'starter' WHEN v >= 5 THEN 'rotation' WHEN v >= 0 THEN 'bench' ELSE 'below' END AS tier, {rnd('(pow(a, 11.5e0) / (pow(a, 11.5e0) + pow(b, 11.5e0)))', 6)} AS pythag, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 11 THEN 1 ELSE 0 END AS INTEGER) AS season FROM (SELECT *, o_totalprice / 20000e0 AS v, CAST(o_custkey % 40 + 60 AS DOUBLE) AS a, CAST(o_orderkey % 40 + 60 AS DOUBLE) AS b FROM orders)"


def t3_gaps(spark: SparkSession, d: str) -> DataFrame:
    """For each segment the gap between the best two nations' customers, named by size."""
    c = _t(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    r = windows.top_n(c, ["c_mktsegment"], [X.ordered("c_acctbal", True), "c_custkey"], 2).withColumn("k", F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")))
    g = r.groupBy("c_mktsegment").agg(F.max(F.when(F.col("k") == 1, F.col("c_custkey"))).alias("best"), X.round_n(F.max(F.when(F.col("k") == 1, F.col("c_acctbal"))) - F.max(F.when(F.col("k") == 2, F.col("c_acctbal"))), 4).alias("gap"))
    return g.withColumn("size", X.ladder("gap", [(50, "wide"), (5, "clear"), (0.000001, "narrow")], "even"))


SQL_T3 = f"SELECT c_mktsegment, best, gap, CASE WHEN gap IS NULL THEN NULL WHEN gap >= 50 THEN 'wide' WHEN gap >= 5 THEN 'clear' WHEN gap >= 0.000001 THEN 'narrow' ELSE 'even' END AS size FROM (SELECT c_mktsegment, MAX(c_custkey) FILTER (WHERE k = 1) AS best, {rnd('(MAX(c_acctbal) FILTER (WHERE k = 1) - MAX(c_acctbal) FILTER (WHERE k = 2))', 4)} AS gap FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) GROUP BY c_mktsegment)"


def t6_radar(spark: SparkSession, d: str) -> DataFrame:
    """Axes with fallbacks, unpivoted; shares of parts by brand."""
    p = _t(spark, d, "part", "p_partkey", "p_size", "p_retailprice").withColumn("a", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).cast("double"))
    p = p.withColumn("b", F.floor("p_retailprice")).withColumn("size_axis", F.coalesce("a", F.col("b").cast("double"), F.lit(0.0))).withColumn("share", X.round_n(X.ratio("a", F.col("a") + F.col("b")), 6))
    return p.unpivot(["p_partkey"], ["size_axis", "share"], "axis", "value")


SQL_T6 = f"WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS a, floor(p_retailprice) AS b FROM part) SELECT p_partkey, 'size_axis' AS axis, COALESCE(a, b, 0e0) AS value FROM x UNION ALL SELECT p_partkey, 'share', {rnd(div('a', 'a + b'), 6)} FROM x"


def b_scalars(spark: SparkSession, d: str) -> DataFrame:
    """B9 to B15 and text parsing: differences, clipping, guarded ratios, heights, dates and flags."""
    li = _t(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    return li.select(
        "p_partkey", X.diff(F.when(k % 2 == 0, F.col("p_size")), F.when(k % 3 == 0, F.lit(7)), True).cast("double").alias("d"), X.clip(F.when(k % 5 != 0, F.col("p_size")), 10, 40).alias("clipped"), X.round_n(X.ratio("p_size", X.zero_to_null(k % 4)), 6).alias("r"),
        strings.height_strict(F.when(k % 3 == 0, F.lit("six-five")).otherwise(F.concat_ws("-", (k % 3 + 5).cast("string"), (k % 12).cast("string")))).alias("strict"), strings.height_lenient(F.concat((k % 3 + 5).cast("string"), F.lit("'"), (k % 12).cast("string"), F.lit('"'))).alias("lenient"),
        strings.feed_date(F.when(k % 4 == 0, F.lit("0000-00-00")).when(k % 4 == 1, F.lit("20260131")).otherwise(F.lit("2026-02-01"))).alias("day"), strings.flag(F.when(k % 4 == 0, F.lit("Y")).when(k % 4 == 1, F.lit("0")).when(k % 4 == 2, F.lit("2"))).alias("flag"),
    )


SQL_B = f"SELECT p_partkey, CAST(-(COALESCE(CASE WHEN p_partkey % 2 = 0 THEN p_size END, 0) - COALESCE(CASE WHEN p_partkey % 3 = 0 THEN 7 END, 0)) AS DOUBLE) + 0e0 AS d, CASE WHEN p_partkey % 5 <> 0 THEN least(greatest(p_size, 10), 40) END AS clipped, {rnd(div('p_size', 'p_partkey % 4'), 6)} AS r, CAST(CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 3 + 5) * 12 + p_partkey % 12 END AS INTEGER) AS strict, CAST((p_partkey % 3 + 5) * 12 + p_partkey % 12 AS INTEGER) AS lenient, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN DATE '2026-01-31' ELSE DATE '2026-02-01' END AS day, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM part"


def h1_sets(spark: SparkSession, d: str) -> DataFrame:
    """Unions, distinct rows and semi filters."""
    o, c = _t(spark, d, "orders", "o_custkey", "o_orderstatus"), _t(spark, d, "customer", "c_custkey", "c_mktsegment")
    some = joins.keep_where_in(c.withColumnRenamed("c_custkey", "o_custkey"), o.where("o_orderstatus = 'P'"), ["o_custkey"])
    return some.select("c_mktsegment").unionByName(c.select("c_mktsegment")).groupBy("c_mktsegment").agg(F.count("*").alias("n")).unionByName(o.select("o_orderstatus").distinct().select(F.col("o_orderstatus").alias("c_mktsegment"), F.lit(0).cast("long").alias("n")))


SQL_H1 = "SELECT c_mktsegment, COUNT(*) AS n FROM (SELECT c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT c_mktsegment FROM customer) GROUP BY 1 UNION ALL SELECT DISTINCT o_orderstatus, CAST(0 AS BIGINT) FROM orders"


QUERIES = {
    "q14_similar_vectors": (q14_similar, lambda: SQL_Q14),
    "q15_exemplars": (q15_exemplars, lambda: SQL_Q15),
    "q16_class_summary": (q16_summary, lambda: SQL_Q16),
    "q17_share_index": (q17_shares, lambda: SQL_Q17),
    "t1_tiers": (t1_tiers, lambda: SQL_T1),
    "t2_identity_gaps": (t2_identity, lambda: SQL_T2),
    "t3_percentile_gaps": (t3_gaps, lambda: SQL_T3),
    "t6_radar_axes": (t6_radar, lambda: SQL_T6),
    "k5_archetypes": (k5_archetypes, None),
    "d11_fuzzy_match": (d11_fuzzy, lambda: SQL_D11),
    "d13_asof": (d13_asof, lambda: SQL_D13),
    "a6_json_payload": (a6_payload, lambda: SQL_A6),
    "f1_rolling_prior5": (f1_events, lambda: SQL_F1),
    "f7_dense_rank_share": (f7_dense, lambda: SQL_F7),
    "e1_e8_aggregates": (e1_aggregates, lambda: SQL_E1),
    "e10_modal": (e10_modal, lambda: SQL_E10),
    "p1_e12_errors": (p1_errors, lambda: SQL_P1),
    "p4_auc_logloss": (p4_auc, lambda: SQL_P4),
    "p5_e14_calibration": (e14_calibration, lambda: SQL_E14),
    "p6_segments": (p6_segments, lambda: SQL_P6),
    "p7_benchmark": (p7_benchmark, lambda: SQL_P7),
    "p8_compare_runs": (p8_compare, lambda: SQL_P8),
    "p9_parity": (p9_parity, lambda: SQL_P9),
    "j1_upsert_coalesce": (j1_coalesce, lambda: SQL_J1),
    "j1_merge_buckets": (j1_buckets, lambda: SQL_J1),
    "j2_j3_upsert_overwrite": (j2_overwrite, lambda: SQL_J2),
    "j4_insert_ignore": (j4_ignore, lambda: SQL_J4),
    "j5_replace_slice": (j5_replace, lambda: SQL_J5),
    "j6_fill_nulls": (j6_fill, lambda: SQL_J6),
    "j8_late_dim": (j8_late, lambda: SQL_J8),
    "j_last_wins": (j_last_wins, lambda: SQL_JL),
    "b_scalars": (b_scalars, lambda: SQL_B),
    "h1_h4_sets": (h1_sets, lambda: SQL_H1),
}
