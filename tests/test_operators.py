"""Windows, joins, upserts, ratings, vectors and metrics on small frames."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import metrics
from lakeloom.operators import joins, ratings, similarity, sorting, upsert, windows
from lakeloom.plans import models, steps


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_percent_rank_counts_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None), (4, 20.0)], "id int, x double")
    up = {r["id"]: r["r"] for r in df.select("id", windows.percent_rank("x").alias("r")).collect()}
    assert [round(up[i], 3) for i in (1, 2, 3, 4)] == [0, 0.333, 1.0, 0.333]
    both = windows.percent_ranks(df.withColumn("y", F.col("x")), ["id"], ["x", "y"], descending=["y"])
    down = {r["id"]: r["r"] for r in df.select("id", windows.percent_rank("x", descending=True).alias("r")).collect()}
    assert {r["id"]: (r["x_pct"], r["y_pct"]) for r in both.collect()} == {i: (up[i], down[i]) for i in up}


def test_prior_leaves_out_the_current_row(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(8)], "k string, t int, x double")
    got = {r["t"]: r["m"] for r in df.select("t", F.avg("x").over(windows.prior(["k"], ["t"], 5)).alias("m")).collect()}
    assert got[0] is None and got[1] == 0 and got[7] == np.mean([2, 3, 4, 5, 6])


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 5), ("b", 2), (None, 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("b", 3, 9.0)], "k string, s int, v double")
    got = sorted(((r["k"] or "", r["t"], r["v"]) for r in joins.asof_join(left, right, ["k"], "t", "s", ["v"], strict).collect()), key=str)
    at5 = 1.0 if strict else 2.0
    assert got == sorted([("", 3, None), ("a", 1, None), ("a", 5, at5), ("a", 5, at5), ("b", 2, None)], key=str)


def test_fuzzy_match_prefers_the_team(spark):
    a = spark.createDataFrame([(1, "D.J. Smith Jr", "Duke Blue"), (2, "Al Poe", None)], "i int, n string, t string")
    b = spark.createDataFrame([(7, "dj smith", "Ohio"), (8, "DJ Smith", "duke"), (9, "Al  Poe", "x")], "j int, m string, u string")
    assert rows(joins.fuzzy_match(a, b, "i", "n", "t", "j", "m", "u")) == [(1, 8, True), (2, 9, False)]


def joined_rows(node):
    """Rows that the joins of an executed plan made."""
    inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
    inner += [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
    return own + sum(map(joined_rows, inner))


def test_fuzzy_match_judges_teams_and_not_rows(spark):
    """One name for all rows: work grows with the rows and the pairs of teams, not with the pairs of rows."""
    a = spark.range(900).select("id", F.lit("A. Poe Jr.").alias("n"), F.when(F.col("id") % 4 != 3, F.concat(F.lit("Team "), F.col("id") % 4)).alias("t"))
    b = spark.range(900).select(F.col("id").alias("j"), F.lit("a poe").alias("m"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("team "), F.col("id") % 5)).alias("u"))
    df = joins.fuzzy_match(a, b, "id", "n", "t", "j", "m", "u")
    found = {0: (0, False), 1: (1, True), 2: (2, True), 3: (0, False)}
    assert sorted(map(tuple, df.collect())) == [(i, *found[i % 4]) for i in range(900)]
    assert joined_rows(df._jdf.queryExecution().executedPlan()) < 2_000


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, s string, v int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6), (1, "z", None)], "k int, s string, v int")
    assert rows(upsert.upsert(old, new, ["k"])) == [(1, "z", 1), (2, "b", 5), (3, "c", 6)]
    assert rows(upsert.upsert(old, new, ["k"], overwrite=["v"], keep=["s"])) == [(1, "a", None), (2, "b", 5), (3, "c", 6)]
    assert rows(upsert.insert_ignore(old, new, ["k"])) == [(1, "a", 1), (2, "b", None), (3, "c", 6)]
    assert rows(upsert.fill_nulls(old, new, ["k"], ["v"])) == [(1, "a", 1), (2, "b", 5)]
    batch = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 4), (1, 3, "c", None)], "k int, at int, s string, v int")
    assert rows(upsert.last_wins(batch, ["k"], ["at"])) == [(1, "c", 4)]


def test_merging_duplicates(spark):
    people = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "y", 1), (4, None, 1)], "id int, name string, team int")
    facts = spark.createDataFrame([(2, "g1", 5), (2, "g2", 6), (1, "g1", 9), (3, "g1", 1)], "id int, g string, p int")
    m = upsert.duplicates(people, facts, "id", ["name", "team"])
    assert rows(m) == [(1, 2)]
    assert rows(upsert.merge_facts(facts, m, "id", ["g"])) == [(2, "g1", 5), (2, "g2", 6), (3, "g1", 1)]


def season(n=12, seed=1):
    rng = np.random.default_rng(seed)
    return [(f"{a}-{b}-{g}", 2026, a, b, int(rng.integers(50, 90)), 60, 10, 12, 20) for g in range(2) for a, b in itertools.permutations(range(n), 2)]


def test_adjusted_ratings_match_a_plain_loop(spark):
    data = season()
    tg = spark.createDataFrame(data, "game_id string, season int, team_id int, opponent_id int, points int, fga int, off_rebounds int, turnovers int, fta int")
    got = {r["team_id"]: (r["off"], r["def"], r["sos"]) for r in ratings.adjusted(ratings.edges(tg), 50).collect()}
    poss = 60 - 10 + 12 + 0.44 * 20
    teams = range(12)
    league = 100 * sum(r[4] for r in data) / (poss * len(data))
    raw_o = {t: np.mean([100 * r[4] / poss for r in data if r[2] == t]) for t in teams}
    raw_d = {t: np.mean([100 * r[4] / poss for r in data if r[3] == t]) for t in teams}
    o, d = dict(raw_o), dict(raw_d)
    for _ in range(50):
        no = {t: raw_o[t] * league / np.mean([d[r[3]] for r in data if r[2] == t]) for t in teams}
        nd = {t: raw_d[t] * league / np.mean([o[r[2]] for r in data if r[3] == t]) for t in teams}
        change = max(max(abs(no[t] - o[t]), abs(nd[t] - d[t])) for t in teams)
        o, d = no, nd
        if change < 0.01:
            break
    for t in teams:
        assert got[t] == pytest.approx((o[t], d[t], np.mean([o[r[3]] - d[r[3]] for r in data if r[2] == t])))


def test_elo_is_zero_sum_and_reads_the_past_only(spark):
    games = [(2026, f"g{i:02d}", dt.date(2026, 1, 1 + i // 3), i % 4, (i + 1 + i % 3) % 4 if (i + 1 + i % 3) % 4 != i % 4 else (i + 1) % 4, 70 + i, 70, i % 5 == 0) for i in range(20)]
    schema = "season int, game_id string, game_date date, home_team_id int, away_team_id int, home_score int, away_score int, is_neutral_site boolean"
    full = {r["game_id"]: (r["home_elo"], r["away_elo"]) for r in ratings.elo(spark.createDataFrame(games, schema)).collect()}
    part = {r["game_id"]: (r["home_elo"], r["away_elo"]) for r in ratings.elo(spark.createDataFrame(games[:9], schema)).collect()}
    assert {k: full[k] for k in part} == part and full["g00"] == (1500.0, 1500.0)
    assert np.mean([x for v in full.values() for x in v]) == pytest.approx(1500, abs=25)


def test_assignment_is_the_best(spark):
    rng = np.random.default_rng(0)
    for n in (1, 3, 5):
        s = rng.normal(size=(n, n))
        best = max(sum(s[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        a = similarity.assign(s)
        assert sorted(a) == list(range(n)) and sum(s[i, a[i]] for i in range(n)) == pytest.approx(best)


def test_archetypes_keep_their_invariants(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, (rng.normal(size=3) * 0.2 + np.eye(3)[i % 3] * 3).tolist()) for i in range(60)], "id int, v array<double>")
    out = similarity.archetypes(df, "id", "v", {c: np.eye(3)[i] for i, c in enumerate("abc")}, 2).collect()
    assert all(abs(sum(r["affinity"].values()) - 1) < 1e-9 and r["primary_score"] >= r["secondary_score"] for r in out)
    assert all(r["primary"] == "abc"[r["id"] % 3] for r in out)


def test_auc_with_ties(spark):
    data = [(i % 2, (i * 7 % 5) / 5.0) for i in range(41)]
    got = metrics.auc(spark.createDataFrame(data, "y int, s double"), "y", "s").first()[0]
    pairs = [(p, q) for y, p in data if y for z, q in data if not z]
    assert got == pytest.approx(np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p, q in pairs]))


def test_composite_examples(spark):
    base = "ext_pid int, season int, conf string, games_played int, mpg double, min_share_pct double, usage_rate double, ogbpm double, dgbpm double, player_sos double"
    # two players with the cohort means of the worked examples
    rest = (2, 2026, "x", 1, 17.2242 * 2 - 31.55, 36.6563 * 2 - 78.3, 10.0, 0.0, 0.0, None)
    out = steps.composite(spark.createDataFrame([(1, 2026, "a", 35, 31.55, 78.3, 19.6, 4.2958, 5.0538, None), rest], base))
    r = out.where("ext_pid = 1").first()
    assert r["value"] == pytest.approx(13.272, abs=2e-3) and r["value_v2"] == pytest.approx(10.803, abs=2e-3)
    none = steps.composite(spark.createDataFrame([(1, 2026, None, 0, None, None, None, None, None, None)], base)).first()
    assert none["value"] is None and none["value_v3_psos_pct"] is None


def test_rolling_and_schedules(spark):
    pg = spark.createDataFrame([(1, 1, 2026, dt.date(2026, 1, d), f"g{d}", 10.0, d, 2, 1, 1, 2, 1, 1.0) for d in range(1, 8)], "player_id int, team_id int, season int, game_date date, game_id string, minutes double, points int, total_rebounds int, assists int, fgm int, fga int, fta int, game_score double")
    got = {r["game_id"]: r["rolling_ppg"] for r in steps.rolling(pg).collect()}
    assert got["g1"] is None and got["g2"] == 1.0 and got["g7"] == 4.0
    g = spark.createDataFrame([("g", 2026, dt.date(2026, 1, 1), 1, 2, True), ("h", 2026, dt.date(2026, 1, 2), 1, 1, False)], "game_id string, season int, game_date date, home_team_id int, away_team_id int, is_neutral_site boolean")
    assert rows(steps.schedules(g).select("game_id", "team_id", "is_home")) == [("g", 1, False), ("g", 2, False), ("h", 1, True)]


def test_chronological_split_and_models(spark):
    df = spark.createDataFrame([(i, dt.date(2026, 1, 1) + dt.timedelta(days=i // 10), float(i % 7), float(i % 7 - 3)) for i in range(105)], "id int, day date, x double, margin double").withColumn("win", (F.col("margin") > 0).cast("double"))
    a, b = models.chronological(df, "day", "id")
    assert a.count() == 84 and b.count() == 21 and a.agg(F.max("id")).first()[0] == 83
    out = models.predict(b, models.train(a, ["x"], "margin", "win", models.Params(trees=5))).collect()
    assert all(abs(r["pred_margin"] - r["margin"]) < 1.5 for r in out)


def test_pages_and_sorts(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "A", 3.0), (3, None, 1.0)], "id int, s string, x double")
    assert [r["id"] for r in sorting.page(sorting.sort_by(df, "x", {"x": "x"}), 10).collect()] == [2, 3, 1]
    assert [r["id"] for r in sorting.client_sort(df, "s").collect()] == [2, 1, 3]
    with pytest.raises(ValueError, match="no sort field"):
        sorting.sort_by(df, "s; drop", {"x": "x"})
