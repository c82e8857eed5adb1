"""Checked queries over box scores: each Spark query here has a DuckDB statement over the same tables that says what it must return."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import exprs as X
from lakeloom.operators import boosting, joins, ratings, sorting, upsert, windows
from lakeloom.plans import features, models, steps
from lakeloom.sources import boxscores
from lakeloom.sources.tables import stored

ROUNDS = 10


def rnd(e: str, n: int) -> str:
    u = f"1e{n}"
    return f"(sign({e}) * floor(abs({e}) * {u} + 0.500000001e0) / {u} + 0e0)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0e0))"


def pos(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END)"


def _chain() -> str:
    per = lambda x, ch: f"CASE WHEN {ch} > 0 THEN 100e0 * {x} * (tm / 5e0) / (s_minutes * ({ch})) END"
    z = lambda c: f"COALESCE({c}, 0)"
    d = lambda e, n: f"CAST(SUM({e}) AS DOUBLE) AS {n}"
    score = "COALESCE(points,0) + 0.4e0*COALESCE(fgm,0) - 0.7e0*COALESCE(fga,0) - 0.4e0*(COALESCE(fta,0)-COALESCE(ftm,0)) + 0.7e0*COALESCE(off_rebounds,0) + 0.3e0*COALESCE(def_rebounds, total_rebounds - off_rebounds, 0) + COALESCE(steals,0) + 0.7e0*COALESCE(assists,0) + 0.7e0*COALESCE(blocks,0) - 0.4e0*COALESCE(fouls,0) - COALESCE(turnovers,0)"
    poss = lambda p: f"({p}fga - {p}orb + {p}tov + 0.44e0 * {p}fta)"
    totals = lambda p: ", ".join(d(c, p + n) for n, c in (("fga", "fga"), ("fgm", "fgm"), ("tpm", "tpm"), ("fta", "fta"), ("orb", "off_rebounds"), ("tov", "turnovers"), ("pts", "points")))
    k1 = [
        "e AS (SELECT season, team_id, opponent_id, CAST(SUM(points) AS DOUBLE) AS pts, CAST(SUM(fga) - SUM(COALESCE(off_rebounds,0)) + SUM(COALESCE(turnovers,0)) + 0.44e0 * SUM(COALESCE(fta,0)) AS DOUBLE) AS poss, CAST(COUNT(*) AS DOUBLE) AS games FROM tg WHERE points IS NOT NULL AND fga IS NOT NULL AND fga - COALESCE(off_rebounds,0) + COALESCE(turnovers,0) + 0.44e0 * COALESCE(fta,0) > 0 GROUP BY ALL)",
        "lg AS (SELECT season, SUM(pts) / SUM(poss) * 100 AS league FROM e GROUP BY season)",
        "o0 AS (SELECT season, team_id, SUM(pts) AS op, SUM(poss) AS os FROM e GROUP BY ALL)",
        "q0 AS (SELECT season, opponent_id AS team_id, SUM(pts) AS dp, SUM(poss) AS ds FROM e GROUP BY ALL)",
        "r0 AS (SELECT o0.season, o0.team_id, op / os * 100 AS raw_o, CASE WHEN ds > 0 THEN dp / ds * 100 ELSE league END AS raw_d, league, op / os * 100 AS o, CASE WHEN ds > 0 THEN dp / ds * 100 ELSE league END AS d, COALESCE(ds, 0) AS ds FROM o0 LEFT JOIN q0 USING (season, team_id) JOIN lg USING (season))",
    ]
    for i in range(1, ROUNDS + 1):
        p = f"r{i - 1}"
        k1 += [
            f"a{i} AS (SELECT e.season, e.team_id, SUM(COALESCE(r.d, league2) * e.poss) / SUM(e.poss) AS met FROM (SELECT e.*, lg.league AS league2 FROM e JOIN lg USING (season)) e LEFT JOIN {p} r ON r.season = e.season AND r.team_id = e.opponent_id GROUP BY ALL)",
            f"b{i} AS (SELECT e.season, e.opponent_id AS team_id, SUM(r.o * e.poss) / SUM(e.poss) AS met FROM e JOIN {p} r ON r.season = e.season AND r.team_id = e.team_id GROUP BY ALL)",
            f"r{i} AS MATERIALIZED (SELECT r.season, r.team_id, raw_o, raw_d, league, raw_o * (league / a.met) AS o, CASE WHEN ds > 0 THEN raw_d * (league / b.met) ELSE r.d END AS d, ds FROM {p} r LEFT JOIN a{i} a USING (season, team_id) LEFT JOIN b{i} b USING (season, team_id))",
        ]
    last = f"r{ROUNDS}"
    k1.append(f"sos AS (SELECT e.season, e.team_id, SUM(COALESCE(r.o - r.d, 0e0) * e.games) / SUM(e.games) AS sos FROM e LEFT JOIN {last} r ON r.season = e.season AND r.team_id = e.opponent_id GROUP BY ALL)")
    return ",\n".join([
        boxscores.SQL.strip(),
        "fake AS (SELECT DISTINCT game_id FROM pg0 WHERE total_rebounds IS NULL AND off_rebounds > 0)",
        "pg1 AS (SELECT p.* REPLACE (CASE WHEN f.game_id IS NOT NULL AND total_rebounds = 0 THEN NULL ELSE total_rebounds END AS total_rebounds, CASE WHEN f.game_id IS NOT NULL AND total_rebounds = 0 THEN NULL ELSE def_rebounds END AS def_rebounds) FROM pg0 p LEFT JOIN fake f ON p.game_id = f.game_id)",
        "pg2 AS (SELECT * REPLACE (COALESCE(def_rebounds, CASE WHEN total_rebounds >= off_rebounds THEN total_rebounds - off_rebounds END) AS def_rebounds) FROM pg1)",
        f"pg AS MATERIALIZED (SELECT *, CASE WHEN turnovers > 0 THEN CAST(assists AS DOUBLE) / turnovers ELSE CAST(assists AS DOUBLE) END AS ast_to_ratio, CASE WHEN points IS NOT NULL THEN {rnd(score, 1)} END AS game_score FROM pg2)",
        "tg AS MATERIALIZED (SELECT t.* REPLACE (COALESCE(t.def_rebounds, greatest(o.fga - o.fgm - o.off_rebounds, CASE WHEN o.fga IS NULL THEN NULL ELSE 0 END)) AS def_rebounds, CASE WHEN t.def_rebounds IS NULL AND o.fga IS NOT NULL THEN t.off_rebounds + greatest(o.fga - o.fgm - o.off_rebounds, 0) ELSE t.total_rebounds END AS total_rebounds) FROM tg0 t LEFT JOIN tg0 o ON o.game_id = t.game_id AND o.team_id = t.opponent_id)",
        "ps0 AS (SELECT p.player_id, p.team_id, p.season, COUNT(*) AS games_played, COUNT(*) FILTER (WHERE starter) AS games_started, "
        + ", ".join(f"{rnd(f'AVG(p.{c})', 1)} AS {n}" for n, c in (("mpg", "minutes"), ("ppg", "points"), ("rpg", "total_rebounds"), ("apg", "assists"), ("spg", "steals"), ("bpg", "blocks"), ("topg", "turnovers"), ("fpg", "fouls")))
        + ", " + ", ".join(d(f"p.{c}", f"s_{c}") for c in ("fgm", "fga", "tpm", "tpa", "ftm", "fta", "points", "minutes", "assists"))
        + ", " + ", ".join(d(z(f"p.{c}"), n) for n, c in (("z_tpm", "tpm"), ("z_fta", "fta"), ("z_tov", "turnovers"), ("z_orb", "off_rebounds"), ("z_drb", "def_rebounds"), ("z_stl", "steals"), ("z_blk", "blocks"), ("t_fgm", "team_fgm"), ("t_fga", "team_fga"), ("t_fta", "team_fta"), ("t_tov", "team_turnovers")))
        + ", " + d("COALESCE(t.minutes, 200)", "tm") + ", " + d(z("t.off_rebounds") + "+" + z("o.def_rebounds"), "orb_chances") + ", " + d(z("t.def_rebounds") + "+" + z("o.off_rebounds"), "drb_chances")
        + ", " + ", ".join(d(z(f"o.{c}"), n) for n, c in (("o_fga", "fga"), ("o_tpa", "tpa"), ("o_fta", "fta"), ("o_orb", "off_rebounds"), ("o_tov", "turnovers")))
        + " FROM pg p LEFT JOIN tg t ON t.game_id = p.game_id AND t.team_id = p.team_id LEFT JOIN tg o ON o.game_id = p.game_id AND o.team_id = p.opponent_id WHERE p.minutes > 0 GROUP BY p.player_id, p.team_id, p.season)",
        "ps1 AS MATERIALIZED (SELECT player_id, team_id, season, games_played, games_started, mpg, ppg, rpg, apg, spg, bpg, topg, fpg, "
        + ", ".join(f"{rnd(e, 3)} AS {n}" for n, e in {
            "fg_pct": pos("s_fgm", "s_fga"), "tp_pct": pos("s_tpm", "s_tpa"), "ft_pct": pos("s_ftm", "s_fta"), "effective_fg_pct": pos("s_fgm + 0.5e0 * z_tpm", "s_fga"),
            "true_shooting_pct": pos("s_points", "(2e0 * (s_fga + 0.44e0 * z_fta))"), "usage_rate": "(CASE WHEN t_fga + 0.44e0 * t_fta + t_tov > 0 THEN (s_fga + 0.44e0 * z_fta + z_tov) * (tm / 5e0) / (s_minutes * (t_fga + 0.44e0 * t_fta + t_tov)) END)",
            "ast_pct": pos("s_assists", "(5e0 * s_minutes * t_fgm / tm - s_fgm)"), "tov_pct": pos("z_tov", "(s_fga + 0.44e0 * z_fta + z_tov)"), "ft_rate": pos("z_fta", "s_fga"),
        }.items())
        + ", " + ", ".join(f"{rnd('(' + e + ')', 1)} AS {n}" for n, e in {"orb_pct": per("z_orb", "orb_chances"), "drb_pct": per("z_drb", "drb_chances"), "stl_pct": per("z_stl", "o_fga - o_orb + o_tov + 0.44e0 * o_fta"), "blk_pct": per("z_blk", "o_fga - o_tpa")}.items()) + " FROM ps0)",
        f"own AS (SELECT *, {poss('')} AS poss FROM (SELECT team_id, season, COUNT(*) AS games, {totals('')} FROM tg GROUP BY ALL))",
        f"opp AS (SELECT *, {poss('o_')} AS o_poss FROM (SELECT opponent_id AS team_id, season, {totals('o_')} FROM tg GROUP BY ALL))",
        f"reb AS (SELECT t.team_id, t.season, {rnd(div('SUM(t.off_rebounds)', 'SUM(t.off_rebounds) + SUM(o.def_rebounds)'), 3)} AS off_rebound_pct, {rnd(div('SUM(t.def_rebounds)', 'SUM(t.def_rebounds) + SUM(o.off_rebounds)'), 3)} AS def_rebound_pct FROM tg t JOIN tg o ON o.game_id = t.game_id AND o.team_id = t.opponent_id WHERE t.off_rebounds IS NOT NULL AND t.def_rebounds > 0 AND o.off_rebounds IS NOT NULL AND o.def_rebounds > 0 GROUP BY ALL)",
        f"mar AS (SELECT t.team_id, t.season, {rnd('AVG(t.points - o.points)', 1)} AS point_diff, COUNT(*) FILTER (WHERE t.points > o.points) AS wins, COUNT(*) FILTER (WHERE t.points < o.points) AS losses FROM tg t JOIN tg o ON o.game_id = t.game_id AND o.team_id = t.opponent_id GROUP BY ALL)",
        "ts0 AS MATERIALIZED (SELECT own.team_id, own.season, own.games, COALESCE(wins, 0) AS wins, COALESCE(losses, 0) AS losses, "
        + ", ".join(f"{rnd(e, 1)} AS {n}" for n, e in {"adj_offense": div("pts", "poss") + " * 100", "adj_defense": div("o_pts", "o_poss") + " * 100", "adj_efficiency_margin": f"(({div('pts', 'poss')} - {div('o_pts', 'o_poss')}) * 100)", "adj_tempo": "((poss + COALESCE(o_poss, poss)) / (2e0 * games))"}.items())
        + ", " + ", ".join(f"{rnd(e, 3)} AS {n}" for n, e in {"effective_fg_pct": div("fgm + 0.5e0 * tpm", "fga"), "turnover_pct": div("tov", "poss"), "ft_rate": div("fta", "fga"), "opp_effective_fg_pct": div("o_fgm + 0.5e0 * o_tpm", "o_fga"), "opp_turnover_pct": div("o_tov", "o_poss"), "opp_ft_rate": div("o_fta", "o_fga")}.items())
        + ", off_rebound_pct, def_rebound_pct, point_diff FROM own LEFT JOIN opp USING (team_id, season) LEFT JOIN reb USING (team_id, season) LEFT JOIN mar USING (team_id, season))",
        *k1,
        f"ts AS MATERIALIZED (SELECT ts0.* REPLACE (COALESCE({rnd('r.o', 1)}, adj_offense) AS adj_offense, COALESCE({rnd('r.d', 1)}, adj_defense) AS adj_defense, COALESCE({rnd('(r.o - r.d)', 1)}, adj_efficiency_margin) AS adj_efficiency_margin), {rnd('sos.sos', 1)} AS sos, CASE WHEN sos.sos IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY ts0.season ORDER BY round(sos.sos, 9) DESC NULLS LAST, ts0.team_id) END AS sos_rank FROM ts0 LEFT JOIN {last} r ON r.season = ts0.season AND r.team_id = ts0.team_id LEFT JOIN sos ON sos.season = ts0.season AND sos.team_id = ts0.team_id)",
        f"psos AS (SELECT p.player_id, p.team_id, p.season, {rnd(div('SUM(COALESCE(t.adj_efficiency_margin, 0e0) * p.minutes)', 'SUM(p.minutes)'), 1)} AS player_sos FROM pg p LEFT JOIN ts t ON t.team_id = p.opponent_id AND t.season = p.season WHERE p.minutes > 0 GROUP BY ALL)",
        "ps AS MATERIALIZED (SELECT ps1.*, player_sos FROM ps1 LEFT JOIN psos USING (player_id, team_id, season))",
    ])


@lru_cache(maxsize=1)
def chain() -> str:
    return _chain()


def sql(select: str) -> str:
    return f"WITH {chain()}\n{select}"


def _scores(spark: SparkSession, d: str) -> boxscores.BoxScores:
    return boxscores.box_scores(spark, d)


def _all(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return steps.run_all(_scores(spark, d), ROUNDS, 0.0)  # the oracle runs all rounds


RANKED = ["adj_efficiency_margin", "adj_offense", "adj_tempo", "effective_fg_pct", "off_rebound_pct", "ft_rate", "sos"]
LOW = ["adj_defense", "turnover_pct", "opp_effective_fg_pct"]


def _ranks(ts: DataFrame) -> DataFrame:
    return ts.select("*", *[windows.rank_of(c, ["season"]).alias(f"{c}_rank") for c in RANKED], *[windows.rank_of(c, ["season"], False).alias(f"{c}_rank") for c in LOW])


def q01_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Q01: teams of each season by adjusted margin, with a row number and a rank for each statistic."""
    s = _scores(spark, d)
    ts = _all(spark, d)["team_seasons"].drop("sos_rank").where("adj_efficiency_margin IS NOT NULL")
    ranked = _ranks(ts).join(s.teams, "team_id")
    out = ranked.select("season", "team_id", "name", "conference", "wins", "losses", windows.row_number(["season"], [X.ordered("adj_efficiency_margin", True), "team_id"]).alias("position"), *RANKED, *LOW, *[f"{c}_rank" for c in RANKED + LOW])
    return out.orderBy("season", "position")


def _rank_sql(src: str) -> str:
    return "SELECT *, " + ", ".join(f"RANK() OVER (PARTITION BY season ORDER BY {c} {'DESC' if c in RANKED else 'ASC'} NULLS LAST) AS {c}_rank" for c in RANKED + LOW) + f" FROM {src}"


SQL_Q01 = f"SELECT season, team_id, name, conference, wins, losses, ROW_NUMBER() OVER (PARTITION BY season ORDER BY adj_efficiency_margin DESC NULLS LAST, team_id) AS position, {', '.join(RANKED + LOW)}, {', '.join(c + '_rank' for c in RANKED + LOW)} FROM ({_rank_sql('(SELECT * EXCLUDE (sos_rank) FROM ts WHERE adj_efficiency_margin IS NOT NULL)')}) JOIN teams USING (team_id)"


def q02_profile(spark: SparkSession, d: str) -> DataFrame:
    """Q02: ranks over all rows, those without a margin too, then all team names."""
    s = _scores(spark, d)
    ts = _all(spark, d)["team_seasons"].withColumn("adj_efficiency_margin", F.when(F.col("team_id") % 5 != 0, F.col("adj_efficiency_margin")))
    r = ts.select("team_id", "season", "adj_efficiency_margin", windows.rank_of("adj_efficiency_margin", ["season"]).alias("margin_rank"), windows.rank_of("adj_defense", ["season"], False).alias("defense_rank"))
    return s.teams.select("team_id", "name").join(r, "team_id", "left")


SQL_Q02 = "SELECT t.team_id, name, season, adj_efficiency_margin, margin_rank, defense_rank FROM teams t LEFT JOIN (SELECT team_id, season, m AS adj_efficiency_margin, RANK() OVER (PARTITION BY season ORDER BY m DESC NULLS LAST) AS margin_rank, RANK() OVER (PARTITION BY season ORDER BY adj_defense ASC NULLS LAST) AS defense_rank FROM (SELECT *, CASE WHEN team_id % 5 <> 0 THEN adj_efficiency_margin END AS m FROM ts)) r ON r.team_id = t.team_id"


def _games(spark: SparkSession, d: str, scores: boxscores.BoxScores | None = None) -> DataFrame:
    tg = (scores or _scores(spark, d)).team_games
    side = tg.select("game_id", "season", "game_date", F.least("team_id", "opponent_id").alias("home_team_id"), F.greatest("team_id", "opponent_id").alias("away_team_id"), "is_home", "points")
    g = side.groupBy("game_id", "season", "game_date", "home_team_id", "away_team_id").agg(F.max(F.when(F.col("is_home"), F.col("points"))).alias("home_score"), F.max(F.when(~F.col("is_home"), F.col("points"))).alias("away_score"))
    return g.withColumn("is_neutral_site", (F.col("home_team_id") + F.col("away_team_id")) % 4 == 0)


GAMES_SQL = "games AS (SELECT game_id, season, game_date, least(team_id, opponent_id) AS home_team_id, greatest(team_id, opponent_id) AS away_team_id, MAX(CASE WHEN is_home THEN points END) AS home_score, MAX(CASE WHEN NOT is_home THEN points END) AS away_score, (least(team_id, opponent_id) + greatest(team_id, opponent_id)) % 4 = 0 AS is_neutral_site FROM tg0 GROUP BY ALL)"


def gsql(select: str) -> str:
    return f"WITH {chain()},\n{GAMES_SQL}\n{select}"


def q03_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Q03: each side's schedule with opponent names and scores from its own point of view."""
    s = _scores(spark, d)
    g = _games(spark, d, s)
    sc = steps.schedules(g).join(g.select("game_id", "home_team_id", "home_score", "away_score"), "game_id")
    home = F.col("team_id") == F.col("home_team_id")
    sc = sc.select("game_id", "season", "game_date", "team_id", "opponent_id", "is_home", F.when(home, F.col("home_score")).otherwise(F.col("away_score")).alias("team_score"), F.when(home, F.col("away_score")).otherwise(F.col("home_score")).alias("opp_score"))
    return joins.lookup(sc, s.teams, {"opponent_id": "team_id"}, {"name": "opponent"})


SQL_Q03 = "SELECT game_id, season, game_date, x.team_id, opponent_id, is_home, team_score, opp_score, name AS opponent FROM (SELECT game_id, season, game_date, home_team_id AS team_id, away_team_id AS opponent_id, NOT is_neutral_site AS is_home, home_score AS team_score, away_score AS opp_score FROM games UNION ALL SELECT game_id, season, game_date, away_team_id, home_team_id, false, away_score, home_score FROM games) x LEFT JOIN teams t ON t.team_id = x.opponent_id"


def c12_schedules(spark: SparkSession, d: str) -> DataFrame:
    """Both perspectives of each game, home first, unique by game and team."""
    return steps.schedules(_games(spark, d))


SQL_C12 = "SELECT game_id, season, game_date, home_team_id AS team_id, away_team_id AS opponent_id, NOT is_neutral_site AS is_home FROM games UNION ALL SELECT game_id, season, game_date, away_team_id, home_team_id, false FROM games"


def q04_roster(spark: SparkSession, d: str) -> DataFrame:
    """Q04: rosters with season statistics, percentile and latest form, by points and then minutes."""
    s, a = _scores(spark, d), _all(spark, d)
    form = windows.distinct_on(a["rolling"].where("rolling_ppg IS NOT NULL"), ["player_id", "season"], [F.col("game_date").desc(), F.col("game_id").desc()]).select("player_id", "season", "rolling_ppg")
    out = s.players.drop("team_id").join(a["player_seasons"].select("player_id", "team_id", "season", "ppg", "mpg", "usage_rate"), "player_id").join(a["percentiles"].select("player_id", "season", "ppg_pct"), ["player_id", "season"], "left").join(form, ["player_id", "season"], "left")
    return out.select("team_id", "season", "player_id", "name", "ppg", "mpg", "usage_rate", X.round_n("ppg_pct", 6).alias("ppg_pct"), "rolling_ppg").orderBy("team_id", "season", X.ordered("ppg", True), X.ordered("mpg", True), "player_id")


ROLL = f"roll AS (SELECT *, {rnd('AVG(points) OVER w', 1)} AS rolling_ppg, {rnd('AVG(total_rebounds) OVER w', 1)} AS rolling_rpg, {rnd('AVG(assists) OVER w', 1)} AS rolling_apg, {rnd(pos('SUM(fgm) OVER w', '(SUM(fga) OVER w)'), 3)} AS rolling_fg_pct, {rnd(pos('SUM(points) OVER w', '(2e0 * ((SUM(fga) OVER w) + 0.44e0 * (SUM(fta) OVER w)))'), 3)} AS rolling_ts_pct, {rnd('AVG(game_score) OVER w', 1)} AS rolling_game_score FROM pg WHERE minutes > 0 WINDOW w AS (PARTITION BY player_id, team_id, season ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"
_UP = [m for m in steps.PERCENTILE_UP if m != "offensive_rating"]
_DOWN = [m for m in steps.PERCENTILE_DOWN if m != "defensive_rating"]
PCT = "best AS (SELECT * FROM ps WHERE games_played >= 10 AND mpg >= 10 QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id, season ORDER BY games_played DESC, team_id) = 1), pct AS (SELECT player_id, season, " + ", ".join(f"PERCENT_RANK() OVER (PARTITION BY season ORDER BY {m} {'ASC NULLS LAST' if m in _UP else 'DESC NULLS FIRST'}) AS {m}_pct" for m in _UP + _DOWN) + " FROM best)"
SQL_Q04 = f"SELECT b.team_id, b.season, player_id, name, ppg, mpg, usage_rate, {rnd('ppg_pct', 6)} AS ppg_pct, rolling_ppg FROM players p JOIN ps b USING (player_id) LEFT JOIN pct USING (player_id, season) LEFT JOIN (SELECT player_id, season, rolling_ppg FROM roll WHERE rolling_ppg IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id, season ORDER BY game_date DESC, game_id DESC) = 1) f USING (player_id, season)"


def psql(select: str) -> str:
    return f"WITH {chain()},\n{ROLL},\n{PCT}\n{select}"


def _search(spark: SparkSession, d: str) -> DataFrame:
    s, a = _scores(spark, d), _all(spark, d)
    ps = steps.qualified(a["player_lines"], 5, 10).join(s.players.select("player_id", "name"), "player_id")
    ps = joins.lookup(ps, s.teams, {"team_id": "team_id"}, {"conference": "conference"})
    found: list = [F.col("name").ilike("%1%"), None, F.col("conference") == "ASIA"]
    for c in found:
        ps = ps.where(c) if c is not None else ps
    return ps


SORTS = {"ppg": "ppg", "mpg": "mpg", "usage": "usage_rate"}
SEARCH_SQL = "FROM ps JOIN players p USING (player_id) JOIN teams t ON t.team_id = ps.team_id WHERE games_played >= 5 AND mpg >= 10 AND p.name ILIKE '%1%' AND conference = 'ASIA'"


def q05_search_page(spark: SparkSession, d: str) -> DataFrame:
    """Q05: a page of a filtered search, sorted by a whitelisted field with a unique tie-break."""
    ps = _search(spark, d).withColumn("id", F.concat_ws("-", "player_id", "season"))
    return sorting.page(sorting.sort_by(ps, "usage", SORTS), 20, 5).select("id", "name", "season", "ppg", "usage_rate")


SQL_Q05 = f"SELECT player_id || '-' || season AS id, p.name, season, ppg, usage_rate {SEARCH_SQL} ORDER BY usage_rate DESC NULLS LAST, id LIMIT 20 OFFSET 5"


def q05_search_total(spark: SparkSession, d: str) -> DataFrame:
    """Q05: the number of rows that the search finds."""
    return _search(spark, d).agg(F.count("*").alias("total"))


SQL_Q05T = f"SELECT COUNT(*) AS total {SEARCH_SQL}"


def q06_player_profile(spark: SparkSession, d: str) -> DataFrame:
    """Q06: players with their team."""
    s = _scores(spark, d)
    return joins.lookup(s.players, s.teams, {"team_id": "team_id"}, {"name": "team", "conference": "conference"})


SQL_Q06 = "SELECT player_id, p.name, p.team_id, t.name AS team, conference FROM players p LEFT JOIN teams t ON t.team_id = p.team_id"


def q07_player_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Season statistics of every player."""
    return _all(spark, d)["player_seasons"]


def q08_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percent ranks of players' statistics, ascending and descending, nulls counted."""
    p = _all(spark, d)["percentiles"]
    return p.select("player_id", "season", *[X.round_n(c, 6).alias(c) for c in p.columns if c.endswith("_pct")])


SQL_Q08 = "SELECT player_id, season, " + ", ".join(f"{rnd(m + '_pct', 6)} AS {m}_pct" for m in _UP + _DOWN) + " FROM pct"


def q09_game_log(spark: SparkSession, d: str) -> DataFrame:
    """Game logs with rolling means of the five games before."""
    cols = ["player_id", "season", "game_date", "game_id", "points", "minutes", "game_score", "rolling_ppg", "rolling_rpg", "rolling_apg", "rolling_fg_pct", "rolling_ts_pct", "rolling_game_score"]
    return joins.lookup(_all(spark, d)["rolling"], _scores(spark, d).teams, {"opponent_id": "team_id"}, {"name": "opponent"}).select(*cols, "opponent")


SQL_Q09 = "SELECT player_id, season, game_date, game_id, points, minutes, game_score, rolling_ppg, rolling_rpg, rolling_apg, rolling_fg_pct, rolling_ts_pct, rolling_game_score, name AS opponent FROM roll LEFT JOIN teams t ON t.team_id = opponent_id"


def q10_league_averages(spark: SparkSession, d: str) -> DataFrame:
    """Q10: by season, mean points of the qualified and mean game score of their games."""
    a = _all(spark, d)
    q = steps.qualified(a["player_lines"]).select("player_id", "season", "ppg")
    ppg = q.groupBy("season").agg(X.round_n(F.avg("ppg"), 3).alias("avg_ppg"))
    gs = a["player_games"].join(q.select("player_id", "season").distinct(), ["player_id", "season"], "left_semi").groupBy("season").agg(X.round_n(F.avg("game_score"), 3).alias("avg_game_score"))
    return ppg.join(gs, "season")


SQL_Q10 = f"SELECT * FROM (SELECT season, {rnd('AVG(ppg)', 3)} AS avg_ppg FROM ps WHERE games_played >= 10 AND mpg >= 10 GROUP BY season) JOIN (SELECT season, {rnd('AVG(game_score)', 3)} AS avg_game_score FROM pg WHERE (player_id, season) IN (SELECT (player_id, season) FROM ps WHERE games_played >= 10 AND mpg >= 10) GROUP BY season) USING (season)"


def q11_masked_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Q11: percentiles of a rate among those with attempts, null for the others."""
    ps = _all(spark, d)["player_lines"].withColumn("tries", F.when(F.col("tp_pct") > 0, F.col("tp_pct")))
    ps = windows.with_percent_rank(windows.with_percent_rank(ps, "own", "tp_pct", ["season"], F.col("tries").isNotNull()), "every", "tries", ["season"], None, True)
    return ps.select("player_id", "team_id", "season", "tp_pct", X.round_n("own", 6).alias("tp_pctile"), X.round_n("every", 6).alias("all_pctile"))


SQL_Q11 = f"SELECT player_id, team_id, season, tp_pct, CASE WHEN tp_pct > 0 THEN {rnd('r', 6)} END AS tp_pctile, {rnd('r2', 6)} AS all_pctile FROM (SELECT *, PERCENT_RANK() OVER (PARTITION BY season, tp_pct IS NOT NULL AND tp_pct > 0 ORDER BY tp_pct NULLS LAST) AS r, PERCENT_RANK() OVER (PARTITION BY season ORDER BY CASE WHEN tp_pct > 0 THEN tp_pct END DESC NULLS FIRST) AS r2 FROM ps)"


def q12_games(spark: SparkSession, d: str) -> DataFrame:
    """Q12: games of a team on either side since a day, latest first."""
    g = _games(spark, d).where((F.col("game_date") >= F.lit("1995-06-01").cast("date")) & joins.any_of(F.col("home_team_id") == 3, F.col("away_team_id") == 3))
    return sorting.page(g.orderBy(F.col("game_date").desc(), "game_id"), 100, most=200)


SQL_Q12 = "SELECT game_id, season, game_date, home_team_id, away_team_id, home_score, away_score, is_neutral_site FROM games WHERE game_date >= DATE '1995-06-01' AND (home_team_id = 3 OR away_team_id = 3) ORDER BY game_date DESC, game_id LIMIT 100"


def q20_team_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Q20: for each query the team of that name in any case, else the shortest name that it begins."""
    t = _scores(spark, d).teams
    asked = spark.createDataFrame([("nation_1",), ("Nation_2",), ("na",), ("zzz",)], "query string")
    return joins.lookup_by_prefix(asked, "query", joins.prefix_index(t, "name", ["team_id", "name"])).select("query", "team_id", "name")


SQL_Q20 = "SELECT query, team_id, name FROM (VALUES ('nation_1'), ('Nation_2'), ('na'), ('zzz')) q(query) JOIN teams ON starts_with(lower(name), lower(query)) QUALIFY ROW_NUMBER() OVER (PARTITION BY query ORDER BY lower(name) <> lower(query), length(name), name) = 1"


def c02_player_games(spark: SparkSession, d: str) -> DataFrame:
    """Mended rebounds, assist ratio and game score."""
    return steps.fill_player_games(_scores(spark, d).player_games).select("player_id", "game_id", "total_rebounds", "def_rebounds", X.round_n("ast_to_ratio", 6).alias("ast_to_ratio"), "game_score")


SQL_C02 = f"SELECT player_id, game_id, total_rebounds, def_rebounds, {rnd('ast_to_ratio', 6)} AS ast_to_ratio, game_score FROM pg"


def c03_rebounds(spark: SparkSession, d: str) -> DataFrame:
    """Estimated defensive rebounds."""
    return steps.estimate_rebounds(_scores(spark, d).team_games).select("team_id", "game_id", "def_rebounds", "total_rebounds")


SQL_C03 = "SELECT team_id, game_id, CAST(def_rebounds AS BIGINT) AS def_rebounds, CAST(total_rebounds AS BIGINT) AS total_rebounds FROM tg"


def c05_four_factors(spark: SparkSession, d: str) -> DataFrame:
    """Four factors before adjustment."""
    return steps.team_seasons(steps.estimate_rebounds(_scores(spark, d).team_games))


def k1_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Opponent-adjusted efficiency after ten rounds, with schedule strength."""
    tg = steps.estimate_rebounds(_scores(spark, d).team_games)
    a = ratings.adjusted(ratings.edges(tg), ROUNDS, 0.0)
    return a.select("season", "team_id", *[X.round_n(c, 3).alias(c) for c in ("off", "def", "sos")])


def k1_by_joins(spark: SparkSession, d: str) -> DataFrame:
    """K1 where a group is too large for one task: every round a join over the stored edges."""
    tg = steps.estimate_rebounds(_scores(spark, d).team_games)
    a = ratings.adjusted(ratings.edges(tg), ROUNDS, 0.0, most_edges=0)
    return a.select("season", "team_id", *[X.round_n(c, 3).alias(c) for c in ("off", "def", "sos")])


SQL_K1 = f"SELECT season, r.team_id, {rnd('o', 3)} AS off, {rnd('d', 3)} AS def, {rnd('sos', 3)} AS sos FROM r{ROUNDS} r LEFT JOIN sos USING (season, team_id)"


def _snapshots(tg: DataFrame) -> DataFrame:
    """Ratings as of each January."""
    dates = tg.select(F.make_date(F.year("game_date"), F.lit(1), F.lit(1)).alias("as_of")).distinct()
    return ratings.by_date(tg, dates, ROUNDS, 0.0)


def k2_by_date(spark: SparkSession, d: str) -> DataFrame:
    """K2: adjusted ratings as of each January, from earlier games of all seasons, after ten rounds, with schedule strength."""
    r = _snapshots(steps.estimate_rebounds(_scores(spark, d).team_games))
    return r.select("as_of", "team_id", *[X.round_n(c, 3).alias(c) for c in ("off", "def", "sos")])


def _snap_sql() -> str:
    """CTEs of the rounds by date; the last is `snap` (as_of, team_id, o, d, sos)."""
    out = [
        "ed AS (SELECT game_date, team_id, opponent_id, CAST(points AS DOUBLE) AS pts, fga - COALESCE(off_rebounds,0) + COALESCE(turnovers,0) + 0.44e0 * COALESCE(fta,0) AS poss FROM tg WHERE points IS NOT NULL AND fga - COALESCE(off_rebounds,0) + COALESCE(turnovers,0) + 0.44e0 * COALESCE(fta,0) > 0)",
        "days AS (SELECT DISTINCT make_date(year(game_date), 1, 1) AS as_of FROM tg)",
        "de AS MATERIALIZED (SELECT as_of, team_id, opponent_id, SUM(pts) AS pts, SUM(poss) AS poss, CAST(COUNT(*) AS DOUBLE) AS games FROM days JOIN ed ON game_date < as_of GROUP BY ALL)",
        "dl AS (SELECT as_of, SUM(pts) / SUM(poss) * 100 AS league FROM de GROUP BY as_of)",
        "dt AS (SELECT DISTINCT as_of, team_id FROM (SELECT as_of, team_id FROM de UNION ALL SELECT as_of, opponent_id FROM de))",
        "s0 AS MATERIALIZED (SELECT dt.as_of, dt.team_id, league, COALESCE(op / os * 100, league) AS raw_o, COALESCE(dp / ds * 100, league) AS raw_d, COALESCE(op / os * 100, league) AS o, COALESCE(dp / ds * 100, league) AS d, os, ds FROM dt JOIN dl USING (as_of) LEFT JOIN (SELECT as_of, team_id, SUM(pts) AS op, SUM(poss) AS os FROM de GROUP BY ALL) USING (as_of, team_id) LEFT JOIN (SELECT as_of, opponent_id AS team_id, SUM(pts) AS dp, SUM(poss) AS ds FROM de GROUP BY ALL) USING (as_of, team_id))",
    ]
    for i in range(1, ROUNDS + 1):
        p = f"s{i - 1}"
        out += [
            f"x{i} AS (SELECT de.as_of, de.team_id, SUM(r.d * poss) / SUM(poss) AS met FROM de JOIN {p} r ON r.as_of = de.as_of AND r.team_id = de.opponent_id GROUP BY ALL)",
            f"y{i} AS (SELECT de.as_of, de.opponent_id AS team_id, SUM(r.o * poss) / SUM(poss) AS met FROM de JOIN {p} r ON r.as_of = de.as_of AND r.team_id = de.team_id GROUP BY ALL)",
            f"s{i} AS MATERIALIZED (SELECT as_of, team_id, league, raw_o, raw_d, CASE WHEN os > 0 THEN raw_o * (league / x{i}.met) ELSE o END AS o, CASE WHEN ds > 0 THEN raw_d * (league / y{i}.met) ELSE d END AS d, os, ds FROM {p} LEFT JOIN x{i} USING (as_of, team_id) LEFT JOIN y{i} USING (as_of, team_id))",
        ]
    out.append(f"snap AS MATERIALIZED (SELECT r.as_of, r.team_id, r.o, r.d, COALESCE(m.sos, 0e0) AS sos FROM s{ROUNDS} r LEFT JOIN (SELECT de.as_of, de.team_id, SUM((q.o - q.d) * games) / SUM(games) AS sos FROM de JOIN s{ROUNDS} q ON q.as_of = de.as_of AND q.team_id = de.opponent_id GROUP BY ALL) m USING (as_of, team_id))")
    return ",\n".join(out)


SQL_K2 = f"SELECT as_of, team_id, {rnd('o', 3)} AS off, {rnd('d', 3)} AS def, {rnd('sos', 3)} AS sos FROM snap"


def k3_elo(spark: SparkSession, d: str) -> DataFrame:
    """K3: pre-game Elo of both sides of every game."""
    return ratings.elo(_games(spark, d)).select("season", "game_id", X.round_n("home_elo", 3).alias("home_elo"), X.round_n("away_elo", 3).alias("away_elo"))


#: Elo is sequential: a recursive step a game, with the ratings of all teams (ids from 0) as a list; seasons run side by side.
SQL_K3 = """, gk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY game_date, game_id) AS k FROM games),
elo AS (
  SELECT season, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS game_id, CAST(NULL AS DOUBLE) AS eh, CAST(NULL AS DOUBLE) AS ea, list_transform(range((SELECT MAX(team_id) + 1 FROM teams)), lambda i: 1500e0) AS e FROM (SELECT DISTINCT season FROM gk)
  UNION ALL
  SELECT season, k, game_id, eh, ea, list_transform(range(len(e)), lambda i: CASE WHEN i = h THEN eh + COALESCE(st, 0e0) WHEN i = a THEN ea - COALESCE(st, 0e0) ELSE e[i + 1] END) FROM (
    SELECT *, 20e0 * ln(abs(m) + 1) * 2.2e0 / ((eh - ea) * 0.001e0 + 2.2e0) * (CASE WHEN m > 0 THEN 1e0 WHEN m < 0 THEN 0e0 ELSE 0.5e0 END - 1 / (1 + pow(10e0, (ea - eh - CASE WHEN neutral THEN 0e0 ELSE 3.5e0 END) / 400))) AS st FROM (
      SELECT g.season, g.k, g.game_id, g.home_team_id AS h, g.away_team_id AS a, elo.e[g.home_team_id + 1] AS eh, elo.e[g.away_team_id + 1] AS ea, g.home_score - g.away_score AS m, g.is_neutral_site AS neutral, elo.e AS e
      FROM elo JOIN gk g ON g.season = elo.season AND g.k = elo.k + 1))
)"""


def rsql(select: str) -> str:
    return f"WITH RECURSIVE {chain()},\n{GAMES_SQL}\n{SQL_K3}\n{select}"


SQL_K3_OUT = f"SELECT season, game_id, {rnd('eh', 3)} AS home_elo, {rnd('ea', 3)} AS away_elo FROM elo WHERE k > 0"


def c08_player_sos(spark: SparkSession, d: str) -> DataFrame:
    """Schedule strength of players."""
    a = _all(spark, d)
    return steps.player_sos(a["player_games"], a["team_seasons"])


def _external(a: steps.Steps) -> DataFrame:
    """External season rows: shares and impact drawn from season statistics."""
    ps = joins.lookup(a["player_seasons"], a.scores.teams, {"team_id": "team_id"}, {"conference": "conf"})
    return ps.select(F.col("player_id").alias("ext_pid"), "season", "conf", "games_played", "mpg", (F.col("mpg") * 2.5).alias("min_share_pct"), (F.col("usage_rate") * 100).alias("usage_rate"), F.when(F.col("games_played") % 7 != 0, F.col("ppg") - 9.0).alias("ogbpm"), (F.col("rpg") - 6.0).alias("dgbpm"), "player_sos")


EXT = "ext AS (SELECT player_id AS ext_pid, season, conference AS conf, games_played, mpg, mpg * 2.5e0 AS min_share_pct, usage_rate * 100 AS usage_rate, CASE WHEN games_played % 7 <> 0 THEN ppg - 9e0 END AS ogbpm, rpg - 6e0 AS dgbpm, player_sos FROM ps LEFT JOIN teams USING (team_id))"
TIERS = ["adj", "value", "value_o", "value_d", "min_adj", "value_v2", "conf_sos", "value_v3", "value_o_v3", "value_d_v3", "value_v3_psos", "value_o_v3_psos", "value_v3_psos_pct"]


def c09_composite(spark: SparkSession, d: str) -> DataFrame:
    """All tiers of the composite and its percentile."""
    t = steps.composite(_external(_all(spark, d)))
    return t.select("ext_pid", "season", *[X.round_n(c, 4).alias(c) for c in TIERS])


def _c09_sql() -> str:
    k = steps.CompositeConstants()
    inputs = "ogbpm IS NOT NULL AND dgbpm IS NOT NULL AND usage_rate IS NOT NULL AND min_share_pct IS NOT NULL AND mpg IS NOT NULL AND games_played > 0"
    t3 = lambda shift, s: f"(adj + {shift}) * mp_factor * gp_weight AS value_v3{s}, ({{o}} + CASE WHEN abs(adj) > 1e-9 THEN {shift} * o / adj ELSE {shift} * 0.5e0 END) * mp_factor * gp_weight AS value_o_v3{s}, (d + CASE WHEN abs(adj) > 1e-9 THEN {shift} * d / adj ELSE {shift} * 0.5e0 END) * mp_factor * gp_weight AS value_d_v3{s}".replace("{o}", "o")
    return f"""WITH {chain()}, {EXT},
    means AS (SELECT season, AVG(mpg) AS mp, AVG(min_share_pct) AS ms FROM ext WHERE {inputs} GROUP BY season),
    t1 AS (SELECT ext.*, CASE WHEN ok THEN pow(mpg / mp, 0.5e0) END AS min_factor, CASE WHEN ok THEN pow(min_share_pct / ms, 0.5e0) END AS mp_factor, CASE WHEN ok THEN games_played / (games_played + 8e0) END AS gp_weight,
      CASE WHEN ok THEN ogbpm * pow(usage_rate / {k.usage_ref}e0, 0.7e0) END AS o, CASE WHEN ok THEN dgbpm * (1e0 - 0.1e0 * (usage_rate / {k.usage_ref}e0)) END AS d
      FROM (SELECT *, COALESCE({inputs} AND min_share_pct > 0, false) AS ok FROM ext) ext LEFT JOIN means USING (season)),
    t2 AS (SELECT *, o + d AS adj FROM t1),
    st AS (SELECT * FROM t2 WHERE games_played >= 20 AND adj IS NOT NULL AND conf IS NOT NULL),
    cs AS (SELECT season, conf, AVG(adj) - MAX(om) AS sos FROM st JOIN (SELECT season, AVG(adj) AS om FROM st GROUP BY season) USING (season) GROUP BY season, conf),
    t3 AS (SELECT t2.*, CASE WHEN adj IS NOT NULL THEN sos END AS conf_sos, CASE WHEN adj IS NOT NULL THEN sos * 0.5e0 END AS sh, CASE WHEN adj IS NOT NULL THEN player_sos * 0.15e0 END AS ph FROM t2 LEFT JOIN cs USING (season, conf)),
    t4 AS (SELECT *, adj * mp_factor AS value, o * mp_factor AS value_o, d * mp_factor AS value_d, adj * min_factor AS min_adj, adj * mp_factor * gp_weight AS value_v2, {t3('sh', '')}, {t3('ph', '_psos')} FROM t3),
    t5 AS (SELECT *, CASE WHEN q THEN PERCENT_RANK() OVER (PARTITION BY season, q ORDER BY value_v3_psos NULLS LAST) END AS value_v3_psos_pct FROM (SELECT *, COALESCE(value_v3_psos IS NOT NULL AND games_played >= 10 AND mpg >= 10, false) AS q FROM t4))
    SELECT ext_pid, season, {', '.join(f'{rnd(c, 4)} AS {c}' for c in TIERS)} FROM t5"""


def c11_flags(spark: SparkSession, d: str) -> DataFrame:
    """C11: three-valued same-conference flag of games; teams divisible by 5 have no known conference."""
    t = _scores(spark, d).teams.withColumn("conference", F.when(F.col("team_id") % 5 != 0, F.col("conference")))
    return steps.same_conference(_games(spark, d), t).select("game_id", "is_conference")


SQL_C11 = "SELECT game_id, CASE WHEN h.c IS NULL THEN false ELSE h.c = a.c END AS is_conference FROM games LEFT JOIN (SELECT team_id, CASE WHEN team_id % 5 <> 0 THEN conference END AS c FROM teams) h ON h.team_id = home_team_id LEFT JOIN (SELECT team_id, CASE WHEN team_id % 5 <> 0 THEN conference END AS c FROM teams) a ON a.team_id = away_team_id"


def c07_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings passed through from several external rows a player."""
    a = _all(spark, d)
    ps = a["player_seasons"].select("player_id", "team_id", "season", "ppg", "apg", "mpg")
    ext = ps.select("player_id", "season", "mpg", F.col("team_id").alias("ext_pid"), F.when(F.col("team_id") % 3 != 0, F.col("ppg") * 9.0 + 7.0).alias("o_rtg"), (F.col("apg") * 8.0 + 71.0).alias("d_rtg"))
    ext = ext.unionByName(ext.withColumn("ext_pid", F.col("ext_pid") + 100).withColumn("mpg", F.col("mpg") - 1.0))
    return steps.pass_ratings(ps, ext)


SQL_C07 = f"SELECT p.player_id, p.team_id, p.season, ppg, apg, p.mpg, {rnd('o_rtg', 1)} AS offensive_rating, {rnd('d_rtg', 1)} AS defensive_rating, {rnd('(o_rtg - d_rtg)', 1)} AS net_rating FROM ps p LEFT JOIN (SELECT player_id, season, ppg * 9e0 + 7e0 AS o_rtg, apg * 8e0 + 71e0 AS d_rtg FROM ps WHERE team_id % 3 <> 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id, season ORDER BY mpg DESC NULLS LAST, team_id) = 1) x ON x.player_id = p.player_id AND x.season = p.season"


def c01_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Players of one team whose names agree in their last digit count as duplicates; facts move to the primary."""
    s = _scores(spark, d)
    people = s.players.withColumn("key", F.substring("name", -1, 1))
    facts = s.player_games.select("player_id", "game_id", "points")
    return upsert.merge_facts(facts, upsert.duplicates(people, facts, "player_id", ["key", "team_id"]), "player_id", ["game_id"])


SQL_C01 = "SELECT pid AS player_id, game_id, points FROM (SELECT COALESCE(prim, player_id) AS pid, game_id, points, ROW_NUMBER() OVER (PARTITION BY COALESCE(prim, player_id), game_id ORDER BY prim IS NOT NULL AND prim <> player_id, player_id) AS k FROM box LEFT JOIN (SELECT p.player_id, FIRST_VALUE(p.player_id) OVER (PARTITION BY right(name, 1), p.team_id ORDER BY COALESCE(n, 0) DESC, p.player_id) AS prim FROM players p LEFT JOIN (SELECT player_id, COUNT(*) AS n FROM box GROUP BY player_id) c ON c.player_id = p.player_id) USING (player_id)) WHERE k = 1"


def f11_expanding(spark: SparkSession, d: str) -> DataFrame:
    """Expanding means, cumulative sums, lag, running index and cumulative weighted means before each game."""
    pg = _all(spark, d)["player_games"].where("minutes > 0")
    by, order = ["player_id", "season"], ["game_date", "game_id"]
    return pg.select(
        "player_id", "season", "game_id", X.round_n(windows.expanding_mean("points", by, order), 6).alias("mean_points"), windows.cumulative("assists", by, order).alias("sum_assists"),
        F.lag("points", 1).over(windows.series(by, order)).alias("last_points"), windows.running_index(by, order).alias("game_no"), X.round_n(windows.cumulative_wavg("points", "minutes", by, order), 6).alias("wavg_points"),
    )


_P = "OVER (PARTITION BY player_id, season ORDER BY game_date, game_id"
_PP = f"{_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SQL_F11 = f"SELECT player_id, season, game_id, {rnd(f'AVG(points) {_PP}', 6)} AS mean_points, CAST(COALESCE(SUM(assists) {_PP}, 0) AS BIGINT) AS sum_assists, LAG(points) {_P}) AS last_points, ROW_NUMBER() {_P}) - 1 AS game_no, {rnd(div(f'SUM(points * minutes) {_PP}', f'SUM(minutes) {_PP}'), 6)} AS wavg_points FROM pg WHERE minutes > 0"


def t4_standouts(spark: SparkSession, d: str) -> DataFrame:
    """T4: games of 1.5 times the player's season mean in points and in game score."""
    pg = _all(spark, d)["player_games"].where("minutes > 0")
    w = windows.W.partitionBy("player_id", "season")
    m = pg.withColumn("mp", F.avg("points").over(w)).withColumn("mg", F.avg("game_score").over(w))
    return m.where((F.col("points") >= 1.5 * F.col("mp") + 1e-9) & (F.col("game_score") >= 1.5 * F.col("mg") + 1e-9)).select("player_id", "game_id", "points", "game_score")


SQL_T4 = "SELECT player_id, game_id, points, game_score FROM (SELECT *, AVG(points) OVER w AS mp, AVG(game_score) OVER w AS mg FROM pg WHERE minutes > 0 WINDOW w AS (PARTITION BY player_id, season)) WHERE points >= 1.5e0 * mp + 1e-9 AND game_score >= 1.5e0 * mg + 1e-9"


def t5_overlay(spark: SparkSession, d: str) -> DataFrame:
    """T5: rolling points of three players side by side by game number."""
    r = _all(spark, d)["rolling"].where("player_id IN (1, 2, 3) AND season = 1995")
    r = r.withColumn("game_no", windows.row_number(["player_id"], ["game_date", "game_id"]))
    return r.groupBy("game_no").pivot("player_id", [1, 2, 3]).agg(F.first("rolling_ppg")).select("game_no", *[F.col(str(i)).alias(f"p{i}") for i in (1, 2, 3)])


SQL_T5 = "SELECT k AS game_no, MAX(rolling_ppg) FILTER (WHERE player_id = 1) AS p1, MAX(rolling_ppg) FILTER (WHERE player_id = 2) AS p2, MAX(rolling_ppg) FILTER (WHERE player_id = 3) AS p3 FROM (SELECT player_id, rolling_ppg, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS k FROM roll WHERE player_id IN (1, 2, 3) AND season = 1995) GROUP BY k"


def n1_team_form(spark: SparkSession, d: str) -> DataFrame:
    """A team's season up to each game."""
    f = features.team_form(steps.estimate_rebounds(_scores(spark, d).team_games))
    return f.select("season", "team_id", "game_id", *[X.round_n(c, 6).alias(c) for c in features.TEAM])


def _form_sql(digits: int | None = None) -> str:
    """A team's season up to each game; rounded where digits are given."""
    w = "OVER (PARTITION BY team_id, season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    s = lambda c: f"CAST(SUM({c}) {w} AS DOUBLE)"
    n = lambda c: f"COALESCE(COUNT(*) FILTER (WHERE {c}) {w}, 0)"
    raw = ", ".join(f"{s(c)} AS {a}" for a, c in {"fga": "fga", "orb": "off_rebounds", "tov": "turnovers", "fta": "fta", "fgm": "fgm", "tpm": "tpm", "drb": "def_rebounds", "pts": "points", "ofga": "o_fga", "oorb": "o_orb", "otov": "o_tov", "ofta": "o_fta", "ofgm": "o_fgm", "otpm": "o_tpm", "odrb": "o_drb", "opts": "o_pts"}.items())
    wins = ", ".join(f"{n(c)} AS {a}" for a, c in {"wn": "points > o_pts", "ls": "points < o_pts", "rw": "points > o_pts AND NOT is_home", "rl": "points < o_pts AND NOT is_home"}.items())
    ps, op = "(fga - orb + tov + 0.44e0 * fta)", "(ofga - oorb + otov + 0.44e0 * ofta)"
    half = lambda a, b: f"(CASE WHEN {a} + {b} > 0 THEN CAST({a} AS DOUBLE) / ({a} + {b}) ELSE 0.5e0 END)"
    py = "COALESCE(pow(pts, 11.5e0) / NULLIF(pow(pts, 11.5e0) + pow(opts, 11.5e0), 0e0), 0.5e0)"
    out = {"win_pct": half("wn", "ls"), "road_win_pct": half("rw", "rl"), "pythag_win_pct": py, "point_diff": "pd", "adj_tempo": pos(f"(({ps} + COALESCE({op}, {ps})) / 2e0)", "games"), "effective_fg_pct": pos("(fgm + 0.5e0 * tpm)", "fga"), "turnover_pct": pos("tov", ps), "off_rebound_pct": pos("orb", "(orb + odrb)"), "ft_rate": pos("fta", "fga"), "opp_effective_fg_pct": pos("(ofgm + 0.5e0 * otpm)", "ofga"), "opp_turnover_pct": pos("otov", op), "def_rebound_pct": pos("drb", "(drb + oorb)"), "opp_ft_rate": pos("ofta", "ofga")}
    both = "SELECT t.*, o.points AS o_pts, o.fgm AS o_fgm, o.fga AS o_fga, o.tpm AS o_tpm, o.fta AS o_fta, o.off_rebounds AS o_orb, o.def_rebounds AS o_drb, o.turnovers AS o_tov FROM tg t LEFT JOIN tg o ON o.game_id = t.game_id AND o.team_id = t.opponent_id"
    return f"SELECT season, team_id, game_id, {', '.join(f'{rnd(e, digits) if digits else e} AS {c}' for c, e in out.items())} FROM (SELECT season, team_id, game_id, {raw}, {wins}, AVG(points - o_pts) {w} AS pd, CAST(COUNT(*) {w} AS DOUBLE) AS games FROM ({both}))"


def _impact(a: steps.Steps) -> DataFrame:
    """Composite rows with raw impact beside the tiers."""
    return steps.composite(_external(a)).withColumn("gbpm", F.col("ogbpm") + F.col("dgbpm")).withColumnRenamed("ext_pid", "player_id")


MIN_GAMES, MIN_MINUTES = 3, 8.0


def n2_roster(spark: SparkSession, d: str) -> DataFrame:
    """Weighted form of the players of each game, the most used one's, depth, recent form and trends."""
    a = _all(spark, d)
    f = features.roster(a["rolling"], MIN_GAMES, MIN_MINUTES, features.impact_of(_impact(a)))
    return f.select("season", "team_id", "game_id", "roster_size", *[X.round_n(c, 6).alias(c) for c in features.ROSTER if c != "roster_size"])


def _roster_sql() -> str:
    """CTEs; the last is `people` (season, team_id, game_id, features.ROSTER...)."""
    line = "OVER (PARTITION BY player_id, team_id, season ORDER BY game_date, game_id"
    w = f"{line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    n = lambda c: f"CAST({c} AS DOUBLE)"
    fifth, plays, team_plays = f"(COALESCE({n('team_minutes')}, 200e0) / 5e0)", "(fga + 0.44e0 * fta + turnovers)", "(team_fga + 0.44e0 * team_fta + team_turnovers)"
    rates = {
        "ts_g": pos("points", "(2e0 * (fga + 0.44e0 * fta))"), "efg_g": pos("(fgm + 0.5e0 * tpm)", "fga"), "ortg_g": f"{n('points')} / greatest(fga - off_rebounds + turnovers + 0.44e0 * fta, 0.1e0) * 100e0",
        "usage_g": f"CASE WHEN {team_plays} > 0 THEN {plays} * {fifth} / (minutes * {team_plays}) END", "ast_g": pos("assists", f"(minutes / {fifth} * team_fgm - fgm)"), "tov_g": pos("turnovers", plays), "stl_g": f"{n('steals')} / (minutes / 40e0)", "blk_g": f"{n('blocks')} / (minutes / 40e0)",
    }
    mean = lambda c: f"CAST(SUM(CAST({c} AS DECIMAL(18,9))) {w} AS DOUBLE) / NULLIF(CAST(COUNT({c}) {w} AS DOUBLE), 0e0)"
    means = ", ".join(f"{mean(c)} AS {a}" for a, c in [*features.MEANS.items(), ("gs", "game_score")])
    total = lambda c: f"CAST(SUM(CAST({c} * wt AS DECIMAL(28,9))) AS DOUBLE)"
    every = ", ".join(f"COALESCE({total(c)} / SUM(wt), 0e0) AS {a}" for a, c in [*((a, a) for a in features.MEANS), *((f"w_{c}", c) for c in features.IMPACT)])
    stars = ", ".join(f"CAST(first(CAST({c} AS DOUBLE) ORDER BY wt DESC, player_id) AS DOUBLE) AS {a}" for a, c in [("star_ppg", "w_ppg"), *((f"star_{c}", c) for c in features.IMPACT), ("star_ortg", "w_ortg")])
    known = ", ".join(f"{total(c)} / SUM(CASE WHEN {c} IS NOT NULL THEN wt END) AS {c}" for c in ("w_rolling_gs", "w_rolling_ts", "w_ppg_trend", "w_gs_trend"))
    return ",\n".join([
        f"rt AS (SELECT *, {', '.join(f'{e} AS {a}' for a, e in rates.items())} FROM roll)",
        f"cum AS MATERIALIZED (SELECT season, team_id, game_id, player_id, COUNT(*) {w} AS g, SUM(minutes) {w} AS wt, {means}, LAG(rolling_ppg) {line}) AS r_ppg, LAG(rolling_game_score) {line}) AS w_rolling_gs, LAG(rolling_ts_pct) {line}) AS w_rolling_ts FROM rt)",
        "imp AS (SELECT ext_pid AS player_id, season, ogbpm + dgbpm AS gbpm, ogbpm, dgbpm FROM ext)",
        f"people AS MATERIALIZED (SELECT season, team_id, game_id, COUNT(*) AS roster_size, {every}, {stars}, stddev_samp(mpg) AS minutes_stddev, {known} FROM (SELECT cum.*, gbpm, ogbpm, dgbpm, wt / g AS mpg, r_ppg - w_ppg AS w_ppg_trend, w_rolling_gs - gs AS w_gs_trend FROM cum LEFT JOIN imp USING (player_id, season) WHERE g >= {MIN_GAMES} AND wt / g >= {MIN_MINUTES}) GROUP BY season, team_id, game_id)",
    ])


def _n2_sql() -> str:
    return f"WITH {chain()},\n{ROLL},\n{EXT},\n{_roster_sql()}\nSELECT season, team_id, game_id, roster_size, " + ", ".join(f"{rnd(c, 6)} AS {c}" for c in features.ROSTER if c != "roster_size") + " FROM people"


def _matrix(spark: SparkSession, d: str, fill: bool = False) -> DataFrame:
    a = _all(spark, d)
    return features.matrix(_games(spark, d, a.scores), a["rolling"], a["team_games"], a.scores.teams, _snapshots(a["team_games"]), _impact(a), fill=fill, min_games=MIN_GAMES, min_minutes=MIN_MINUTES)


def n8_matchups(spark: SparkSession, d: str) -> DataFrame:
    """The whole matrix, with as-of ratings, Elo, schedules met and impact."""
    m = _matrix(spark, d)
    return m.select("season", "game_id", F.col("venue").cast("long").alias("venue"), F.col("is_conference_game").cast("long").alias("is_conference_game"), *[X.round_n(f"diff_{c}", 4).alias(f"diff_{c}") for c in features.NAMES], "margin", F.col("home_win").cast("long").alias("home_win"))


def _n8_sql() -> str:
    side = {**{c: f"{{s}}_f.{c}" for c in features.TEAM}, "adj_offense": "{s}_r.o", "adj_defense": "{s}_r.d", "adj_efficiency_margin": "({s}_r.o - {s}_r.d)", "sos": "{s}_r.sos", "elo": "e.e{s}", **{c: f"{{s}}_p.{c}" for c in features.ROSTER}, "w_player_sos": "{s}_t.w_player_sos"}
    gap = lambda c: rnd(f"({'-' if c in features.LOWER_IS_BETTER else ''}(CAST({side[c].format(s='h')} AS DOUBLE) - CAST({side[c].format(s='a')} AS DOUBLE)))", 4)
    w = "OVER (PARTITION BY player_id, season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    met = ",\n".join([
        f"form AS MATERIALIZED ({_form_sql()})",
        "met AS (SELECT p.player_id, p.season, p.game_id, p.team_id, p.game_date, p.minutes, s.o - s.d AS mg FROM pg p ASOF LEFT JOIN snap s ON s.team_id = p.opponent_id AND p.game_date >= s.as_of WHERE p.minutes > 0)",
        f"psm AS (SELECT season, team_id, game_id, minutes, CAST(SUM(CAST(COALESCE(mg, 0e0) * minutes AS DECIMAL(28,9))) {w} AS DOUBLE) / NULLIF(SUM(minutes) {w}, 0e0) AS cs FROM met)",
        "tsos AS (SELECT season, team_id, game_id, CAST(SUM(CAST(COALESCE(cs, 0e0) * minutes AS DECIMAL(28,9))) AS DOUBLE) / SUM(minutes) AS w_player_sos FROM psm GROUP BY ALL)",
        "gr AS (SELECT g.*, h.conference AS hc, a.conference AS ac FROM games g JOIN teams h ON h.team_id = home_team_id JOIN teams a ON a.team_id = away_team_id)",
        "before AS (SELECT g.game_id, t.team_id, MAX(s.as_of) AS as_of FROM games g JOIN (SELECT DISTINCT team_id FROM snap) t ON t.team_id IN (g.home_team_id, g.away_team_id) JOIN snap s ON s.team_id = t.team_id AND s.as_of < g.game_date GROUP BY ALL)",
    ])
    joined = "FROM gr g LEFT JOIN elo e ON e.game_id = g.game_id AND e.season = g.season"
    for s, key in (("h", "home_team_id"), ("a", "away_team_id")):
        joined += f" LEFT JOIN form {s}_f ON {s}_f.game_id = g.game_id AND {s}_f.team_id = g.{key} LEFT JOIN people {s}_p ON {s}_p.game_id = g.game_id AND {s}_p.team_id = g.{key} LEFT JOIN tsos {s}_t ON {s}_t.game_id = g.game_id AND {s}_t.team_id = g.{key} LEFT JOIN before {s}_b ON {s}_b.game_id = g.game_id AND {s}_b.team_id = g.{key} LEFT JOIN snap {s}_r ON {s}_r.team_id = g.{key} AND {s}_r.as_of = {s}_b.as_of"
    head = f"WITH RECURSIVE {chain()},\n{GAMES_SQL}\n{SQL_K3},\n{ROLL},\n{EXT},\n{_roster_sql()},\n{_snap_sql()},\n{met}"
    return f"{head}\nSELECT g.season, g.game_id, CAST(CASE WHEN is_neutral_site THEN 0 ELSE 1 END AS BIGINT) AS venue, CAST(COALESCE(hc = ac, false) AS BIGINT) AS is_conference_game, " + ", ".join(f"{gap(c)} AS diff_{c}" for c in features.NAMES) + f", home_score - away_score AS margin, CAST(home_score > away_score AS BIGINT) AS home_win {joined}"


def n10_variants(spark: SparkSession, d: str) -> DataFrame:
    """Impact columns of the composite by variant, under the same names."""
    a = _all(spark, d)
    ext = stored(_impact(a), "impact")
    rows = [features.impact_of(ext, v).select(F.lit(v).alias("variant"), "player_id", "season", *[X.round_n(c, 4).alias(c) for c in features.IMPACT]) for v in features.VARIANTS]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _n10_sql() -> str:
    body = _c09_sql()
    head, tail = body[: body.rindex("SELECT ext_pid")], ""
    for v, cols in features.VARIANTS.items():
        cols = [{"gbpm": "(ogbpm + dgbpm)"}.get(c, c) for c in cols]
        tail += f"{' UNION ALL ' if tail else ''}SELECT '{v}' AS variant, ext_pid AS player_id, season, " + ", ".join(f"{rnd(c, 4)} AS {n}" for c, n in zip(cols, features.IMPACT, strict=True)) + " FROM t5"
    return head + tail


def o_models(spark: SparkSession, d: str) -> DataFrame:
    """Margin and win models over the whole matrix, trained on the first four fifths by day and applied to the rest (no oracle: trained)."""
    m = _matrix(spark, d, fill=True)
    m = stored(m.withColumn("margin", F.col("margin").cast("double")).withColumn("home_win", F.col("home_win").cast("double")).dropna(subset=["margin"]), "matrix")
    first, rest = models.chronological(m, "game_date", "game_id")
    fitted = models.train(first, features.FEATURES, "margin", "home_win")
    return models.predict(rest, fitted).select("season", "game_id", "margin", "pred_margin", "pred_win", "home_wins")


def o_leafwise(spark: SparkSession, d: str) -> DataFrame:
    """O1, O2 with leaf-wise trees: the last fifth of the first four fifths by day stops the rounds, the models are applied to the rest (no oracle: trained)."""
    m = _matrix(spark, d, fill=True)
    m = stored(m.withColumn("margin", F.col("margin").cast("double")).withColumn("home_win", F.col("home_win").cast("double")).dropna(subset=["margin"]), "matrix")
    first, rest = models.chronological(m, "game_date", "game_id")
    fitted = models.train_leafwise(first, features.FEATURES, "margin", "home_win", "game_date", "game_id", boosting.Growth(rounds=8, leaves=8, rate=0.25, bins=32, patience=4))
    return models.predict_leafwise(rest, fitted).select("season", "game_id", "margin", "pred_margin", "pred_win", "home_wins")


def q19_predict(spark: SparkSession, d: str) -> DataFrame:
    """Q19: matchups asked for by name: teams found as in Q20, features as of the day, models, winner (no oracle: trained)."""
    a = _all(spark, d)
    names = joins.prefix_index(a.scores.teams, "name", ["team_id", "name"])
    asked = spark.createDataFrame([("q1", "NATION_1", "nation_2", False), ("q2", "NATION_3", "NATION_4", True), ("q3", "nobody", "NATION_4", False)], "game_id string, home string, away string, is_neutral_site boolean")
    found = asked
    for side in ("home", "away"):
        found = joins.lookup_by_prefix(found, side, names.toDF("prefix", f"{side}_team_id", f"{side}_name"))
    last = a["team_games"].agg(F.max("season").alias("season"), F.date_add(F.max("game_date"), 1).alias("game_date"))
    found = stored(found.crossJoin(last).select("game_id", "season", "game_date", "home_team_id", "away_team_id", "is_neutral_site", "home_name", "away_name"), "asked")
    games, pg, tg = features.with_matchups(found.drop("home_name", "away_name"), _games(spark, d, a.scores), a["player_games"].withColumn("played", F.lit(True)), a["team_games"])
    # what is asked comes after all that was played, so recent form is found with it in one pass; rows of it have none
    pg = steps.rolling(pg).select(*[F.when(F.col("played"), F.col(c)).alias(c) if c.startswith("rolling_") else F.col(c) for c in a["rolling"].columns if c != "played"])
    snap = _snapshots(a["team_games"])
    m = stored(features.matrix(games, pg, tg, a.scores.teams, snap, _impact(a), fill=True, min_games=MIN_GAMES, min_minutes=MIN_MINUTES), "matrix")
    past = m.where("margin IS NOT NULL").withColumn("margin", F.col("margin").cast("double")).withColumn("home_win", F.col("home_win").cast("double"))
    fitted = models.train(past, features.FEATURES, "margin", "home_win")
    out = models.predict(m.join(found.select("game_id", "home_name", "away_name"), "game_id"), fitted)
    return out.select("game_id", "home_name", "away_name", "pred_margin", "pred_win", F.when(F.col("home_wins"), F.col("home_name")).otherwise(F.col("away_name")).alias("winner"))


QUERIES = {
    "q01_rankings": (q01_rankings, lambda: sql(SQL_Q01)),
    "q02_profile_ranks_include_nulls": (q02_profile, lambda: sql(SQL_Q02)),
    "q03_schedule": (q03_schedule, lambda: gsql(SQL_Q03)),
    "q04_roster": (q04_roster, lambda: psql(SQL_Q04)),
    "q05_search_page": (q05_search_page, lambda: sql(SQL_Q05)),
    "q05_search_total": (q05_search_total, lambda: sql(SQL_Q05T)),
    "q06_player_profile": (q06_player_profile, lambda: sql(SQL_Q06)),
    "q07_c04_player_seasons": (q07_player_seasons, lambda: sql("SELECT * FROM ps")),
    "q08_c13_percentiles": (q08_percentiles, lambda: psql(SQL_Q08)),
    "q09_c10_game_log_rolling": (q09_game_log, lambda: psql(SQL_Q09)),
    "q10_league_averages": (q10_league_averages, lambda: sql(SQL_Q10)),
    "q11_masked_percentiles": (q11_masked_percentiles, lambda: sql(SQL_Q11)),
    "q12_games_filtered": (q12_games, lambda: gsql(SQL_Q12)),
    "q20_team_lookup": (q20_team_lookup, lambda: sql(SQL_Q20)),
    "c01_dedup": (c01_dedup, lambda: sql(SQL_C01)),
    "c02_player_games": (c02_player_games, lambda: sql(SQL_C02)),
    "c03_opponent_fill": (c03_rebounds, lambda: sql(SQL_C03)),
    "c05_four_factors": (c05_four_factors, lambda: sql("SELECT * FROM ts0")),
    "c07_ratings_passthrough": (c07_ratings, lambda: sql(SQL_C07)),
    "c08_weighted_sos": (c08_player_sos, lambda: sql("SELECT * FROM psos")),
    "c09_composite_tiers": (c09_composite, _c09_sql),
    "c11_three_valued_flag": (c11_flags, lambda: gsql(SQL_C11)),
    "c12_schedules": (c12_schedules, lambda: gsql(SQL_C12)),
    "k1_adjusted_rating": (k1_adjusted, lambda: sql(SQL_K1)),
    "k1_adjusted_by_joins": (k1_by_joins, lambda: sql(SQL_K1)),
    "k2_rating_by_date": (k2_by_date, lambda: f"WITH {chain()}, {_snap_sql()}\n{SQL_K2}"),
    "k3_elo": (k3_elo, lambda: rsql(SQL_K3_OUT)),
    "n1_team_form": (n1_team_form, lambda: sql(_form_sql(6))),
    "n2_n3_roster_form": (n2_roster, _n2_sql),
    "n8_matchup_features": (n8_matchups, _n8_sql),
    "n10_impact_variants": (n10_variants, _n10_sql),
    "o1_o2_models": (o_models, None),
    "o1_o2_leafwise": (o_leafwise, None),
    "q19_predict": (q19_predict, None),
    "f11_f15_expanding_prior": (f11_expanding, lambda: sql(SQL_F11)),
    "t4_standouts": (t4_standouts, lambda: sql(SQL_T4)),
    "t5_overlay": (t5_overlay, lambda: psql(SQL_T5)),
}
