"""Checked read queries: searches, ranks and comparisons over all fields, and steps of the ingest, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import exprs as X
from lakeloom.operators import joins, upsert
from lakeloom.plans import checked_box as B
from lakeloom.plans import reads, steps
from lakeloom.sources import readers

CLASSES = ("Wing", "Guard", "Big")


def _view(a: steps.Steps) -> DataFrame:
    s = a.scores
    ps = a["player_seasons"]
    ext = ps.select("player_id", "season", "mpg", F.col("team_id").alias("ext_pid"), F.when(F.col("team_id") % 3 != 0, F.col("ppg") * 9.0 + 7.0).alias("o_rtg"), (F.col("apg") * 8.0 + 71.0).alias("d_rtg"))
    tiers = steps.composite(B._external(a)).select(F.col("ext_pid").alias("player_id"), "season", F.col("value_v3_psos").alias("composite"), F.col("value_v3_psos_pct").alias("composite_pct"))
    kind = lambda k: F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (k % 3 + 1).cast("int"))
    classes = s.players.select("player_id").crossJoin(ps.select("season").distinct()).select("player_id", "season", kind(F.col("player_id")).alias("primary"), F.when(F.col("player_id") % 2 == 0, kind(F.col("player_id") + 1)).alias("secondary"))
    return reads.player_view(steps.pass_ratings(ps, ext), s.players, s.teams, tiers, a["percentiles"].select("player_id", "season", F.col("ppg_pct"), F.col("usage_rate_pct")), classes)


def _view_sql() -> str:
    """CTEs; the last is `view`."""
    body = B._c09_sql()
    head = body[: body.rindex("SELECT ext_pid")].rstrip()
    kind = lambda k: f"CASE {k} % 3 WHEN 0 THEN '{CLASSES[0]}' WHEN 1 THEN '{CLASSES[1]}' ELSE '{CLASSES[2]}' END"
    rtg = f"rtg AS (SELECT player_id, season, {B.rnd('(ppg * 9e0 + 7e0)', 1)} AS offensive_rating, {B.rnd('(apg * 8e0 + 71e0)', 1)} AS defensive_rating, {B.rnd('((ppg * 9e0 + 7e0) - (apg * 8e0 + 71e0))', 1)} AS net_rating FROM ps WHERE team_id % 3 <> 0 AND ppg IS NOT NULL AND apg IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id, season ORDER BY mpg DESC NULLS LAST, team_id) = 1)"
    view = f"view AS (SELECT ps.*, p.name, t.name AS team, t.conference, offensive_rating, defensive_rating, net_rating, value_v3_psos AS composite, value_v3_psos_pct AS composite_pct, ppg_pct, usage_rate_pct, {kind('player_id')} AS \"primary\", CASE WHEN player_id % 2 = 0 THEN {kind('(player_id + 1)')} END AS secondary FROM ps JOIN players p USING (player_id) LEFT JOIN teams t ON t.team_id = ps.team_id LEFT JOIN rtg USING (player_id, season) LEFT JOIN (SELECT ext_pid AS player_id, season, value_v3_psos, value_v3_psos_pct FROM t5) USING (player_id, season) LEFT JOIN pct USING (player_id, season))"
    return f"{head},\n{B.ROLL},\n{B.PCT},\n{rtg},\n{view}"


#: Searches: season, name, team, class, whether the second class counts, field, descending, limit, offset.
SEARCHES = [(1995, None, None, None, False, f, i % 3 > 0, 4, i % 2) for i, f in enumerate(reads.SORTS)] + [(1996, "1", None, "Wing", False, "composite", True, 20, 0), (1996, "1", None, "Wing", True, "net_rating", False, 20, 2), (1997, None, 7, None, False, "ppg", True, 50, 0), (1994, "00", 3, "Big", True, "ft_rate", False, 50, 0)]
SHOWN = ["player_id", "team_id", "name", "team", "conference", "season", "games_played", "primary", "secondary"]
NUMBERS = [c for c in reads.SORTS if c != "games_played"] + ["composite_pct", "ppg_pct", "usage_rate_pct"]


def q05_all_searches(spark: SparkSession, d: str) -> DataFrame:
    """Q05 and G1: a search by each of the 22 fields in either direction, and some with all conditions; each with its total."""
    view = B.stored(_view(B._all(spark, d)), "view")
    out = None
    for k, (season, name, team, kind, second, field, down, limit, offset) in enumerate(SEARCHES):
        found = reads.search_players(view, season, name, team, kind, second)
        total = found.agg(F.count("*").alias("total"))
        rows = reads.search_page(found, field, down, limit, offset).crossJoin(F.broadcast(total)).select(F.lit(k).alias("page"), "total", *SHOWN, *[X.round_n(c, 4).alias(c) for c in NUMBERS])
        out = rows if out is None else out.unionByName(rows)
    return out


def _q05_sql() -> str:
    parts = []
    for k, (season, name, team, kind, second, field, down, limit, offset) in enumerate(SEARCHES):
        where = f"season = {season} AND games_played >= 5 AND mpg >= 10"
        where += f" AND name ILIKE '%{name}%'" if name is not None else ""
        where += f" AND team_id = {team}" if team is not None else ""
        where += (f" AND (\"primary\" = '{kind}' OR secondary = '{kind}')" if second else f" AND \"primary\" = '{kind}'") if kind else ""
        shown = ", ".join(f'"{c}"' for c in SHOWN)
        parts.append(f"(SELECT CAST({k} AS INTEGER) AS page, (SELECT COUNT(*) FROM view WHERE {where}) AS total, {shown}, {', '.join(f'{B.rnd(c, 4)} AS {c}' for c in NUMBERS)} FROM view WHERE {where} ORDER BY view.{field} {'DESC' if down else 'ASC'} NULLS LAST, player_id, team_id LIMIT {limit} OFFSET {offset})")
    return f"{_view_sql()}\n" + "\nUNION ALL ".join(parts)


def _season_rows(a: steps.Steps) -> DataFrame:
    """External season rows with zones, drawn from season statistics."""
    ps = a["player_seasons"]
    c = F.col
    n = lambda k: (c("player_id") * k + c("season")) % 13
    zone = lambda tries: F.when(tries > 0, ((c("player_id") * 7 + tries) % 10).cast("double") / 10)
    rim, mid, dunk, three = n(3), n(5), F.when(c("player_id") % 4 == 0, F.lit(None)).otherwise(n(2)), n(11)
    return ps.select(
        c("player_id").alias("ext_pid"), "season", "games_played", "mpg", (c("ppg") - 9.0 + c("rpg") - 6.0).alias("gbpm"), (c("ppg") - 9.0).alias("ogbpm"), (c("rpg") - 6.0).alias("dgbpm"), (c("ppg") * 9.0).alias("adj_oe"), (c("apg") * 8.0).alias("adj_de"),
        "orb_pct", "drb_pct", "stl_pct", "blk_pct", "ft_rate", c("fpg").alias("personal_foul_rate"), rim.alias("rim_attempted"), zone(rim).alias("rim_pct"), mid.alias("mid_attempted"), zone(mid).alias("mid_pct"),
        dunk.alias("dunks_attempted"), zone(dunk).alias("dunk_pct"), three.alias("tpa"), zone(three).alias("tp_pct"), n(4).alias("fta"), F.least(n(4), n(6)).alias("ftm"),
    )


def _season_sql() -> str:
    n = lambda k: f"((player_id * {k} + season) % 13)"
    zone = lambda t: f"CASE WHEN {t} > 0 THEN CAST((player_id * 7 + {t}) % 10 AS DOUBLE) / 10 END"
    dunk = f"CASE WHEN player_id % 4 = 0 THEN NULL ELSE {n(2)} END"
    return f"sr AS MATERIALIZED (SELECT player_id AS ext_pid, season, games_played, mpg, ppg - 9e0 + rpg - 6e0 AS gbpm, ppg - 9e0 AS ogbpm, rpg - 6e0 AS dgbpm, ppg * 9e0 AS adj_oe, apg * 8e0 AS adj_de, orb_pct, drb_pct, stl_pct, blk_pct, ft_rate, fpg AS personal_foul_rate, {n(3)} AS rim_attempted, {zone(n(3))} AS rim_pct, {n(5)} AS mid_attempted, {zone(n(5))} AS mid_pct, {dunk} AS dunks_attempted, {zone(dunk)} AS dunk_pct, {n(11)} AS tpa, {zone(n(11))} AS tp_pct, {n(4)} AS fta, least({n(4)}, {n(6)}) AS ftm FROM ps)"


def q11_external_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Q11: eleven plain percentiles and four of zones, the latter among those with attempts."""
    r = reads.external_ranks(_season_rows(B._all(spark, d)))
    return r.select("ext_pid", "season", *[X.round_n(f"{c}_pctile", 6).alias(f"{c}_pctile") for c in [*reads.PLAIN, *reads.ZONES]])


def _q11_select() -> str:
    plain = ", ".join(f"PERCENT_RANK() OVER (PARTITION BY season ORDER BY {c} {'ASC NULLS LAST' if up else 'DESC NULLS FIRST'}) AS {c}_p" for c, up in reads.PLAIN.items())
    zones = ", ".join(f"CASE WHEN {t} > 0 THEN PERCENT_RANK() OVER (PARTITION BY season, COALESCE({t} > 0, false) ORDER BY {c} NULLS LAST) END AS {c}_p" for c, t in reads.ZONES.items())
    return f"SELECT ext_pid, season, {', '.join(f'{B.rnd(c + chr(95) + chr(112), 6)} AS {c}_pctile' for c in [*reads.PLAIN, *reads.ZONES])} FROM (SELECT ext_pid, season, {plain}, {zones} FROM sr WHERE games_played >= 10 AND mpg >= 10)"


def _q11_sql() -> str:
    return B.sql(_q11_select()).replace("\nSELECT ext_pid", f",\n{_season_sql()}\nSELECT ext_pid", 1)


def t7_shot_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of shots by zone."""
    r = reads.shot_shares(_season_rows(B._all(spark, d)))
    return r.select("ext_pid", "season", *[X.round_n(c, 6).alias(c) for c in r.columns[2:]])


def _t7_sql() -> str:
    total = "(COALESCE(rim_attempted, 0) + COALESCE(mid_attempted, 0) + COALESCE(tpa, 0))"
    cols = {f"{n}_share": B.pos(f"COALESCE({c}, 0)", total) for n, c in (("rim", "rim_attempted"), ("mid", "mid_attempted"), ("three", "tpa"))} | {f"{n}_made_pct": f"({c} * 100)" for n, c in (("rim", "rim_pct"), ("mid", "mid_pct"), ("three", "tp_pct"))} | {"ft_made_pct": f"({B.pos('ftm', 'fta')} * 100)"}
    return f"WITH {B.chain()},\n{_season_sql()}\nSELECT ext_pid, season, {', '.join(f'{B.rnd(e, 6)} AS {n}' for n, e in cols.items())} FROM sr"


def _classes(a: steps.Steps) -> DataFrame:
    """Classes with scores; a player may have several rows a season."""
    kind = lambda k: F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (k % 3 + 1).cast("int"))
    c = F.col
    rows = a["player_lines"].select("player_id", "season").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    score = lambda m: ((c("player_id") * m + c("season") + c("k")) % 10).cast("double") / 10
    return rows.select("player_id", "season", kind(c("player_id") + c("k")).alias("primary"), F.when(c("player_id") % 2 == 0, kind(c("player_id") + c("k") + 1)).alias("secondary"), score(7).alias("primary_score"), score(3).alias("secondary_score"))


def q13_archetype(spark: SparkSession, d: str) -> DataFrame:
    """Q13: the classes of every player of a season, one row each."""
    return reads.archetype(_classes(B._all(spark, d)), 1995).select("player_id", "season", "primary", "secondary", "primary_score", "secondary_score")


def _q13_sql() -> str:
    kind = lambda k: f"CASE {k} % 3 WHEN 0 THEN '{CLASSES[0]}' WHEN 1 THEN '{CLASSES[1]}' ELSE '{CLASSES[2]}' END"
    score = lambda m: f"CAST((player_id * {m} + season + k) % 10 AS DOUBLE) / 10"
    rows = f'SELECT player_id, season, {kind("(player_id + k)")} AS "primary", CASE WHEN player_id % 2 = 0 THEN {kind("(player_id + k + 1)")} END AS secondary, {score(7)} AS primary_score, {score(3)} AS secondary_score FROM (SELECT DISTINCT player_id, season FROM ps), (VALUES (0), (1)) t(k)'
    return B.sql(f'SELECT * FROM ({rows}) WHERE season = 1995 QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id, season ORDER BY primary_score DESC NULLS LAST, "primary") = 1')


EXTERNAL = [f"{c}_pctile" for c in [*reads.PLAIN, *reads.ZONES]]


def q18_compare(spark: SparkSession, d: str) -> DataFrame:
    """Q18: up to four players side by side, all that is known of them: season rows, percentiles, game logs, external ranks, classes, league averages."""
    a = B._all(spark, d)
    r = reads.compare([1, 2, 10**9, 3], _view(a), a["rolling"], reads.external_ranks(_season_rows(a)), B.q10_league_averages(spark, d))
    recent = F.array_join(F.transform("recent", lambda g: F.concat_ws("/", g["game_id"], g["points"].cast("string"))), ";")
    return r.select(*SHOWN, *[X.round_n(c, 4).alias(c) for c in NUMBERS], *[X.round_n(c, 6).alias(c) for c in EXTERNAL], "avg_ppg", "avg_game_score", recent.alias("recent"))


def _q18_sql() -> str:
    shown = ", ".join(f'view."{c}"' for c in SHOWN)
    log = "SELECT player_id, season, string_agg(concat_ws('/', game_id, CAST(points AS VARCHAR)), ';' ORDER BY game_date, game_id) AS recent FROM roll WHERE player_id IN (1, 2, 3) GROUP BY ALL"
    ctes = f"{_view_sql()},\n{_season_sql()},\nex AS ({_q11_select()}),\nla AS ({B.SQL_Q10})"
    return f"{ctes}\nSELECT {shown}, {', '.join(f'{B.rnd(c, 4)} AS {c}' for c in NUMBERS)}, {', '.join(EXTERNAL)}, avg_ppg, avg_game_score, recent FROM view LEFT JOIN ({log}) USING (player_id, season) LEFT JOIN (SELECT ext_pid AS player_id, * EXCLUDE ext_pid FROM ex) USING (player_id, season) LEFT JOIN la USING (season) WHERE player_id IN (1, 2, 3)"


def d12_rebound_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Rebounds of a feed, found by normalised name and day, put where they are missing or 0; a name may stand for several players."""
    s = B._scores(spark, d)
    pg = s.player_games.join(s.players.select("player_id", "name"), "player_id")
    feed = pg.where("player_id % 3 <> 0").groupBy(F.concat(F.upper("name"), F.lit(" Jr.")).alias("feed_name"), F.col("game_date").alias("feed_day")).agg(F.max("off_rebounds").alias("oreb"), F.max(F.when(F.col("steals") > 0, F.col("steals"))).alias("dreb"))
    out = joins.backfill_rebounds(pg, feed, "name", "game_date", "feed_name", "feed_day")
    return out.select("player_id", "game_id", "off_rebounds", "def_rebounds", "total_rebounds")


SQL_D12 = "SELECT p.player_id, p.game_id, CASE WHEN hit THEN oreb ELSE p.off_rebounds END AS off_rebounds, CASE WHEN hit THEN dreb ELSE p.def_rebounds END AS def_rebounds, CASE WHEN hit THEN oreb + dreb ELSE p.total_rebounds END AS total_rebounds FROM (SELECT b.*, oreb, dreb, f.oreb IS NOT NULL AND f.dreb IS NOT NULL AND COALESCE(b.total_rebounds, 0) = 0 AS hit FROM (SELECT pg0.*, name FROM pg0 JOIN players USING (player_id)) b LEFT JOIN (SELECT lower(name) AS k, game_date, MAX(off_rebounds) AS oreb, MAX(CASE WHEN steals > 0 THEN steals END) AS dreb FROM pg0 JOIN players USING (player_id) WHERE player_id % 3 <> 0 GROUP BY ALL) f ON f.k = lower(b.name) AND f.game_date = b.game_date) p"


def j9_resolvable(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose game and team are known; the others are left out."""
    s = B._scores(spark, d)
    games = s.team_games.where("season <> 1996").select("game_id").distinct()
    return upsert.resolvable(s.player_games.select("player_id", "team_id", "game_id", "points"), {"game_id": games, "team_id": s.teams.where("team_id % 6 <> 0").select("team_id")})


SQL_J9 = "SELECT player_id, team_id, game_id, points FROM pg0 WHERE season <> 1996 AND team_id % 6 <> 0"


def a6_payload_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of payloads whose first key may be a warning or other metadata."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    body = F.concat(F.lit('[{"id":"'), F.col("s_name"), F.lit('"},{"id":"x"}]'))
    first = F.when(F.col("s_suppkey") % 3 == 0, F.lit('"warnings":["late"],')).when(F.col("s_suppkey") % 3 == 1, F.lit('"success":"1","meta":{"a":1},')).otherwise(F.lit(""))
    rows = s.withColumn("payload", F.concat(F.lit("{"), first, F.lit('"credits":'), body, F.lit("}")))
    return readers.payload_rows(rows, "payload", "struct<id:string>").select("s_suppkey", F.col("row.id").alias("id"))


SQL_A6 = "SELECT s_suppkey, s_name AS id FROM supplier UNION ALL SELECT s_suppkey, 'x' FROM supplier"


def b13_floats(spark: SparkSession, d: str) -> DataFrame:
    """Features in single precision, as models take them."""
    ts = B._all(spark, d)["team_seasons"]
    return ts.select("team_id", "season", *[X.single(c).cast("double").alias(c) for c in ("adj_offense", "effective_fg_pct", "sos")])


SQL_B13 = "SELECT team_id, season, " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in ("adj_offense", "effective_fg_pct", "sos")) + " FROM ts"

QUERIES = {
    "q05_all_searches": (q05_all_searches, _q05_sql),
    "q11_external_ranks": (q11_external_ranks, _q11_sql),
    "q13_archetype": (q13_archetype, _q13_sql),
    "q18_compare": (q18_compare, _q18_sql),
    "t7_shot_shares": (t7_shot_shares, _t7_sql),
    "d12_rebound_backfill": (d12_rebound_backfill, lambda: B.sql(SQL_D12)),
    "j9_resolvable": (j9_resolvable, lambda: B.sql(SQL_J9)),
    "a6_payload_rows": (a6_payload_rows, lambda: SQL_A6),
    "b13_single_precision": (b13_floats, lambda: B.sql(SQL_B13)),
}
