"""The batch steps: pure functions from box-score frames to frames, all seasons at once (season is a grouping key everywhere).

Order: fill_player_games, estimate_rebounds, player_seasons, team_seasons, adjusted ratings, player_sos, composite, rolling, percentiles;
schedules and derived game fields stand apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions import exprs as X
from lakeloom.operators import joins, ratings, upsert, windows
from lakeloom.sources.tables import stored

GAME_ORDER = ("game_date", "game_id")
#: How rows of rolling() are dealt, by range: a player's season is in one task, and sums by team and game after it have few rows a task to shuffle.
DEALT = ("season", "team_id", "player_id")


def fill_player_games(pg: DataFrame) -> DataFrame:
    """Adds ast_to_ratio and game_score, mends rebounds; each only where it is missing.

    Totals of 0 are taken for unrecorded in games in which some row has offensive rebounds but no total. Rows that say so in `fake` are not joined to them.
    """
    out = pg
    if "fake" not in pg.columns:
        fake = pg.where("total_rebounds IS NULL AND off_rebounds > 0").select(F.col("game_id").alias("__g")).distinct().withColumn("fake", F.lit(True))
        out = pg.join(fake, F.col("game_id") == F.col("__g"), "left")
    hide = F.coalesce("fake", F.lit(False)) & (F.col("total_rebounds") == 0)
    out = out.withColumn("def_rebounds", F.when(~F.coalesce(hide, F.lit(False)), F.col("def_rebounds"))).withColumn("total_rebounds", F.when(~F.coalesce(hide, F.lit(False)), F.col("total_rebounds")))
    derived = F.when(F.col("total_rebounds") >= F.col("off_rebounds"), F.col("total_rebounds") - F.col("off_rebounds"))
    out = out.withColumn("def_rebounds", F.coalesce("def_rebounds", derived))
    given = {c: F.col(c) if c in pg.columns else F.lit(None).cast("double") for c in ("ast_to_ratio", "game_score")}
    out = out.withColumn("ast_to_ratio", F.coalesce(given["ast_to_ratio"], F.when(F.col("assists").isNotNull() & F.col("turnovers").isNotNull(), X.assist_turnover("assists", "turnovers"))))
    dreb = F.coalesce(F.col("def_rebounds"), F.col("total_rebounds") - F.col("off_rebounds"))
    score = X.game_score("points", "fgm", "fga", "fta", "ftm", "off_rebounds", dreb, "steals", "assists", "blocks", "fouls", "turnovers")
    out = out.withColumn("game_score", F.coalesce(given["game_score"], F.when(F.col("points").isNotNull(), X.round_n(score, 1))))
    return out.drop("__g", "fake")


def estimate_rebounds(tg: DataFrame) -> DataFrame:
    """Missing defensive rebounds of a team: what the opponent missed and did not rebound itself, 0 at least."""
    both = joins.opponent_join(tg, columns=("fga", "fgm", "off_rebounds"), how="left")
    guess = F.when(F.col("opp_fga").isNotNull() & F.col("opp_fgm").isNotNull() & F.col("opp_off_rebounds").isNotNull(), F.greatest(F.col("opp_fga") - F.col("opp_fgm") - F.col("opp_off_rebounds"), F.lit(0)))
    total = F.when(F.col("def_rebounds").isNull() & guess.isNotNull() & F.col("off_rebounds").isNotNull(), F.col("off_rebounds") + guess).otherwise(F.col("total_rebounds"))
    return both.withColumn("total_rebounds", total).withColumn("def_rebounds", F.coalesce("def_rebounds", guess)).select(*tg.columns)


def player_seasons(pg: DataFrame, tg: DataFrame) -> DataFrame:
    """Season statistics by (player, team, season) over games with minutes: means, ratios of sums, and rates against team and opponent."""
    own = tg.select(F.col("game_id").alias("__g1"), F.col("team_id").alias("__t1"), F.col("minutes").alias("tm_min"), F.col("off_rebounds").alias("tm_orb"), F.col("def_rebounds").alias("tm_drb"))
    opp = tg.select(F.col("game_id").alias("__g2"), F.col("team_id").alias("__t2"), *[F.col(c).alias(f"o_{c}") for c in ("fga", "tpa", "fta", "off_rebounds", "def_rebounds", "turnovers")])
    j = pg.where("minutes > 0").join(own, (F.col("game_id") == F.col("__g1")) & (F.col("team_id") == F.col("__t1")), "left")
    j = j.join(opp, (F.col("game_id") == F.col("__g2")) & (F.col("opponent_id") == F.col("__t2")), "left")
    s = lambda *c: F.sum(sum((X.nz(x) for x in c[1:]), X.nz(c[0]))).cast("double")
    means = {"mpg": "minutes", "ppg": "points", "rpg": "total_rebounds", "apg": "assists", "spg": "steals", "bpg": "blocks", "topg": "turnovers", "fpg": "fouls"}
    sums = j.groupBy("player_id", "team_id", "season").agg(
        F.count("*").alias("games_played"), F.count(F.when(F.col("starter"), 1)).alias("games_started"), *[X.round_n(F.avg(c), 1).alias(n) for n, c in means.items()],
        *[F.sum(c).cast("double").alias(f"s_{c}") for c in ("fgm", "fga", "tpm", "tpa", "ftm", "fta", "points", "minutes", "assists")],
        s("tpm").alias("z_tpm"), s("fta").alias("z_fta"), s("turnovers").alias("z_tov"), s("off_rebounds").alias("z_orb"), s("def_rebounds").alias("z_drb"), s("steals").alias("z_stl"), s("blocks").alias("z_blk"),
        F.sum(F.coalesce("tm_min", F.lit(200))).cast("double").alias("tm"), s("team_fgm").alias("t_fgm"), s("team_fga").alias("t_fga"), s("team_fta").alias("t_fta"), s("team_turnovers").alias("t_tov"),
        F.sum(F.when(F.col("fga").isNotNull(), X.nz("fta"))).cast("double").alias("k_fta"), F.sum(F.when(F.col("fga").isNotNull(), X.nz("turnovers"))).cast("double").alias("k_tov"),
        s("tm_orb", "o_def_rebounds").alias("orb_chances"), s("tm_drb", "o_off_rebounds").alias("drb_chances"), s("o_fga").alias("o_fga"), s("o_tpa").alias("o_tpa"), s("o_fta").alias("o_fta"), s("o_off_rebounds").alias("o_orb"), s("o_turnovers").alias("o_tov"),
    )
    c = F.col
    plays, team_plays = c("s_fga") + 0.44 * c("k_fta") + c("k_tov"), c("t_fga") + 0.44 * c("t_fta") + c("t_tov")
    created = 5.0 * c("s_minutes") * c("t_fgm") / c("tm") - c("s_fgm")
    losses = c("s_fga") + 0.44 * c("z_fta") + c("z_tov")
    per = lambda x, chances: F.when(chances > 0, 100.0 * c(x) * (c("tm") / 5.0) / (c("s_minutes") * chances))
    three = {
        "fg_pct": X.ratio_pos("s_fgm", "s_fga"), "tp_pct": X.ratio_pos("s_tpm", "s_tpa"), "ft_pct": X.ratio_pos("s_ftm", "s_fta"), "effective_fg_pct": X.ratio_pos(c("s_fgm") + 0.5 * c("z_tpm"), "s_fga"),
        "true_shooting_pct": X.ratio_pos("s_points", 2.0 * (c("s_fga") + 0.44 * c("z_fta"))), "usage_rate": F.when(team_plays > 0, plays * (c("tm") / 5.0) / (c("s_minutes") * team_plays)),
        "ast_pct": F.when(created > 0, c("s_assists") / created), "tov_pct": F.when(losses > 0, c("z_tov") / losses), "ft_rate": X.ratio_pos("z_fta", "s_fga"),
    }
    one = {
        "orb_pct": per("z_orb", c("orb_chances")), "drb_pct": per("z_drb", c("drb_chances")), "stl_pct": per("z_stl", c("o_fga") - c("o_orb") + c("o_tov") + 0.44 * c("o_fta")), "blk_pct": per("z_blk", c("o_fga") - c("o_tpa")),
    }
    keep = ["player_id", "team_id", "season", "games_played", "games_started", *means]
    return sums.select(*keep, *[X.round_n(e, 3).alias(n) for n, e in three.items()], *[X.round_n(e, 1).alias(n) for n, e in one.items()])


def team_seasons(tg: DataFrame) -> DataFrame:
    """Four factors by (team, season), own and allowed, with efficiency, tempo and point difference."""
    total = lambda p: [F.sum(c).cast("double").alias(f"{p}{n}") for n, c in (("fga", "fga"), ("fgm", "fgm"), ("tpm", "tpm"), ("fta", "fta"), ("orb", "off_rebounds"), ("tov", "turnovers"), ("pts", "points"))]
    own = tg.groupBy("team_id", "season").agg(F.count("*").alias("games"), *total("")).withColumn("poss", X.possessions("fga", "orb", "tov", "fta"))
    opp = tg.where("opponent_id IS NOT NULL").groupBy(F.col("opponent_id").alias("t"), F.col("season").alias("y")).agg(*total("o_")).withColumn("o_poss", X.possessions("o_fga", "o_orb", "o_tov", "o_fta"))
    both = joins.opponent_join(tg, columns=("off_rebounds", "def_rebounds", "points"))
    reb = both.where("off_rebounds IS NOT NULL AND def_rebounds > 0 AND opp_off_rebounds IS NOT NULL AND opp_def_rebounds > 0").groupBy(F.col("team_id").alias("rt"), F.col("season").alias("ry")).agg(
        X.round_n(X.ratio(F.sum("off_rebounds"), F.sum("off_rebounds") + F.sum("opp_def_rebounds")), 3).alias("off_rebound_pct"),
        X.round_n(X.ratio(F.sum("def_rebounds"), F.sum("def_rebounds") + F.sum("opp_off_rebounds")), 3).alias("def_rebound_pct"),
    )
    margin = both.groupBy(F.col("team_id").alias("mt"), F.col("season").alias("my")).agg(X.round_n(F.avg(F.col("points") - F.col("opp_points")), 1).alias("point_diff"), F.sum(F.when(F.col("points") > F.col("opp_points"), 1).otherwise(0)).alias("wins"), F.sum(F.when(F.col("points") < F.col("opp_points"), 1).otherwise(0)).alias("losses"))
    j = own.join(opp, (F.col("team_id") == F.col("t")) & (F.col("season") == F.col("y")), "left").join(reb, (F.col("team_id") == F.col("rt")) & (F.col("season") == F.col("ry")), "left").join(margin, (F.col("team_id") == F.col("mt")) & (F.col("season") == F.col("my")), "left")
    c, r = F.col, X.ratio
    one = {"adj_offense": r("pts", "poss") * 100, "adj_defense": r("o_pts", "o_poss") * 100, "adj_efficiency_margin": (r("pts", "poss") - r("o_pts", "o_poss")) * 100, "adj_tempo": (c("poss") + F.coalesce("o_poss", "poss")) / (2.0 * c("games"))}
    three = {
        "effective_fg_pct": r(c("fgm") + 0.5 * c("tpm"), "fga"), "turnover_pct": r("tov", "poss"), "ft_rate": r("fta", "fga"), "opp_effective_fg_pct": r(c("o_fgm") + 0.5 * c("o_tpm"), "o_fga"), "opp_turnover_pct": r("o_tov", "o_poss"), "opp_ft_rate": r("o_fta", "o_fga"),
    }
    return j.select("team_id", "season", "games", F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("losses", F.lit(0)).alias("losses"), *[X.round_n(e, 1).alias(n) for n, e in one.items()], *[X.round_n(e, 3).alias(n) for n, e in three.items()], "off_rebound_pct", "def_rebound_pct", "point_diff")


def with_adjusted(ts: DataFrame, tg: DataFrame, rounds: int = 50, tol: float = 0.01) -> DataFrame:
    """team_seasons with opponent-adjusted efficiency, margin, sos and sos_rank in place of the raw ones; teams without rows keep theirs."""
    a = ratings.adjusted(ratings.edges(tg), rounds, tol).select(F.col("season").alias("__y"), F.col("team_id").alias("__t"), "off", "def", "sos")
    rank = F.when(F.col("sos").isNotNull(), F.row_number().over(W.partitionBy("season").orderBy(F.col("sos").desc_nulls_last(), "team_id")).cast("long"))
    out = ts.join(a, (F.col("season") == F.col("__y")) & (F.col("team_id") == F.col("__t")), "left")
    new = {"adj_offense": X.round_n("off", 1), "adj_defense": X.round_n("def", 1), "adj_efficiency_margin": X.round_n(F.col("off") - F.col("def"), 1)}
    out = out.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in ts.columns], "sos")
    return out.withColumn("sos_rank", rank).withColumn("sos", X.round_n("sos", 1))


def player_sos(pg: DataFrame, ts: DataFrame) -> DataFrame:
    """(player_id, team_id, season, player_sos): mean margin of opponents weighted by minutes; a missing margin counts 0."""
    m = ts.select(F.col("team_id").alias("__t"), F.col("season").alias("__y"), "adj_efficiency_margin")
    j = pg.where("minutes > 0").join(m, (F.col("opponent_id") == F.col("__t")) & (F.col("season") == F.col("__y")), "left")
    return j.groupBy("player_id", "team_id", "season").agg(X.round_n(X.ratio(F.sum(X.nz("adj_efficiency_margin", 0.0) * F.col("minutes")), F.sum("minutes")), 1).alias("player_sos"))


def pass_ratings(ps: DataFrame, external: DataFrame) -> DataFrame:
    """Offensive, defensive and net rating from an external season table; of several external rows the one with most minutes, then least id."""
    e = external.where("o_rtg IS NOT NULL AND d_rtg IS NOT NULL")
    e = windows.distinct_on(e, ["player_id", "season"], [F.col("mpg").desc_nulls_last(), F.col("ext_pid").asc()])
    e = e.select(F.col("player_id").alias("__p"), F.col("season").alias("__y"), X.round_n("o_rtg", 1).alias("offensive_rating"), X.round_n("d_rtg", 1).alias("defensive_rating"), X.round_n(F.col("o_rtg") - F.col("d_rtg"), 1).alias("net_rating"))
    return ps.join(e, (F.col("player_id") == F.col("__p")) & (F.col("season") == F.col("__y")), "left").drop("__p", "__y")


@dataclass(frozen=True)
class CompositeConstants:
    """Fixed values of the composite."""

    usage_ref: float = 17.87357708
    offense_exponent: float = 0.7
    defense_discount: float = 0.1
    minutes_exponent: float = 0.5
    gp_k: float = 8.0
    sos_min_gp: int = 20
    sos_rate: float = 0.5
    player_sos_rate: float = 0.15


def composite(ext: DataFrame, k: CompositeConstants = CompositeConstants()) -> DataFrame:  # noqa: B008
    """Tiers of a player's value. ext: ext_pid, season, conf, games_played, mpg, min_share_pct, usage_rate, ogbpm, dgbpm, player_sos.

    Tier 1 weighs impact by usage and minutes, tier 2 shrinks it by games played, tier 3 adds conference strength before both; a
    parallel tier 3 takes the player's own schedule instead, with a percentile among players of ten games and minutes.
    Rows without all inputs have nulls throughout.
    """
    c = F.col
    complete = c("ogbpm").isNotNull() & c("dgbpm").isNotNull() & c("usage_rate").isNotNull() & c("min_share_pct").isNotNull() & c("mpg").isNotNull() & (c("games_played") > 0)
    ext = stored(ext.withColumn("__in", F.coalesce(complete, F.lit(False))), "composite")
    means = ext.where("__in").groupBy(c("season").alias("__s")).agg(F.avg("mpg").alias("__mp"), F.avg("min_share_pct").alias("__ms"))
    d = ext.join(means, c("season").eqNullSafe(c("__s")), "left").drop("__s")
    ok = c("__in") & (c("min_share_pct") > 0) & (c("__mp") > 0) & (c("__ms") > 0)
    put = lambda e: F.when(ok, e)
    u = c("usage_rate") / k.usage_ref
    d = d.withColumn("min_factor", put(F.pow(c("mpg") / c("__mp"), F.lit(k.minutes_exponent)))).withColumn("mp_factor", put(F.pow(c("min_share_pct") / c("__ms"), F.lit(k.minutes_exponent)))).withColumn("gp_weight", put(c("games_played") / (c("games_played") + k.gp_k)))
    d = d.withColumn("__o", put(c("ogbpm") * F.pow(u, F.lit(k.offense_exponent)))).withColumn("__d", put(c("dgbpm") * (1.0 - k.defense_discount * u)))
    d = d.withColumn("adj", c("__o") + c("__d"))
    tier1 = {"value": c("adj") * c("mp_factor"), "value_o": c("__o") * c("mp_factor"), "value_d": c("__d") * c("mp_factor"), "min_adj": c("adj") * c("min_factor")}
    for n, e in tier1.items():
        d = d.withColumn(n, e)
    for n in tier1:
        d = d.withColumn(f"{n}_v2", c(n) * c("gp_weight"))
    stable = (c("games_played") >= k.sos_min_gp) & c("adj").isNotNull() & c("conf").isNotNull()
    confs = d.where(stable).groupBy(c("season").alias("__s"), c("conf").alias("__c")).agg(F.sum("adj").alias("__sum"), F.count("*").alias("__n"))
    all_ = confs.groupBy(c("__s").alias("__s2")).agg((F.sum("__sum") / F.sum("__n")).alias("__all"))
    confs = confs.join(all_, c("__s").eqNullSafe(c("__s2"))).select("__s", "__c", (c("__sum") / c("__n") - c("__all")).alias("__shift"))
    d = d.join(confs, c("season").eqNullSafe(c("__s")) & (c("conf") == c("__c")), "left").withColumn("conf_sos", F.when(c("adj").isNotNull(), c("__shift"))).drop("__s", "__c", "__shift")

    def tier3(d: DataFrame, shift, suffix: str) -> DataFrame:
        scale = c("mp_factor") * c("gp_weight")
        part = lambda side: c(side) + F.when(F.abs(c("adj")) > 1e-9, shift * c(side) / c("adj")).otherwise(shift * 0.5)
        d = d.withColumn(f"value_v3{suffix}", (c("adj") + shift) * scale).withColumn(f"min_adj_v3{suffix}", (c("adj") + shift) * c("min_factor") * c("gp_weight"))
        return d.withColumn(f"value_o_v3{suffix}", F.when(shift.isNotNull(), part("__o") * scale)).withColumn(f"value_d_v3{suffix}", F.when(shift.isNotNull(), part("__d") * scale))

    d = tier3(d, c("conf_sos") * k.sos_rate, "")
    d = tier3(d, F.when(c("adj").isNotNull(), c("player_sos") * k.player_sos_rate), "_psos")
    ranked = c("value_v3_psos").isNotNull() & (c("games_played") >= 10) & (c("mpg") >= 10)
    d = d.drop("__in", "__mp", "__ms", "__o", "__d")
    return windows.with_percent_rank(d, "value_v3_psos_pct", "value_v3_psos", ["season"], ranked)


def rolling(pg: DataFrame, n: int = 5) -> DataFrame:
    """Means of the n games before each, over games with minutes: rolling_ppg, rpg, apg, fg_pct, ts_pct, game_score."""
    w = windows.prior(["player_id", "season", "team_id"], GAME_ORDER, n)
    s = lambda c: F.sum(c).over(w).cast("double")
    d = pg.where("minutes > 0").repartitionByRange(*DEALT)
    out = {
        "rolling_ppg": X.round_n(F.avg("points").over(w), 1), "rolling_rpg": X.round_n(F.avg("total_rebounds").over(w), 1), "rolling_apg": X.round_n(F.avg("assists").over(w), 1),
        "rolling_fg_pct": X.round_n(X.ratio_pos(s("fgm"), s("fga")), 3), "rolling_ts_pct": X.round_n(X.ratio_pos(s("points"), 2.0 * (s("fga") + 0.44 * s("fta"))), 3), "rolling_game_score": X.round_n(F.avg("game_score").over(w), 1),
    }
    return d.select("*", *[e.alias(n) for n, e in out.items()])


def schedules(games: DataFrame) -> DataFrame:
    """Each game from both teams' sides; (game_id, team_id) stays unique, the home side first. games: game_id, season, game_date, home_team_id, away_team_id, is_neutral_site."""
    cols = ["game_id", "season", "game_date"]
    home = games.select(*cols, F.col("home_team_id").alias("team_id"), F.col("away_team_id").alias("opponent_id"), (~F.col("is_neutral_site")).alias("is_home"))
    away = games.select(*cols, F.col("away_team_id").alias("team_id"), F.col("home_team_id").alias("opponent_id"), F.lit(False).alias("is_home"))
    return upsert.insert_ignore(home.where("team_id IS NOT NULL"), away.where("team_id IS NOT NULL"), ["game_id", "team_id"])


def modal(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group that is not null; of several the least."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    return windows.distinct_on(n, by, [F.col("__n").desc(), F.col(value).asc()]).drop("__n")


def same_conference(games: DataFrame, teams: DataFrame) -> DataFrame:
    """is_conference where it is missing: the same known conference; false where the home side has none, null where only the away side."""
    g = joins.both_sides(games, teams, "home_team_id", "away_team_id", "team_id", ["conference"])
    known = F.col("home_conference").isNotNull()
    flag = F.when(~known, F.lit(False)).otherwise(F.col("home_conference") == F.col("away_conference"))
    return g.withColumn("is_conference", F.coalesce(F.col("is_conference"), flag) if "is_conference" in games.columns else flag)


PERCENTILE_UP = ["ppg", "rpg", "apg", "spg", "bpg", "fg_pct", "tp_pct", "ft_pct", "effective_fg_pct", "true_shooting_pct", "usage_rate", "offensive_rating", "player_sos", "ast_pct", "mpg", "orb_pct", "drb_pct", "stl_pct", "blk_pct", "ft_rate"]
PERCENTILE_DOWN = ["defensive_rating", "tov_pct", "topg"]


def qualified(ps: DataFrame, min_games: int = 10, min_minutes: float = 10) -> DataFrame:
    return ps.where((F.col("games_played") >= min_games) & (F.col("mpg") >= min_minutes))


def percentiles(ps: DataFrame, min_games: int = 10, min_minutes: float = 10) -> DataFrame:
    """One row a player and season, from the team with most games (then the least team): percent rank of each statistic that ps has."""
    best = windows.distinct_on(qualified(ps, min_games, min_minutes), ["player_id", "season"], [F.col("games_played").desc(), F.col("team_id").asc()])
    have = [m for m in PERCENTILE_UP + PERCENTILE_DOWN if m in ps.columns]
    return windows.percent_ranks(best, ["player_id"], have, ["season"], [m for m in PERCENTILE_DOWN if m in have])


class Steps:
    """All steps over box scores (see sources.boxscores), each made when it is asked for. What several steps read is stored once."""

    def __init__(self, scores, rounds: int = 50, tol: float = 0.01):
        self.scores, self.rounds, self.tol = scores, rounds, tol

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def player_games(self) -> DataFrame:
        return stored(fill_player_games(self.scores.marked_player_games), "player-games", sweep=True)

    @cached_property
    def team_games(self) -> DataFrame:
        return stored(estimate_rebounds(self.scores.team_games), "team-games", sweep=True)

    @cached_property
    def team_seasons(self) -> DataFrame:
        return stored(with_adjusted(team_seasons(self.team_games), self.team_games, self.rounds, self.tol), "team-seasons")

    @cached_property
    def player_lines(self) -> DataFrame:
        """Season rows without schedule strength, which takes the teams' adjusted ratings."""
        return stored(player_seasons(self.player_games, self.team_games), "player-lines", sweep=True)

    @cached_property
    def player_seasons(self) -> DataFrame:
        sos = player_sos(self.player_games, self.team_seasons)
        return stored(self.player_lines.join(sos, ["player_id", "team_id", "season"], "left"), "player-seasons", sweep=True)

    @cached_property
    def rolling(self) -> DataFrame:
        return rolling(self.player_games)

    @cached_property
    def percentiles(self) -> DataFrame:
        return percentiles(self.player_seasons)


def run_all(scores, rounds: int = 50, tol: float = 0.01) -> Steps:
    return Steps(scores, rounds, tol)
