"""Matchup features as of the day before: one definition for training and for scoring. All windows leave the current game out.

Roster features follow the players with a row in the game, as the reference does when it trains; for scoring, pass the players expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import exprs as X
from lakeloom.operators import joins, ratings, windows
from lakeloom.sources.tables import stored

ORDER = ("game_date", "game_id")
TEAM = ["win_pct", "road_win_pct", "pythag_win_pct", "point_diff", "adj_tempo", "effective_fg_pct", "turnover_pct", "off_rebound_pct", "ft_rate", "opp_effective_fg_pct", "opp_turnover_pct", "def_rebound_pct", "opp_ft_rate"]
#: Means of the players' games before, by name: what is averaged.
MEANS = {"w_ppg": "points", "w_rpg": "total_rebounds", "w_apg": "assists", "w_spg": "steals", "w_bpg": "blocks", "w_topg": "turnovers", "w_ts_pct": "ts_g", "w_efg_pct": "efg_g", "w_ortg": "ortg_g", "w_usage": "usage_g", "w_ast_pct": "ast_g", "w_tov_pct": "tov_g", "w_stl_pct": "stl_g", "w_blk_pct": "blk_g"}
IMPACT = ["gbpm", "ogbpm", "dgbpm"]
ROSTER = ["roster_size", *MEANS, *[f"w_{c}" for c in IMPACT], "star_ppg", *[f"star_{c}" for c in IMPACT], "star_ortg", "minutes_stddev", "w_rolling_gs", "w_rolling_ts", "w_ppg_trend", "w_gs_trend"]
RATED = ["adj_offense", "adj_defense", "adj_efficiency_margin", "sos"]
#: Columns of a composite table (see steps.composite) that count as impact, by variant.
VARIANTS = {"raw": ("gbpm", "ogbpm", "dgbpm"), "v3": ("value_v3", "value_o_v3", "value_d_v3"), "v3_psos": ("value_v3_psos", "value_o_v3_psos", "value_d_v3_psos")}
LOWER_IS_BETTER = {"opp_effective_fg_pct", "opp_ft_rate", "adj_defense"}


def team_form(tg: DataFrame) -> DataFrame:
    """(season, team_id, game_id, TEAM...): a team's season up to each game. Ratios are of sums; win shares are 0.5 before the first game."""
    d = joins.opponent_join(tg, columns=("points", "fgm", "fga", "tpm", "fta", "off_rebounds", "def_rebounds", "turnovers"), how="left")
    w = windows.prior(["team_id", "season"], ORDER)
    s = lambda c: F.sum(c).over(w).cast("double")
    won, lost, road = F.col("points") > F.col("opp_points"), F.col("points") < F.col("opp_points"), ~F.col("is_home")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(w), F.lit(0))
    poss = X.possessions(s("fga"), s("off_rebounds"), s("turnovers"), s("fta"))
    o_poss = X.possessions(s("opp_fga"), s("opp_off_rebounds"), s("opp_turnovers"), s("opp_fta"))
    games = F.count("*").over(w).cast("double")
    out = {
        "win_pct": X.win_pct(count(won), count(lost)), "road_win_pct": X.win_pct(count(won & road), count(lost & road)), "pythag_win_pct": F.coalesce(X.pythagorean(s("points"), s("opp_points")), F.lit(0.5)),
        "point_diff": F.avg(F.col("points") - F.col("opp_points")).over(w), "adj_tempo": X.ratio_pos((poss + F.coalesce(o_poss, poss)) / 2.0, games), "effective_fg_pct": X.ratio_pos(s("fgm") + 0.5 * s("tpm"), s("fga")),
        "turnover_pct": X.ratio_pos(s("turnovers"), poss), "off_rebound_pct": X.ratio_pos(s("off_rebounds"), s("off_rebounds") + s("opp_def_rebounds")), "ft_rate": X.ratio_pos(s("fta"), s("fga")),
        "opp_effective_fg_pct": X.ratio_pos(s("opp_fgm") + 0.5 * s("opp_tpm"), s("opp_fga")), "opp_turnover_pct": X.ratio_pos(s("opp_turnovers"), o_poss), "def_rebound_pct": X.ratio_pos(s("def_rebounds"), s("def_rebounds") + s("opp_off_rebounds")), "opp_ft_rate": X.ratio_pos(s("opp_fta"), s("opp_fga")),
    }
    return d.select("season", "team_id", "game_id", *[e.alias(n) for n, e in out.items()])


def per_game(pg: DataFrame) -> DataFrame:
    """pg with each game's rates: shooting, use of the ball, and points for each hundred possessions used; null where there is nothing to divide by."""
    c = lambda n: F.col(n).cast("double")
    fifth = F.coalesce(c("team_minutes"), F.lit(200.0)) / 5.0
    created = c("minutes") / fifth * c("team_fgm") - c("fgm")
    plays, team_plays = c("fga") + 0.44 * c("fta") + c("turnovers"), c("team_fga") + 0.44 * c("team_fta") + c("team_turnovers")
    used = F.greatest(c("fga") - c("off_rebounds") + c("turnovers") + 0.44 * c("fta"), F.lit(0.1))
    rates = {
        "ts_g": X.ratio_pos("points", 2.0 * (c("fga") + 0.44 * c("fta"))), "efg_g": X.ratio_pos(c("fgm") + 0.5 * c("tpm"), "fga"), "ortg_g": c("points") / used * 100.0, "usage_g": F.when(team_plays > 0, plays * fifth / (c("minutes") * team_plays)),
        "ast_g": X.ratio_pos("assists", created), "tov_g": X.ratio_pos("turnovers", plays), "stl_g": c("steals") / (c("minutes") / 40.0), "blk_g": c("blocks") / (c("minutes") / 40.0),
    }
    return pg.where("minutes > 0").select("*", *[e.alias(n) for n, e in rates.items()])


def impact_of(external: DataFrame, variant: str = "raw") -> DataFrame:
    """(player_id, season, IMPACT...) from composite rows (player_id, season, ...): the variant that is asked for, under the same names."""
    return external.select("player_id", "season", *[F.col(c).cast("double").alias(n) for c, n in zip(VARIANTS[variant], IMPACT, strict=True)])


def roster(pg: DataFrame, min_games: int = 5, min_minutes: float = 10.0, impact: DataFrame | None = None) -> DataFrame:
    """(season, team_id, game_id, ROSTER...): the players of each game by their games before it, weighted by the minutes they have played, over those
    of min_games games and min_minutes minutes each. pg: rows of steps.rolling.

    A mean of rates is one of games. What a player lacks counts 0 in the weighted means; recent form, as it was stored with the game before,
    and trends leave such players out. Sums are of decimals, so they do not depend on the order of rows.

    Rows come dealt by season, team and player (steps.DEALT), so most of a side is summed up where its players are. Impact meets narrow rows in a job of its own.
    """
    by, side = ["player_id", "season", "team_id"], ["season", "team_id", "game_id"]
    w, line = windows.prior(by, ORDER), windows.series(by, ORDER)
    # of 19 digits before the point: a rate whose divisor is but a rounding error has up to 17
    exact = lambda x: F.sum(x.cast("decimal(28,9)")).over(w).cast("double")
    mean = lambda c: F.try_divide(exact(F.col(c)), F.count(c).over(w).cast("double"))
    total = lambda x: F.sum((F.col(x) * F.col("wt")).cast("decimal(28,9)")).cast("double")
    every = lambda names: [F.coalesce(total(c) / F.sum("wt"), F.lit(0.0)).alias(n) for n, c in names.items()]
    star = lambda names: F.max_by(F.struct(*[F.col(c).alias(n) for n, c in names.items()]), F.struct("wt", -F.col("player_id"))).alias("__star")

    def weighed(*more: Column) -> DataFrame:
        """Rows of players that have played enough: their games and minutes before the game, and what else is asked for."""
        d = per_game(pg).select(*by, "game_id", F.count("*").over(w).alias("g"), F.sum("minutes").over(w).alias("wt"), *more)
        return d.withColumn("mpg", F.col("wt") / F.col("g")).where((F.col("g") >= min_games) & (F.col("mpg") >= min_minutes))

    d = weighed(
        *[mean(c).alias(n) for n, c in MEANS.items()], mean("game_score").alias("gs"),
        F.lag("rolling_ppg").over(line).alias("r_ppg"), F.lag("rolling_game_score").over(line).alias("w_rolling_gs"), F.lag("rolling_ts_pct").over(line).alias("w_rolling_ts"),
    )
    if impact is not None:
        # a player with several impact rows counts as often in all that is summed
        often = stored(impact.groupBy("player_id", "season").agg(F.count("*").cast("int").alias("__n")).where("__n > 1"), "often")
        d = d.join(often, ["player_id", "season"], "left").withColumn("__k", F.explode(F.array_repeat(F.lit(0), F.coalesce("__n", F.lit(1))))).drop("__n", "__k")
        valued = weighed().join(impact, ["player_id", "season"], "left").groupBy(*side).agg(*every({f"w_{c}": c for c in IMPACT}), star({f"star_{c}": c for c in IMPACT}))
        valued = stored(valued.select(*[F.col(c).alias(f"__{c}") for c in side], *[f"w_{c}" for c in IMPACT], "__star.*"), "valued", sweep=True)
    d = d.withColumn("w_ppg_trend", F.col("r_ppg") - F.col("w_ppg")).withColumn("w_gs_trend", F.col("w_rolling_gs") - F.col("gs"))
    known = [(total(n) / F.sum(F.when(F.col(n).isNotNull(), F.col("wt")))).alias(n) for n in ("w_rolling_gs", "w_rolling_ts", "w_ppg_trend", "w_gs_trend")]
    out = d.groupBy(*side).agg(F.count("*").alias("roster_size"), *every({n: n for n in MEANS}), star({"star_ppg": "w_ppg", "star_ortg": "w_ortg"}), F.stddev_samp("mpg").alias("minutes_stddev"), *known).select("*", "__star.*")
    if impact is None:
        return out.select(*side, *[F.lit(0.0).alias(c) if c in {f"w_{i}" for i in IMPACT} else F.lit(None).cast("double").alias(c) if c in {f"star_{i}" for i in IMPACT} else F.col(c) for c in ROSTER])
    same = F.lit(True)
    for c in side:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out.join(valued, same, "left").select(*side, *ROSTER)


def team_player_sos(pg: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(season, team_id, game_id, w_player_sos): the schedules that a game's players have met before it, weighted by their minutes in it."""
    rows = ratings.cumulative_sos(pg, snapshots.select("team_id", "as_of", (F.col("off") - F.col("def")).alias("margin")), ("team_id", "minutes"))
    total = F.sum((X.nz("cum_sos", 0.0) * F.col("minutes")).cast("decimal(28,9)")).cast("double")
    return rows.groupBy("season", "team_id", "game_id").agg((total / F.sum("minutes")).alias("w_player_sos"))


def elo_with_provider(computed: DataFrame, provider: DataFrame | None) -> DataFrame:
    """Pre-game ratings, the provider's (game_id, home_elo_before, away_elo_before) where they are there."""
    if provider is None:
        return computed
    j = computed.join(provider.select("game_id", "home_elo_before", "away_elo_before"), "game_id", "left")
    for side in ("home", "away"):
        j = joins.prefer(j, f"{side}_elo_before", f"{side}_elo", f"{side}_elo")
    return j.select("season", "game_id", "home_elo", "away_elo")


NAMES = [*TEAM, *RATED, "elo", *ROSTER, "w_player_sos"]
FEATURES = ["venue", "is_conference_game", *[f"diff_{c}" for c in NAMES]]


def matrix(games: DataFrame, pg: DataFrame, tg: DataFrame, teams: DataFrame, snapshots: DataFrame, external: DataFrame | None = None, variant: str = "raw", provider_elo: DataFrame | None = None, fill: bool = False, min_games: int = 5, min_minutes: float = 10.0) -> DataFrame:
    """One row a game: context, home - away differences (NAMES) with the sign turned where less is better, and targets margin and home_win.

    pg: rows of steps.rolling. snapshots: as_of, team_id, off, def, sos (see ratings.by_date); each game takes the last one before its day.
    external: composite rows, of which `variant` says what counts as impact. A missing side makes a difference null, or counts 0 with `fill`.
    What takes a pass over players' games is a job of its own whose rows, one a side, are stored: disk holds the shuffles of one pass at a time.
    """
    snapshots = stored(snapshots, "snapshots", sweep=True)
    impact = stored(impact_of(external, variant), "impact", sweep=True) if external is not None else None
    people = stored(roster(pg, min_games, min_minutes, impact), "roster", sweep=True)
    schedule = stored(team_player_sos(pg, snapshots), "schedule", sweep=True)
    snap = snapshots.select("team_id", "as_of", F.col("off").alias("adj_offense"), F.col("def").alias("adj_defense"), (F.col("off") - F.col("def")).alias("adj_efficiency_margin"), "sos")
    out = games.join(elo_with_provider(ratings.elo(games), provider_elo), ["season", "game_id"], "left")
    parts = [(team_form(tg), TEAM), (people, ROSTER), (schedule, ["w_player_sos"])]
    for side in ("home", "away"):
        key = f"{side}_team_id"
        for df, cols in parts:
            part = df.select("game_id", F.col("team_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in cols])
            out = out.join(part, ["game_id", key], "left")
        out = joins.asof_join(out, snap.select(F.col("team_id").alias(key), "as_of", *[F.col(c).alias(f"{side}_{c}") for c in RATED]), [key], "game_date", "as_of", [f"{side}_{c}" for c in RATED], strict=True)
    out = joins.both_sides(out, teams, "home_team_id", "away_team_id", "team_id", ["conference"])

    def gap(c: str):
        h, a = F.col(f"home_{c}").cast("double"), F.col(f"away_{c}").cast("double")
        d = X.diff(h, a) if fill else h - a
        return (0.0 - d if c in LOWER_IS_BETTER else d).alias(f"diff_{c}")

    venue = F.when(F.col("is_neutral_site"), 0).otherwise(1).alias("venue")
    same = F.coalesce(F.col("home_conference") == F.col("away_conference"), F.lit(False)).cast("int").alias("is_conference_game")
    margin = F.col("home_score") - F.col("away_score")
    return out.select("season", "game_id", "game_date", "home_team_id", "away_team_id", venue, same, *[gap(c) for c in NAMES], margin.alias("margin"), (margin > 0).cast("int").alias("home_win"))


def with_matchups(asked: DataFrame, games: DataFrame, pg: DataFrame, tg: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """games, pg and tg with games still to be played (asked: game_id, season, game_date, home_team_id, away_team_id, is_neutral_site): no score, no
    statistics, and the players that each side had in its last game before. Features of these rows are then as of their day."""
    nulls = lambda df, have: df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in have_of.schema.fields])
    have_of = games
    all_games = games.unionByName(nulls(asked, asked.columns))
    day = asked.select("game_id", "season", "game_date", F.col("home_team_id").alias("team_id"), F.col("away_team_id").alias("opponent_id"), (~F.col("is_neutral_site")).alias("is_home"))
    sides = day.unionByName(asked.select("game_id", "season", "game_date", F.col("away_team_id").alias("team_id"), F.col("home_team_id").alias("opponent_id"), F.lit(False).alias("is_home")))
    have_of = tg
    all_tg = tg.unionByName(nulls(sides, sides.columns))
    past = tg.select("team_id", "season", F.col("game_id").alias("last_game"), F.col("game_date").alias("last_day")).join(sides, ["team_id", "season"]).where(F.col("last_day") < F.col("game_date"))
    last = past.groupBy(*sides.columns).agg(F.max_by("last_game", F.struct("last_day", "last_game")).alias("last_game"))
    lineup = pg.where("minutes > 0").select("player_id", F.col("team_id").alias("t"), F.col("game_id").alias("g"), "minutes")
    rows = last.join(lineup, (F.col("team_id") == F.col("t")) & (F.col("last_game") == F.col("g"))).drop("t", "g", "last_game")
    rows = stored(rows, "lineup", sweep=True)
    have_of = pg
    return all_games, pg.unionByName(nulls(rows, rows.columns)), all_tg
