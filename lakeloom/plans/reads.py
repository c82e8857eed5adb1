"""Read queries with free parameters over the tables of the batch steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import exprs as X
from lakeloom.operators import joins, sorting, windows
from lakeloom.plans import steps

#: Fields that a search may be sorted by.
SORTS = {
    c: c
    for c in (
        "composite", "ppg", "rpg", "apg", "spg", "bpg", "topg", "offensive_rating", "defensive_rating", "net_rating", "mpg", "effective_fg_pct", "true_shooting_pct", "usage_rate", "games_played", "ast_pct", "tov_pct", "orb_pct",
        "drb_pct", "stl_pct", "blk_pct", "ft_rate",
    )
}


def player_view(ps: DataFrame, players: DataFrame, teams: DataFrame, composite: DataFrame, percentiles: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for each (player, team, season) with names, the composite, percentiles and classes. composite: player_id, season, composite, composite_pct;
    classes: player_id, season, primary, secondary."""
    out = ps.join(players.select("player_id", "name"), "player_id")
    out = joins.lookup(out, teams, {"team_id": "team_id"}, {"name": "team", "conference": "conference"})
    for other in (composite, percentiles, classes):
        out = out.join(other, ["player_id", "season"], "left")
    return out


def search_players(view: DataFrame, season: int, name: str | None = None, team: object = None, archetype: str | None = None, secondary: bool = False, min_games: int = 5, min_minutes: float = 10) -> DataFrame:
    """The rows of a season that a search finds; conditions that are None hold for all. Their number is the search's total."""
    conditions: list[Column | None] = [
        F.col("season") == season, F.col("name").ilike(f"%{name}%") if name is not None else None, F.col("team_id") == team if team is not None else None,
        ((F.col("primary") == archetype) | (F.col("secondary") == archetype) if secondary else F.col("primary") == archetype) if archetype is not None else None,
    ]
    out = steps.qualified(view, min_games, min_minutes)
    for c in conditions:
        out = out.where(c) if c is not None else out
    return out


def search_page(found: DataFrame, sort: str = "ppg", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of what was found, by a field of SORTS; ties by player and team."""
    keyed = found.withColumn("id", F.struct("player_id", "team_id"))
    return sorting.page(sorting.sort_by(keyed, sort, SORTS, descending), limit, offset).drop("id")


#: Columns of an external season table that are ranked among qualified players: whether more is better.
PLAIN = {"gbpm": True, "ogbpm": True, "dgbpm": True, "adj_oe": True, "adj_de": False, "orb_pct": True, "drb_pct": True, "stl_pct": True, "blk_pct": True, "ft_rate": True, "personal_foul_rate": False}
#: Shares of shots by zone, ranked among those with attempts there.
ZONES = {"rim_pct": "rim_attempted", "mid_pct": "mid_attempted", "dunk_pct": "dunks_attempted", "tp_pct": "tpa"}


def external_ranks(ext: DataFrame, min_games: int = 10, min_minutes: float = 10) -> DataFrame:
    """ext's qualified rows with `<column>_pctile` for PLAIN and ZONES, by season; a zone without attempts has none. All ranks come from one pass over counted
    values, in ranges of (season, column, value)."""
    q = steps.qualified(ext, min_games, min_minutes)
    every = [*PLAIN, *ZONES]
    ranks = windows.percent_ranks(q, ["ext_pid"], every, ["season"], [c for c, up in PLAIN.items() if not up], {c: F.col(tries) > 0 for c, tries in ZONES.items()})
    return q.join(ranks.select("ext_pid", "season", *[F.col(f"{c}_pct").alias(f"{c}_pctile") for c in every]), ["ext_pid", "season"])


def archetype(classes: DataFrame, season: int, player: object | None = None) -> DataFrame:
    """The classes of a player, or of all, in a season: one row each. Of several rows that with the greatest score, then the least class."""
    rows = classes.where(F.col("season") == season)
    rows = rows if player is None else rows.where(F.col("player_id") == player)
    return windows.distinct_on(rows, ["player_id", "season"], [F.col("primary_score").desc_nulls_last(), F.col("primary").asc()])


#: Players that a comparison takes.
MOST = 4


def compare(ids: Sequence[object], view: DataFrame, log: DataFrame, ext: DataFrame | None = None, averages: DataFrame | None = None, last: int | None = None) -> DataFrame:
    """Up to MOST players side by side, in one read and not one for each: season rows of the view, their games (all, or the last ones) as an array, with
    `ext` their row of external_ranks(), and with `averages` those of the season. Ids that are unknown are left out; more than MOST are an error."""
    asked = [*dict.fromkeys(ids)]
    if not 0 < len(asked) <= MOST:
        raise ValueError(f"between 1 and {MOST} players are compared, not {len(asked)}")
    rows = view.where(F.col("player_id").isin(asked))
    games = log.where(F.col("player_id").isin(asked))
    if last is not None:
        games = windows.top_n(games, ["player_id", "season"], [F.col("game_date").desc(), F.col("game_id").desc()], last)
    recent = games.groupBy("player_id", "season").agg(F.array_sort(F.collect_list(F.struct("game_date", "game_id", "points", "game_score", "rolling_ppg"))).alias("recent"))
    out = rows.join(recent, ["player_id", "season"], "left")
    if ext is not None:
        own = ext.where(F.col("ext_pid").isin(asked)).select(F.col("ext_pid").alias("player_id"), "season", *[f"{c}_pctile" for c in [*PLAIN, *ZONES]])
        out = out.join(own, ["player_id", "season"], "left")
    return out if averages is None else out.join(averages, ["season"], "left")


def shot_shares(ext: DataFrame) -> DataFrame:
    """Shares of attempts by zone and made shares in percent; null without attempts."""
    total = X.nz("rim_attempted") + X.nz("mid_attempted") + X.nz("tpa")
    share = {f"{n}_share": X.ratio_pos(X.nz(c), total) for n, c in (("rim", "rim_attempted"), ("mid", "mid_attempted"), ("three", "tpa"))}
    made = {f"{n}_made_pct": F.col(c) * 100 for n, c in (("rim", "rim_pct"), ("mid", "mid_pct"), ("three", "tp_pct"))}
    return ext.select("ext_pid", "season", *[e.alias(n) for n, e in (share | made).items()], (X.ratio_pos("ftm", "fta") * 100).alias("ft_made_pct"))
