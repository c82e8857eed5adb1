"""Ratings that are iterated or sequential. Edges are aggregated first: one row for each ordered pair of teams and season, whatever the
number of games, so a season's edges (teams squared at most) fit one task; seasons and dates run in parallel. Groups of more edges than a task
should hold are solved by rounds of joins instead (adjusted_by_rounds)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions import exprs as X
from lakeloom.operators import joins, windows
from lakeloom.sources.tables import stored


def edges(tg: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(season, team_id, opponent_id, extra..., pts, poss, games) over team games with points, attempts and possessions."""
    d = tg.where("points IS NOT NULL AND fga IS NOT NULL AND opponent_id IS NOT NULL")
    d = d.withColumn("__poss", X.possessions(F.col("fga").cast("double"), X.nz("off_rebounds"), X.nz("turnovers"), X.nz("fta"))).where("__poss > 0")
    return d.groupBy("season", "team_id", "opponent_id", *extra).agg(F.sum("points").cast("double").alias("pts"), X.possessions(F.sum("fga"), F.sum(X.nz("off_rebounds")), F.sum(X.nz("turnovers")), F.sum(X.nz("fta"))).cast("double").alias("poss"), F.count("*").cast("double").alias("games"))


def solve(team: np.ndarray, opp: np.ndarray, pts: np.ndarray, poss: np.ndarray, games: np.ndarray, rounds: int = 50, tol: float = 0.01, universe: str = "offense") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(teams, off, def, sos) by Jacobi rounds: each rating is the raw one scaled by league average over the mean of those met, weighted by
    possessions. universe `offense`: teams that appear as team; `union`: on either side, with sos 0 instead of null without games."""
    ids = np.unique(team if universe == "offense" else np.concatenate([team, opp]))
    n = len(ids)
    i = np.searchsorted(ids, team)
    at = np.minimum(np.searchsorted(ids, opp), n - 1)
    known = ids[at] == opp
    j = np.where(known, at, n)  # place n stands for an opponent without a rating
    add = lambda k, v: np.bincount(k, v, minlength=n + 1)[:n]
    off_pts, off_poss, def_pts, def_poss = add(i, pts), add(i, poss), add(j, pts), add(j, poss)
    league = pts.sum() / poss.sum() * 100 if poss.sum() > 0 else 100.0
    with np.errstate(divide="ignore", invalid="ignore"):
        raw_off = np.where(off_poss > 0, off_pts / off_poss * 100, league)
        raw_def = np.where(def_poss > 0, def_pts / def_poss * 100, league)
        off, dfn = np.append(raw_off, league), np.append(raw_def, league)
        for _ in range(rounds):
            met_def = np.where(off_poss > 0, add(i, dfn[j] * poss) / off_poss, league)
            met_off = np.where(def_poss > 0, add(j, off[i] * poss) / def_poss, league)
            new_off = np.where(off_poss > 0, raw_off * (league / met_def), off[:n])
            new_def = np.where(def_poss > 0, raw_def * (league / met_off), dfn[:n])
            change = max(np.abs(new_off - off[:n]).max(initial=0), np.abs(new_def - dfn[:n]).max(initial=0))
            off, dfn = np.append(new_off, league), np.append(new_def, league)
            if change < tol:
                break
        played = add(i, games)
        none = np.nan if universe == "offense" else 0.0
        sos = np.where(played > 0, add(i, (off[j] - dfn[j]) * games) / played, none)
    return ids, off[:n], dfn[:n], sos


def adjusted(e: DataFrame, rounds: int = 50, tol: float = 0.01, by: tuple[str, ...] = ("season",), universe: str = "offense", most_edges: int | None = None) -> DataFrame:
    """(by..., team_id, off, def, sos) for each group of edges. The fixed point oscillates, so the number of rounds is part of the result.
    Groups of more than `most_edges` edges go through adjusted_by_rounds(), the others are a task each; None: all are."""
    kinds = {f.name: f.dataType.simpleString() for f in e.schema.fields}
    if most_edges is not None:
        e = stored(e.select(*by, "team_id", "opponent_id", "pts", "poss", "games").withColumn("__g", F.struct(*by)), "edges")
        large = e.groupBy("__g").agg(F.count("*").alias("n")).where(F.col("n") > most_edges)
        small, beyond = (e.join(large, "__g", how).drop("__g") for how in ("left_anti", "left_semi"))
        return adjusted(small, rounds, tol, by, universe).unionByName(adjusted_by_rounds(beyond, rounds, tol, by, universe))

    def op(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["team_id", "opponent_id"])
        ids, off, dfn, sos = solve(*[g[c].to_numpy() for c in ("team_id", "opponent_id", "pts", "poss", "games")], rounds, tol, universe)
        out = pd.DataFrame({"team_id": ids, "off": off, "def": dfn, "sos": pd.array(sos, dtype="Float64")})
        out["sos"] = out["sos"].mask(out["sos"].isna())
        for k, c in enumerate(by):
            out.insert(k, c, g[c].iloc[0])
        return out

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", team_id {kinds['team_id']}, off double, def double, sos double"
    return e.select(*by, "team_id", "opponent_id", "pts", "poss", "games").groupBy(*by).applyInPandas(op, schema)


def adjusted_by_rounds(e: DataFrame, rounds: int = 50, tol: float = 0.01, by: tuple[str, ...] = ("season",), universe: str = "offense") -> DataFrame:
    """What adjusted() gives, up to the order of sums, with each round as two joins and aggregations over the stored edges: no task holds a group.
    A round's ratings are stored before the next, so lineage stays short. A group stops when none of its ratings moves by tol."""
    g, team, opp = F.col("g"), F.col("team_id"), F.col("opponent_id")  # as a struct, keys that are null are equal
    e = e.select(F.struct(*by).alias("g"), "team_id", "opponent_id", "pts", "poss", "games")
    league = e.groupBy("g").agg(F.coalesce(F.try_divide(F.sum("pts"), F.when(F.sum("poss") > 0, F.sum("poss"))) * 100, F.lit(100.0)).alias("league"))
    e = stored(e.join(league, "g"), "edges")
    attack = e.groupBy("g", "team_id").agg(F.sum("pts").alias("op"), F.sum("poss").alias("oq"), F.sum("games").alias("played"), F.first("league").alias("l1"))
    defend = e.groupBy("g", opp.alias("team_id")).agg(F.sum("pts").alias("dp"), F.sum("poss").alias("dq"), F.first("league").alias("l2"))
    now = attack.join(defend, ["g", "team_id"], "left" if universe == "offense" else "full").fillna(0.0, ["op", "oq", "played", "dp", "dq"])
    now = now.withColumn("league", F.coalesce("l1", "l2"))
    raw = lambda p, q: F.when(F.col(q) > 0, F.col(p) / F.col(q) * 100).otherwise(F.col("league"))
    now = now.select("g", "team_id", "league", "oq", "dq", "played", raw("op", "oq").alias("raw_off"), raw("dp", "dq").alias("raw_def"))
    now = stored(now.withColumn("off", F.col("raw_off")).withColumn("def", F.col("raw_def")).withColumn("live", F.lit(True)), "ratings")

    def met(rated: DataFrame, mine: str, theirs: str, value, weight: str, name: str) -> DataFrame:
        """By `mine`, the sum of a value of the side `theirs` times a weight; a side without a rating stands at the league's."""
        side = rated.select("g", F.col("team_id").alias(theirs), value.alias("v"))
        j = e.join(side, ["g", theirs], "left")
        return j.groupBy("g", F.col(mine).alias("team_id")).agg(F.sum(F.coalesce("v", F.col("league") if weight == "poss" else F.lit(0.0)) * F.col(weight)).alias(name))

    for _ in range(rounds):
        live = now.where("live") if tol > 0 else now
        nxt = now.join(met(live, "team_id", "opponent_id", F.col("def"), "poss", "md"), ["g", "team_id"], "left").join(met(live, "opponent_id", "team_id", F.col("off"), "poss", "mo"), ["g", "team_id"], "left")
        move = lambda had, q, raw_value, m: F.when(F.col("live") & (F.col(q) > 0), F.col(raw_value) * (F.col("league") / (F.col(m) / F.col(q)))).otherwise(F.col(had))
        nxt = nxt.select("g", "team_id", "league", "oq", "dq", "played", "raw_off", "raw_def", move("off", "oq", "raw_off", "md").alias("off"), move("def", "dq", "raw_def", "mo").alias("def"), "live", F.col("off").alias("off0"), F.col("def").alias("def0"))
        now = stored(nxt, "ratings")
        if tol > 0:
            change = now.where("live").groupBy("g").agg((F.max(F.greatest(F.abs(F.col("off") - F.col("off0")), F.abs(F.col("def") - F.col("def0")))) >= tol).alias("again"))
            now = now.join(change, "g", "left").withColumn("live", F.coalesce("again", F.lit(False))).drop("again")
            if now.where("live").isEmpty():
                break
        now = now.drop("off0", "def0")
    margin = met(now, "team_id", "opponent_id", F.col("off") - F.col("def"), "games", "margin")
    sos = F.when(F.col("played") > 0, F.col("margin") / F.col("played")).otherwise(F.lit(None).cast("double") if universe == "offense" else F.lit(0.0))
    return now.join(margin, ["g", "team_id"], "left").select(*[g[c].alias(c) for c in by], team, "off", "def", sos.alias("sos"))


def by_date(tg: DataFrame, dates: DataFrame, rounds: int = 50, tol: float = 0.01, most_edges: int | None = None) -> DataFrame:
    """(as_of, team_id, off, def, sos) for each date of `dates` (as_of) that has games strictly before it, from these, of all seasons.

    Games count from the first date after them on. A pair's sums run on from date to date and hold until its next game, so each (date, pair)
    is made once, which is what the rounds read; dates run in parallel. Windows over the calendar see a row a day.
    """
    e = edges(tg.withColumn("season", F.lit(0)), ("game_date",)).drop("season")
    marks = dates.select("as_of").distinct().withColumn("slot", F.row_number().over(W.orderBy("as_of")))
    n = marks.count()
    days = marks.select(F.col("as_of").alias("day"), "slot").unionByName(e.select(F.col("game_date").alias("day")).distinct().withColumn("slot", F.lit(None).cast("int")))
    after = W.orderBy("day", F.col("slot").asc_nulls_last()).rowsBetween(1, W.unboundedFollowing)
    starts = days.withColumn("from", F.first("slot", ignorenulls=True).over(after)).where("slot IS NULL AND from IS NOT NULL").select("day", "from")
    pair = W.partitionBy("team_id", "opponent_id").orderBy("from")
    so_far = pair.rowsBetween(W.unboundedPreceding, 0)
    d = e.join(starts, F.col("game_date") == F.col("day")).groupBy("team_id", "opponent_id", "from").agg(*[F.sum(c).alias(c) for c in ("pts", "poss", "games")])
    d = d.select("team_id", "opponent_id", *[F.sum(c).over(so_far).alias(c) for c in ("pts", "poss", "games")], "from", F.coalesce(F.lead("from").over(pair) - 1, F.lit(n)).alias("to"))
    d = d.withColumn("slot", F.explode(F.sequence("from", "to"))).drop("from", "to")
    return adjusted(d.join(marks, "slot"), rounds, tol, ("as_of",), "union", most_edges)


ELO_START, ELO_K, ELO_HOME = 1500.0, 20.0, 3.5


def elo_step(home: float, away: float, margin: float, neutral: bool, k: float = ELO_K, home_edge: float = ELO_HOME) -> float:
    """What a game of that margin adds to the home side's rating and takes from the other's."""
    expected = 1 / (1 + 10 ** ((away - home - (0.0 if neutral else home_edge)) / 400))
    result = 1.0 if margin > 0 else 0.0 if margin < 0 else 0.5
    return float(k * np.log(abs(margin) + 1) * 2.2 / ((home - away) * 0.001 + 2.2) * (result - expected))


def elo(games: DataFrame, start: float = ELO_START, k: float = ELO_K, home_edge: float = ELO_HOME) -> DataFrame:
    """Pre-game ratings: (season, game_id, home_elo, away_elo). games: season, game_id, game_date, home_team_id, away_team_id, home_score,
    away_score, is_neutral_site. Sequential within a season, so a season is one task (a row a game); seasons run in parallel."""
    kinds = {f.name: f.dataType.simpleString() for f in games.schema.fields}

    def op(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["game_date", "game_id"])
        now: dict[object, float] = {}
        rows = []
        for gid, h, a, hs, as_, neutral in zip(g["game_id"], g["home_team_id"], g["away_team_id"], g["home_score"], g["away_score"], g["is_neutral_site"], strict=True):
            eh, ea = now.get(h, start), now.get(a, start)
            rows.append((gid, eh, ea))
            if pd.isna(hs) or pd.isna(as_):
                continue
            step = elo_step(eh, ea, hs - as_, bool(neutral), k, home_edge)
            now[h], now[a] = eh + step, ea - step
        out = pd.DataFrame(rows, columns=["game_id", "home_elo", "away_elo"])
        out.insert(0, "season", g["season"].iloc[0])
        return out

    cols = ["season", "game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score", "is_neutral_site"]
    return games.select(*cols).groupBy("season").applyInPandas(op, f"season {kinds['season']}, game_id {kinds['game_id']}, home_elo double, away_elo double")


def cumulative_sos(pg: DataFrame, snapshots: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(player_id, season, game_id, keep..., cum_sos): margin of opponents met so far as of each game, weighted by minutes, before the current game.
    snapshots: team_id, as_of, margin. Margins are found once for each opponent and day; rows look them up."""
    rows = pg.where("minutes > 0").select(*dict.fromkeys(["player_id", "season", "game_id", "game_date", "minutes", "opponent_id", *keep]))
    days = rows.select(F.col("opponent_id").alias("team_id"), F.col("game_date").alias("__day")).distinct()
    margins = stored(joins.asof_join(days, snapshots.select("team_id", "as_of", "margin"), ["team_id"], "__day", "as_of", ["margin"]).withColumnRenamed("team_id", "__o"), "margins", sweep=True)
    met = rows.join(margins, F.col("opponent_id").eqNullSafe(F.col("__o")) & F.col("game_date").eqNullSafe(F.col("__day")), "left")
    w = windows.prior(["player_id", "season"], ["game_date", "game_id"])
    total = F.sum((X.nz("margin", 0.0) * F.col("minutes")).cast("decimal(28,9)")).over(w).cast("double")  # of decimals: in any order of rows the same
    return met.select("player_id", "season", "game_id", *keep, F.try_divide(total, F.sum("minutes").over(w)).alias("cum_sos"))


def dense_order(df: DataFrame, value: str, by: tuple[str, ...] = ("season",)) -> DataFrame:
    """A dense rank by value, greatest first, nulls last."""
    return df.withColumn(f"{value}_rank", F.dense_rank().over(W.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())).cast("long"))
