"""Features look at the past only: games after a day change nothing before it."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeloom.plans import checked_box, features, steps
from lakeloom.sources import boxscores

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")
def test_no_look_ahead(spark):
    s = boxscores.box_scores(spark, DIR)
    day = F.lit("1994-06-01").cast("date")
    tg = steps.estimate_rebounds(s.team_games).where("season <= 1994").persist()
    pg = steps.rolling(steps.fill_player_games(s.player_games)).where("season <= 1994").persist()
    for make, rows in ((features.team_form, tg), (lambda d: features.roster(d, 2, 5.0), pg)):
        full = make(rows).join(tg.where(F.col("game_date") <= day).select("game_id", "team_id"), ["game_id", "team_id"], "left_semi")
        cut = make(rows.where(F.col("game_date") <= day))
        assert sorted(map(str, full.collect())) == sorted(map(str, cut.select(*full.columns).collect()))


def test_steps_change_only_what_is_missing(spark):
    cols = "game_id string, team_id int, points int, fgm int, fga int, ftm int, fta int, off_rebounds int, def_rebounds int, total_rebounds int, assists int, steals int, blocks int, turnovers int, fouls int"
    pg = spark.createDataFrame([("g", 1, 20, 8, 15, 2, 4, 2, 5, 7, 5, 1, 1, 3, 2), ("h", 1, None, 1, 2, 0, 0, 3, None, None, 0, 0, 0, 0, 0), ("h", 2, 2, 1, 2, 0, 0, 0, None, 0, 3, 0, 0, 2, 0)], cols)
    r = {(x["game_id"], x["team_id"]): x for x in steps.fill_player_games(pg).collect()}
    assert r["g", 1]["def_rebounds"] == 5 and r["g", 1]["game_score"] == 16.2
    assert r["h", 1]["game_score"] is None and r["h", 2]["total_rebounds"] is None and r["h", 2]["ast_to_ratio"] == 1.5


def test_roster_takes_rates_whose_divisor_is_a_rounding_error(spark):
    """7 of 50 minutes of 50 baskets are 7 + 9e-16: assists by what is left are 1e15, more than nine digits before the point hold."""
    row = dict(player_id=1, team_id=1, season=1990, minutes=7.0, points=20, total_rebounds=5, assists=1, steals=1, blocks=0, turnovers=2, fgm=7, fga=15, fta=4, tpm=2, off_rebounds=2, team_minutes=250, team_fga=90, team_fta=20, team_turnovers=10, team_fgm=50, game_score=9.5, rolling_ppg=20.0, rolling_game_score=9.5, rolling_ts_pct=0.5)
    pg = spark.createDataFrame([row | {"game_id": f"g{i}", "game_date": f"1990-01-0{i}"} for i in range(1, 4)]).withColumn("game_date", F.col("game_date").cast("date"))
    got = {r["game_id"]: r for r in features.roster(pg, 1, 5.0).collect()}
    assert sorted(got) == ["g2", "g3"] and 1e15 < got["g3"]["w_ast_pct"] < 1.2e15 and got["g3"]["w_ppg"] == 20.0


def test_a_player_with_two_impact_rows_counts_twice(spark):
    """As a join to the rows would have it; sides without impact stay."""
    row = dict(season=1990, minutes=20.0, total_rebounds=5, assists=1, steals=1, blocks=0, turnovers=2, fgm=7, fga=15, fta=4, tpm=2, off_rebounds=2, team_minutes=200, team_fga=90, team_fta=20, team_turnovers=10, team_fgm=30, game_score=9.5, rolling_ppg=20.0, rolling_game_score=9.5, rolling_ts_pct=0.5)
    pg = spark.createDataFrame([row | {"player_id": p, "team_id": t, "points": 10 * p, "game_id": f"g{i}", "game_date": f"1990-01-0{i}"} for i in (1, 2) for p, t in ((1, 1), (2, 1), (3, 2))]).withColumn("game_date", F.col("game_date").cast("date"))
    impact = spark.createDataFrame([(1, 1990, 6.0, 3.0, 3.0), (2, 1990, 1.0, 1.0, 0.0), (2, 1990, 2.0, 1.0, 1.0)], "player_id long, season long, gbpm double, ogbpm double, dgbpm double")
    got = {r["team_id"]: r for r in features.roster(pg, 1, 5.0, impact).collect()}
    assert [got[1][c] for c in ("roster_size", "w_gbpm", "star_gbpm", "star_ppg")] == [3, 3.0, 6.0, 10.0] and abs(got[1]["w_ppg"] - 50 / 3) < 1e-6
    assert [got[2][c] for c in ("roster_size", "w_ppg", "w_gbpm", "star_gbpm")] == [1, 30.0, 0.0, None]


@pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")
def test_matrix_passes_over_players_in_jobs_of_their_own(spark):
    """Disk holds the shuffles of one pass at a time: the matrix itself reads a row a side, and no rows of players."""
    read = checked_box.n8_matchups(spark, DIR).inputFiles()
    assert read and not [f for f in read if re.search(r"/(player-games|box|sales|rolling)-[0-9a-f]{32}/", f)]


@pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")
def test_prediction_deals_players_games_once(spark, monkeypatch):
    """Asked rows join the played ones before recent form is found: the job of the roster shuffles rows of players once."""
    plans = {}
    monkeypatch.setattr(features, "stored", lambda df, name, sweep=False, real=features.stored: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or real(df, name, sweep))
    assert checked_box.q19_predict(spark, DIR).count() == 2
    assert plans["roster"].count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning(player_id" not in plans["roster"]
