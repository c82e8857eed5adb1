"""Box-score tables drawn from the star schema, so that every step runs on data of any size.

A supplier is a player of its nation's team, a customer nation is the opponent, and what a nation sells to another in a month is its
side of a game. Counts are taken from sums modulo small numbers; some are null. All of it is whole numbers, so any engine gives the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import stored

BOX = ["minutes", "points", "fgm", "fga", "tpm", "tpa", "ftm", "fta", "off_rebounds", "def_rebounds", "total_rebounds", "assists", "steals", "blocks", "turnovers", "fouls"]
KEYS = ["player_id", "team_id", "opponent_id", "game_id", "season", "game_date"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What players sold by opponent and month. Orders meet customers first, and suppliers come last, so that lines are shuffled by order and by player only:
    sums by player need no shuffle of their own."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    line = read("lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderdate")
    supplier = read("supplier", "s_suppkey", F.col("s_nationkey").alias("team_id"))
    customer = read("customer", "c_custkey", F.col("c_nationkey").alias("opponent_id"))
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "opponent_id", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ym"))
    sold = line.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "opponent_id", "ym", "l_quantity", "l_extendedprice")
    sold = sold.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).where("team_id <> opponent_id")
    sums = sold.groupBy(F.col("l_suppkey").alias("player_id"), "team_id", "opponent_id", "ym").agg(F.sum("l_quantity").cast("long").alias("q"), F.round(F.sum("l_extendedprice") * 100).cast("long").alias("p"))
    y = F.floor(F.col("ym") / 100).cast("int")
    game = F.concat_ws("-", F.least("team_id", "opponent_id"), F.greatest("team_id", "opponent_id"), "ym")
    return sums.select("player_id", "team_id", "opponent_id", game.alias("game_id"), y.alias("season"), F.make_date(y, F.col("ym") % 100, F.lit(1)).alias("game_date"), "q", "p")


def _drawn(b: DataFrame) -> DataFrame:
    """Box scores of rows with q and p: KEYS, BOX, starter, q and what else b has."""
    rest = [c for c in b.columns if c not in (*KEYS, "q", "p")]
    q, p = F.col("q"), F.col("p")
    b = b.withColumn("fga", 1 + q % 17).withColumn("fgm", F.least(F.col("fga"), p % 9)).withColumn("tpm", F.least(F.col("fgm"), p % 4)).withColumn("fta", p % 8).withColumn("ftm", F.least(F.col("fta"), q % 6))
    b = b.withColumn("tpa", F.col("tpm") + q % 3).withColumn("off_rebounds", q % 5)
    total = F.when(p % 11 == 0, F.lit(None)).when(p % 13 == 0, 0).otherwise(F.col("off_rebounds") + p % 9).cast("long")
    return b.select(
        *KEYS, F.when(q % 29 != 0, (q % 40).cast("double")).alias("minutes"), F.when(p % 37 != 0, 2 * F.col("fgm") + F.col("tpm") + F.col("ftm")).alias("points"), "fgm", "fga", "tpm", "tpa", "ftm", "fta", "off_rebounds",
        F.lit(None).cast("long").alias("def_rebounds"), total.alias("total_rebounds"), (p % 8).alias("assists"), (p % 3).alias("steals"), (q % 3).alias("blocks"), (q % 6).alias("turnovers"), (p % 5).alias("fouls"), (q % 2 == 0).alias("starter"), "q", *rest,
    )


class BoxScores:
    """Tables as they are asked for. What players sold by game is joined and summed once and stored, as are the sides of games."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def teams(self) -> DataFrame:
        """(team_id, name, conference)"""
        return self._read("nation").join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name"), F.col("r_name").alias("conference"))

    @cached_property
    def players(self) -> DataFrame:
        """(player_id, name, team_id)"""
        return self._read("supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("team_id"))

    @cached_property
    def _sales(self) -> DataFrame:
        """(KEYS..., q, p): all that rows are drawn from, so that what is stored and shuffled stays narrow."""
        return stored(_lines(self.spark, self.sf_dir), "sales", sweep=True)

    @cached_property
    def _box(self) -> DataFrame:
        return _drawn(self._sales)

    @cached_property
    def team_games(self) -> DataFrame:
        both = F.sum(F.coalesce("total_rebounds", "off_rebounds"))
        known = F.sum("q") % 4 != 0
        side = self._box.groupBy("team_id", "opponent_id", "game_id", "season", "game_date").agg(
            F.when(F.sum("q") % 7 != 0, 200 + 25 * (F.sum("q") % 3)).alias("minutes"), *[F.sum(c).alias(c) for c in BOX[1:9]],
            F.when(known, both - F.sum("off_rebounds")).alias("def_rebounds"), F.when(known, both).alias("total_rebounds"), *[F.sum(c).alias(c) for c in BOX[11:]],
        )
        return stored(side.withColumn("is_home", F.col("team_id") < F.col("opponent_id")), "sides", sweep=True)

    @cached_property
    def marked_player_games(self) -> DataFrame:
        """player_games with `fake` (see steps.fill_player_games). What a game says of its rows is one stored table with a row a side, so that they meet it in one join."""
        fake = self._box.groupBy("game_id").agg(F.max(F.expr(UNRECORDED)).alias("fake"))
        context = self.team_games.select("game_id", "team_id", *[F.col(c).alias(f"team_{c}") for c in CONTEXT]).join(fake, "game_id", "left")
        return _drawn(self._sales.join(stored(context, "context"), ["game_id", "team_id"])).drop("q")

    @cached_property
    def player_games(self) -> DataFrame:
        return self.marked_player_games.drop("fake")


#: What a player's row holds of its team's.
CONTEXT = ("fga", "fta", "turnovers", "fgm", "minutes")
#: A row whose total rebounds were not recorded: it makes totals of 0 in its game doubtful.
UNRECORDED = "total_rebounds IS NULL AND coalesce(off_rebounds > 0, false)"


def box_scores(spark: SparkSession, sf_dir: str) -> BoxScores:
    return BoxScores(spark, sf_dir)


#: The same tables as CTEs for DuckDB: teams, players, pg (player games), tg (team games).
SQL = """
teams AS (SELECT n_nationkey AS team_id, n_name AS name, r_name AS conference FROM nation JOIN region ON n_regionkey = r_regionkey),
players AS (SELECT s_suppkey AS player_id, s_name AS name, s_nationkey AS team_id FROM supplier),
sold AS (
  SELECT l_suppkey AS player_id, s_nationkey AS team_id, c_nationkey AS opponent_id,
    least(s_nationkey, c_nationkey) || '-' || greatest(s_nationkey, c_nationkey) || '-' || (year(o_orderdate) * 100 + month(o_orderdate)) AS game_id,
    CAST(year(o_orderdate) AS INTEGER) AS season, make_date(year(o_orderdate), month(o_orderdate), 1) AS game_date,
    CAST(SUM(l_quantity) AS BIGINT) AS q, CAST(ROUND(SUM(l_extendedprice) * 100) AS BIGINT) AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY ALL
), made AS (
  SELECT *, 1 + q % 17 AS fga, least(1 + q % 17, p % 9) AS fgm, least(1 + q % 17, p % 9, p % 4) AS tpm, p % 8 AS fta, least(p % 8, q % 6) AS ftm, q % 5 AS off_rebounds FROM sold
), box AS (
  SELECT player_id, team_id, opponent_id, game_id, season, game_date, q, CASE WHEN q % 29 <> 0 THEN CAST(q % 40 AS DOUBLE) END AS minutes,
    CASE WHEN p % 37 <> 0 THEN 2 * fgm + tpm + ftm END AS points, fgm, fga, tpm, tpm + q % 3 AS tpa, ftm, fta, off_rebounds, CAST(NULL AS BIGINT) AS def_rebounds,
    CASE WHEN p % 11 = 0 THEN NULL WHEN p % 13 = 0 THEN 0 ELSE off_rebounds + p % 9 END AS total_rebounds,
    p % 8 AS assists, p % 3 AS steals, q % 3 AS blocks, q % 6 AS turnovers, p % 5 AS fouls, q % 2 = 0 AS starter
  FROM made
), tg0 AS (
  SELECT team_id, opponent_id, game_id, season, game_date, CASE WHEN SUM(q) % 7 <> 0 THEN 200 + 25 * (SUM(q) % 3) END AS minutes,
    CAST(SUM(points) AS BIGINT) AS points, CAST(SUM(fgm) AS BIGINT) AS fgm, CAST(SUM(fga) AS BIGINT) AS fga, CAST(SUM(tpm) AS BIGINT) AS tpm, CAST(SUM(tpa) AS BIGINT) AS tpa, CAST(SUM(ftm) AS BIGINT) AS ftm, CAST(SUM(fta) AS BIGINT) AS fta, CAST(SUM(off_rebounds) AS BIGINT) AS off_rebounds,
    CASE WHEN SUM(q) % 4 <> 0 THEN SUM(COALESCE(total_rebounds, off_rebounds)) - SUM(off_rebounds) END AS def_rebounds,
    CASE WHEN SUM(q) % 4 <> 0 THEN SUM(COALESCE(total_rebounds, off_rebounds)) END AS total_rebounds,
    SUM(assists) AS assists, SUM(steals) AS steals, SUM(blocks) AS blocks, SUM(turnovers) AS turnovers, SUM(fouls) AS fouls, team_id < opponent_id AS is_home
  FROM box GROUP BY team_id, opponent_id, game_id, season, game_date
), pg0 AS (
  SELECT b.*, t.fga AS team_fga, t.fta AS team_fta, t.turnovers AS team_turnovers, t.fgm AS team_fgm, t.minutes AS team_minutes FROM box b JOIN tg0 t ON b.game_id = t.game_id AND b.team_id = t.team_id
)"""
