"""Joins beyond an equality of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.strings import contains_either_way, normalize_name


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """All columns renamed with a prefix but for `keep`."""
    return df.select(*[F.col(c).alias(c if c in keep else f"{prefix}{c}") for c in df.columns])


def opponent_join(df: DataFrame, game: str = "game_id", team: str = "team_id", opponent: str = "opponent_id", columns: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Each row with `columns` of its opponent's row of the same game, named opp_<column>."""
    opp = df.select(F.col(game).alias("__g"), F.col(team).alias("__t"), *[F.col(c).alias(f"opp_{c}") for c in columns])
    return df.join(opp, (F.col(game) == F.col("__g")) & (F.col(opponent) == F.col("__t")), how).drop("__g", "__t")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """left with the `values` of the last right row of the same key whose time is at or before (strict: before) its own.

    Both sides go into one ordered stream per key and the last right row is carried forward, so the cost is one shuffle and one sort, not
    a product of times. Right rows of equal key and time must be unique; left rows without a match have nulls.
    """
    here = F.struct(*[F.col(c) for c in left.columns])
    there = F.struct(F.col(right_time).alias("__rt"), *[F.col(c) for c in values])
    a = left.select(*by, F.col(left_time).alias("__time"), here.alias("__l"), F.lit(None).cast(right.select(there.alias("s")).schema["s"].dataType).alias("__r"))
    b = right.select(*by, F.col(right_time).alias("__time"), F.lit(None).cast(left.select(here.alias("s")).schema["s"].dataType).alias("__l"), there.alias("__r"))
    # at the same time a right row comes first, or last where only earlier ones count
    side = F.when(F.col("__l").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    seen = F.last("__r", ignorenulls=True).over(W.partitionBy(*by).orderBy("__time", side).rowsBetween(W.unboundedPreceding, 0))
    out = a.unionByName(b).withColumn("__seen", seen).where(F.col("__l").isNotNull())
    return out.select("__l.*", *[F.col(f"__seen.{c}").alias(c) for c in values])


def lookup(facts: DataFrame, dim: DataFrame, keys: dict[str, str], take: dict[str, str], how: str = "left") -> DataFrame:
    """Surrogate keys by natural keys: keys maps fact columns to dim columns, take maps dim columns to new names. Small dims are broadcast
    by size, as Spark's threshold says."""
    d = dim.select(*[F.col(v).alias(f"__k{i}") for i, v in enumerate(keys.values())], *[F.col(c).alias(n) for c, n in take.items()])
    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return facts.join(d, cond, how).drop(*[f"__k{i}" for i in range(len(keys))])


def fuzzy_match(left: DataFrame, right: DataFrame, left_id: str, left_name: str, left_team: str, right_id: str, right_name: str, right_team: str) -> DataFrame:
    """(left_id, right_id, team_match): one right row for each left row of the same normalised name, teams that hold each other's name first,
    then the least right id. Containment is judged once for each two teams of a name, however many rows have them: the least right id stands
    for a name and team, and left rows look up what their name and team found."""
    a = left.select(F.col(left_id), normalize_name(left_name).alias("__n"), F.lower(F.col(left_team)).alias("__ta")).where("__n IS NOT NULL")
    b = right.select(F.col(right_id), normalize_name(right_name).alias("__m"), F.lower(F.col(right_team)).alias("__tb")).where("__m IS NOT NULL")
    least = b.groupBy("__m", "__tb").agg(F.min(F.struct(right_id)).alias("__r"))
    asked = a.select(F.col("__n").alias("__m"), F.col("__ta").alias("__t")).distinct()
    apart = ~F.coalesce(contains_either_way("__t", "__tb"), F.lit(False))
    best = asked.join(least, "__m").groupBy("__m", "__t").agg(F.min(F.struct(apart.alias("apart"), "__r")).alias("__best"))
    found = a.join(best, (F.col("__n") == F.col("__m")) & F.col("__ta").eqNullSafe(F.col("__t"))).groupBy(left_id).agg(F.min("__best").alias("__best"))
    return found.select(left_id, F.col(f"__best.__r.{right_id}").alias(right_id), (~F.col("__best.apart")).alias("team_match"))


def prefix_index(names: DataFrame, name: str, take: Sequence[str]) -> DataFrame:
    """(prefix, take...): for every beginning of a name, in lower case, the row whose name is it, else that of the shortest name, then the least.
    The empty beginning finds the shortest of all. Names are combined before the shuffle, so a beginning that all share is a row a task."""
    low = F.lower(F.col(name))
    rows = names.where(F.col(name).isNotNull()).select(low.alias("__low"), F.struct(F.length(name).alias("n"), F.col(name).alias("name"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(take)]).alias("__row"))
    each = rows.select("__row", "__low", F.explode(F.transform(F.sequence(F.lit(0), F.length("__low")), lambda n: F.substring("__low", F.lit(1), n))).alias("prefix"))
    best = each.groupBy("prefix").agg(F.min(F.struct((F.col("__low") != F.col("prefix")).alias("begins"), "__row"))["__row"].alias("__best"))
    return best.select("prefix", *[F.col(f"__best.t{i}").alias(c) for i, c in enumerate(take)])


def lookup_by_prefix(asked: DataFrame, query: str, index: DataFrame) -> DataFrame:
    """Rows of asked with what the index holds for their query, in any case; rows that find nothing, null ones too, are left out. An equality."""
    return asked.join(index, F.lower(F.col(query)) == F.col("prefix")).drop("prefix")


def prefer(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """first where it is there, else second."""
    return df.withColumn(name, F.coalesce(F.col(first), F.col(second)))


def keep_where_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """IN (SELECT ...)."""
    return df.join(keys.select(*on), list(on), "left_semi")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row aggregate, which is broadcast."""
    return df.crossJoin(F.broadcast(one_row))


def both_sides(games: DataFrame, teams: DataFrame, home: str, away: str, team: str, columns: Sequence[str]) -> DataFrame:
    """games with `columns` of teams for both sides, as home_<c> and away_<c>."""
    out = games
    for side, key in (("home", home), ("away", away)):
        t = teams.select(F.col(team).alias(f"__{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(t, F.col(key) == F.col(f"__{side}"), "left").drop(f"__{side}")
    return out


def any_of(*conditions: Column | None) -> Column:
    """OR over the conditions given; True where none is."""
    given = [c for c in conditions if c is not None]
    out = given[0] if given else F.lit(True)
    for c in given[1:]:
        out = out | c
    return out


def backfill_rebounds(pg: DataFrame, feed: DataFrame, name: str, day: str, feed_name: str, feed_day: str) -> DataFrame:
    """pg with the feed's oreb and dreb where total_rebounds is missing or 0, found by normalised name and day. A name may stand for several
    players; feed rows that lack either number, or repeat a name and day beyond the first by oreb, are left out."""
    f = feed.where("oreb IS NOT NULL AND dreb IS NOT NULL").groupBy(normalize_name(feed_name).alias("__n"), F.col(feed_day).alias("__d")).agg(F.min(F.struct("oreb", "dreb")).alias("__f"))
    j = pg.join(f, (normalize_name(name) == F.col("__n")) & (F.col(day) == F.col("__d")), "left")
    hit = F.col("__f").isNotNull() & (F.coalesce("total_rebounds", F.lit(0)) == 0)
    new = {"off_rebounds": F.col("__f.oreb"), "def_rebounds": F.col("__f.dreb"), "total_rebounds": F.col("__f.oreb") + F.col("__f.dreb")}
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in pg.columns])
