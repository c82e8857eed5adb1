"""Scalar expressions over box-score columns. All division is guarded, so nothing raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: Column | str, value: float | int = 0) -> Column:
    return F.coalesce(col(c), F.lit(value))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio_pos(a: Column | str, b: Column | str) -> Column:
    """a / b as double; null unless b > 0."""
    b = col(b).cast("double")
    return F.when(b > 0, col(a).cast("double") / b)


def round_n(c: Column | str, n: int) -> Column:
    """Half away from zero, in double arithmetic that any engine repeats bit by bit; a value within 1e-9 of a half counts as one."""
    c, unit = col(c).cast("double"), float(10**n)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(unit) + F.lit(0.500000001)).cast("double") / F.lit(unit) + F.lit(0.0)


def possessions(fga, oreb, tov, fta) -> Column:
    return col(fga) - col(oreb) + col(tov) + F.lit(0.44) * col(fta)


def game_score(points, fgm, fga, fta, ftm, oreb, dreb, stl, ast, blk, fouls, tov) -> Column:
    """Single-game productivity; missing parts count 0."""
    return (
        nz(points) + 0.4 * nz(fgm) - 0.7 * nz(fga) - 0.4 * (nz(fta) - nz(ftm)) + 0.7 * nz(oreb) + 0.3 * nz(dreb)
        + nz(stl) + 0.7 * nz(ast) + 0.7 * nz(blk) - 0.4 * nz(fouls) - nz(tov)
    )


def efg(fgm, tpm, fga) -> Column:
    return ratio_pos(col(fgm) + 0.5 * col(tpm), fga)


def true_shooting(points, fga, fta) -> Column:
    return ratio_pos(points, 2.0 * (col(fga) + 0.44 * col(fta)))


def turnover_rate(tov, fga, fta) -> Column:
    return ratio_pos(tov, col(fga) + 0.44 * col(fta) + col(tov))


def assist_turnover(ast, tov) -> Column:
    """Assists per turnover; without turnovers, the assists themselves."""
    return F.when(col(tov) > 0, col(ast).cast("double") / col(tov)).otherwise(col(ast).cast("double"))


def win_pct(wins, losses) -> Column:
    """0.5 before the first game."""
    return F.coalesce(ratio_pos(wins, col(wins) + col(losses)), F.lit(0.5))


def wavg_all(x, w) -> Column:
    """Aggregate: weighted mean whose denominator keeps the weights of null values."""
    return ratio(F.sum(col(x) * col(w)), F.sum(col(w)))


def wavg_nonnull(x, w) -> Column:
    """Aggregate: weighted mean over the rows that have a value."""
    return ratio(F.sum(col(x) * col(w)), F.sum(F.when(col(x).isNotNull(), col(w))))


def diff(home, away, flip: bool = False) -> Column:
    """home - away with a missing side as 0; flip where less is better."""
    d = nz(home, 0.0) - nz(away, 0.0)
    return 0.0 - d if flip else d


def pythagorean(scored, allowed, exponent: float = 11.5) -> Column:
    a, b = F.pow(col(scored).cast("double"), F.lit(exponent)), F.pow(col(allowed).cast("double"), F.lit(exponent))
    return ratio_pos(a, a + b)


def similarity(distance) -> Column:
    return 1.0 / (1.0 + col(distance))


def default_season(day) -> Column:
    """A season is named after the year it ends in; it begins in November."""
    return F.year(col(day)) + F.when(F.month(col(day)) >= 11, 1).otherwise(0)


def clip(c, low=None, high=None) -> Column:
    """Within bounds; null stays null."""
    c = col(c)
    if low is not None:
        c = F.when(c < low, F.lit(low)).otherwise(c)
    return F.when(c > high, F.lit(high)).otherwise(c) if high is not None else c


def zero_to_null(c) -> Column:
    return F.nullif(col(c), F.lit(0))


def ordered(c: Column | str, descending: bool = False, nulls_last: bool = True) -> Column:
    """A sort key that always says where nulls go."""
    c = col(c)
    if descending:
        return c.desc_nulls_last() if nulls_last else c.desc_nulls_first()
    return c.asc_nulls_last() if nulls_last else c.asc_nulls_first()


def ladder(value, steps: list[tuple[float, str]], below: str) -> Column:
    """The label of the first step that the value reaches; null stays null."""
    v = col(value)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for least, label in steps:
        out = out.when(v >= least, F.lit(label))
    return out.otherwise(F.lit(below))


def single(c: Column | str) -> Column:
    """In single precision."""
    return col(c).cast("float")
