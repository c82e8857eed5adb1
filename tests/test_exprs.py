"""Formulas with hand-computed values, zero denominators and nulls."""

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import exprs as X
from lakeloom.functions import strings


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lits(*v):
    return [F.lit(x) for x in v]


@pytest.mark.parametrize("fga,oreb,tov,fta,want", [(60, 10, 12, 20, 70.8), (55, 8, 10, 0, 57.0), (0, 0, 0, 0, 0.0)])
def test_possessions(spark, fga, oreb, tov, fta, want):
    assert one(spark, X.possessions(*lits(fga, oreb, tov, fta)))[0] == pytest.approx(want)


def test_game_score(spark):
    full = X.game_score(*lits(20, 8, 15, 4, 2, 2, 5, 1, 5, 1, 2, 3))
    zero = X.game_score(*[F.lit(0)] * 12)
    bad = X.game_score(*lits(0, 0, 5, 0, 0, 0, 1, 0, 0, 0, 4, 4))
    none = X.game_score(*[F.lit(None).cast("int")] * 12)
    assert [round(x, 6) for x in one(spark, full, zero, bad, none)] == [16.2, 0, -8.8, 0]


def test_shooting(spark):
    r = one(spark, X.efg(*lits(8, 2, 15)), X.efg(*lits(8, 0, 15)), X.efg(*lits(0, 0, 0)), X.true_shooting(*lits(20, 15, 4)), X.true_shooting(*lits(0, 0, 0)), X.true_shooting(*lits(10, 0, 10)))
    assert r[0] == pytest.approx(0.6) and r[1] == pytest.approx(0.5333, abs=1e-4) and r[2] is None
    assert r[3] == pytest.approx(0.5966, abs=1e-4) and r[4] is None and r[5] == pytest.approx(1.1364, abs=1e-4)


def test_turnovers_and_assists(spark):
    r = one(spark, X.turnover_rate(*lits(3, 15, 4)), X.turnover_rate(*lits(0, 0, 0)), X.turnover_rate(*lits(5, 0, 0)), X.assist_turnover(*lits(6, 3)), X.assist_turnover(*lits(5, 0)), X.assist_turnover(*lits(0, 0)))
    assert r[0] == pytest.approx(0.1518, abs=1e-4) and r[1] is None and r[2] == 1.0 and list(r[3:]) == [2, 5, 0]


def test_win_pct_and_diff(spark):
    none = F.lit(None).cast("double")
    r = one(spark, X.win_pct(*lits(15, 15)), X.win_pct(*lits(0, 0)), X.win_pct(*lits(30, 0)), X.diff(*lits(110.0, 100.0)), X.diff(F.lit(5.0), none), X.diff(none, F.lit(5.0)), X.diff(none, none))
    assert list(r) == [0.5, 0.5, 1.0, 10, 5, -5, 0]


def test_rounding_is_half_away_from_zero(spark):
    assert list(one(spark, *[X.round_n(F.lit(x), 1) for x in (2.25, 2.35, -0.25, 0.15, -0.04)])) == [2.3, 2.4, -0.3, 0.2, 0.0]
    assert list(one(spark, X.round_n(F.lit(None).cast("double"), 1))) == [None]


@pytest.mark.parametrize("name,want", [("Roddy Gayle Jr", "roddy gayle"), ("D.J. Wagner", "dj wagner"), ("D’Angelo Russell", "dangelo russell"), ("Someone V", "someone"), ("COOPER FLAGG", "cooper flagg"), ("a   b  III", "a b"), (None, None)])
def test_names(spark, name, want):
    assert one(spark, strings.normalize_name(F.lit(name).cast("string")))[0] == want


def test_heights_dates_flags(spark):
    r = one(spark, *[strings.height_strict(F.lit(h)) for h in ("6-5", "6 - 5", "5-10", "7-1", "six-five", "75")], *[strings.height_lenient(F.lit(h)) for h in ("6-4", "6'4", "abc")])
    assert list(r) == [77, 77, 70, 85, None, None, 76, 76, None]
    d = one(spark, *[strings.feed_date(F.lit(x)) for x in ("2026-01-31", "20260131", "0000-00-00", "soon")], *[strings.flag(F.lit(x)) for x in ("Y", "1", "0", "no", None)])
    assert [str(x) for x in d[:4]] == ["2026-01-31", "2026-01-31", "None", "None"] and list(d[4:]) == [True, True, False, False, None]


def test_json_numbers(spark):
    got = [one(spark, strings.json_number(F.lit(j), *k))[0] for j, k in (('{"min":32.5}', ("min", "mp")), ('{"mp":28.0}', ("min", "mp")), ('{"pts":"25"}', ("pts",)), ('{"other":1}', ("min",)), ('{"min":"x","mp":3}', ("min", "mp")))]
    assert got == [32.5, 28.0, 25.0, None, 3.0]
    assert [one(spark, strings.json_number(F.lit(j), "k", kind="int"))[0] for j in ('{"k":42}', '{"k":"7"}', '{"k":3.9}', '{"k":""}', '{"k":null}')] == [42, 7, 3, None, None]
