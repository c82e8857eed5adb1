"""Names, heights, dates, flags and JSON numbers as they come from feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.exprs import col


def normalize_name(c) -> Column:
    """Lower case without . ' and typographic apostrophe; one trailing generation suffix goes; single spaces."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(col(c), "[.'’]", "")), r"\s+", " "))
    return F.regexp_replace(plain, r" (?:jr|sr|ii|iii|iv|v)$", "")


def height_strict(c) -> Column:
    """`6-5` to inches; anything but two whole numbers is null."""
    p = F.split(col(c), "-")
    return F.when(F.size(p) == 2, F.trim(F.get(p, F.lit(0))).try_cast("int") * 12 + F.trim(F.get(p, F.lit(1))).try_cast("int"))


def height_lenient(c) -> Column:
    """Feet and inches parted by - ' " or a space."""
    p = F.filter(F.split(col(c), "[-'\" ]"), lambda x: x != "")
    return F.get(p, F.lit(0)).try_cast("int") * 12 + F.get(p, F.lit(1)).try_cast("int")


def feed_date(c) -> Column:
    """2026-01-31 or 20260131; 0000-00-00 and what is no date are null."""
    s = F.nullif(F.trim(col(c)), F.lit("0000-00-00"))
    dashed = F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))
    return F.coalesce(dashed, F.try_to_timestamp(s, F.lit("yyyyMMdd"))).cast("date")


def flag(c) -> Column:
    """true, Y, 1 and other whole numbers than 0 as text."""
    s = F.upper(F.trim(col(c).cast("string")))
    return F.when(s.isNull(), F.lit(None).cast("boolean")).otherwise(s.isin("Y", "TRUE") | F.coalesce(s.try_cast("int") != 0, F.lit(False)))


def json_number(json, *keys: str, kind: str = "double") -> Column:
    """The first of the keys that holds a number or a number as text."""
    c = col(json)
    values = [F.get_json_object(c, f"$['{k}']") for k in keys]
    return F.coalesce(*[v.try_cast(kind) if kind != "int" else v.try_cast("double").try_cast("int") for v in values])


def contains_either_way(a, b) -> Column:
    """Either text holds the other; null where either is null."""
    return F.contains(col(a), col(b)) | F.contains(col(b), col(a))
