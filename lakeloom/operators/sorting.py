"""Sorting by a whitelisted field, and pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.exprs import ordered


def sort_by(df: DataFrame, field: str, fields: Mapping[str, str], descending: bool = True, tie: str = "id") -> DataFrame:
    """By a field that `fields` allows (name to column), nulls last in either direction, then by a unique column."""
    if field not in fields:
        raise ValueError(f"{field!r} is no sort field; there are {', '.join(sorted(fields))}")
    return df.orderBy(ordered(fields[field], descending), F.col(tie).asc())


def page(df: DataFrame, limit: int = 50, offset: int = 0, least: int = 1, most: int = 500) -> DataFrame:
    """A page of an ordered frame; the limit is clamped."""
    return df.offset(max(offset, 0)).limit(min(max(limit, least), most))


def client_sort(df: DataFrame, column: str, descending: bool = False, tie: str = "id") -> DataFrame:
    """Numbers by value and text regardless of case, nulls last in either direction."""
    key = F.lower(F.col(column)) if df.schema[column].dataType.simpleString() == "string" else F.col(column)
    return df.orderBy(ordered(key, descending), F.col(tie).asc())
