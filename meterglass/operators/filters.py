"""Row filters over messages and days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_sources(df: DataFrame, sources: list[str] | None) -> DataFrame:
    """Rows of the named sources; None is all of them, an empty list none."""
    return df if sources is None else df.filter(F.col("source").isin(list(sources)))


def by_date(df: DataFrame, since: date | str | None = None, until: date | str | None = None, year: int | str | None = None) -> DataFrame:
    """Rows whose date is in the year and between the ends, both included; what is None doesn't count."""
    conditions: list[Column] = []
    if year is not None:
        conditions.append(F.year("date") == int(year))
    if since is not None:
        conditions.append(F.col("date") >= F.lit(str(since)).cast("date"))
    if until is not None:
        conditions.append(F.col("date") <= F.lit(str(until)).cast("date"))
    for c in conditions:
        df = df.filter(c)
    return df


def shortcut(as_of: date, today: bool = False, week: bool = False, month: bool = False) -> dict[str, date]:
    """``since`` and ``until`` of the named span that ends as of a day; today goes before week, week before month."""
    if today:
        return {"since": as_of, "until": as_of}
    if week:
        return {"since": as_of - timedelta(days=6), "until": as_of}
    if month:
        return {"since": as_of.replace(day=1), "until": as_of}
    return {}


def by_period(df: DataFrame, period: str, as_of: str, column: str = "created_at") -> DataFrame:
    """Rows of the week or month before a moment, both ends included; ``all`` is everything."""
    if period == "all":
        return df
    now = F.lit(as_of).cast(df.schema[column].dataType)
    start = now - F.expr({"week": "interval 7 days", "month": "interval 1 month"}[period])
    return df.filter(F.col(column).between(start, now))


def last_days(df: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    return df.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def without_synthetic(df: DataFrame, model: str = "model_id") -> DataFrame:
    return df.filter(F.col(model) != "<synthetic>")
