"""Column functions over dates, JSON and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_bucket(ts: Column, unit: str) -> Column:
    """day (a date), minute (HH:mm) or week: weeks of a year that begin on Mondays, the days before the first one in week 0."""
    if unit == "week":
        monday = (F.dayofweek(ts) + 5) % 7
        return F.floor((F.dayofyear(ts) + 6 - monday) / 7).cast("int")
    return {"day": F.to_date(ts), "minute": F.date_format(ts, "HH:mm")}[unit]


def json_fields(c: Column, schema: str) -> Column:
    """Typed fields of a JSON object; null where the text is none or a value has another type."""
    return F.from_json(c, schema)


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    c = c if low is None else F.greatest(F.lit(low), c)
    return c if high is None else F.least(F.lit(high), c)


def weighted_sum(parts: list[tuple[float, Column]]) -> Column:
    """Missing parts count 0."""
    return reduce(lambda a, b: a + b, (w * F.coalesce(c, F.lit(0.0)) for w, c in parts))


def clean_stats(raw: Column, cleaned: Column) -> Column:
    """before, after: characters; lines, lines_after; reduction in percent, 0 where the text was empty."""
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    share = F.when(F.length(raw) > 0, F.bround((1 - F.length(cleaned) / F.length(raw)) * 100, 1)).otherwise(0.0)
    return F.struct(F.length(raw).alias("before"), F.length(cleaned).alias("after"), lines(raw).alias("lines"), lines(cleaned).alias("lines_after"), share.alias("reduction"))
