"""Row filters. They are plain predicates, so Spark pushes them into the scan."""

from __future__ import annotations

import calendar
import operator
import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import computed
from ..functions.expr import instant, strip_text

_COMPARE = {
    "$eq": operator.eq,
    "$ne": operator.ne,
    "$gt": operator.gt,
    "$gte": operator.ge,
    "$lt": operator.lt,
    "$lte": operator.le,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def metadata_predicate(conditions: dict) -> Column:
    """A filter dict as a predicate: column → value, column → {op: value}, $and / $or → list."""
    parts = []
    for key, want in conditions.items():
        if key in ("$and", "$or"):
            join = operator.and_ if key == "$and" else operator.or_
            parts.append(reduce(join, [metadata_predicate(c) for c in want]))
        elif isinstance(want, dict):
            parts += [_COMPARE[op](F.col(key), value) for op, value in want.items()]
        else:
            parts.append(F.col(key) == want)
    return reduce(operator.and_, parts, F.lit(True))


def where_metadata(df: DataFrame, conditions: dict | None) -> DataFrame:
    return df.where(metadata_predicate(conditions)) if conditions else df


def _period_bounds(prefix: str) -> tuple[date, date]:
    if not re.fullmatch(r"\d{4}(-\d{2}(-\d{2})?)?", prefix):
        raise ValueError("period must look like 2026, 2026-05 or 2026-05-10")
    y, m, d = (list(map(int, prefix.split("-"))) + [None, None])[:3]
    first = date(y, m or 1, d or 1)
    if d:
        return first, first + timedelta(days=1)
    days = calendar.monthrange(y, m)[1] if m else 366 if calendar.isleap(y) else 365
    return first, first + timedelta(days=days)


def by_tier_and_period(df: DataFrame, tier: str, prefix: str) -> DataFrame:
    """Rows of a tier created in a year, month or day; a range, so row groups can be skipped."""
    first, end = _period_bounds(prefix)
    created = F.col("created_at")
    return df.where(
        (F.col("tier") == tier) & (created >= instant(first.isoformat())) & (created < instant(end.isoformat()))
    )


def min_importance(df: DataFrame, x: float = 0.3) -> DataFrame:
    return df.where(F.col("importance") >= x)


def exclude_notes(notes: DataFrame, file_names=(), patterns=()) -> DataFrame:
    """Drop notes by file name, and notes whose text contains a pattern in any letter case."""
    kept = notes.where(~F.col("file_name").isin(list(file_names))) if file_names else notes
    if not patterns:
        return kept
    flagged = computed(kept, F.lower("content"), lambda text: [_contains_any(text, patterns).alias("_excluded")])
    return flagged.where(~F.col("_excluded")).drop("_excluded")


def _contains_any(lowered: Column, patterns) -> Column:
    found = [lowered.contains(F.lower(F.lit(p))) for p in patterns]
    return F.coalesce(reduce(operator.or_, found), F.lit(False))


def excluded(file_names=(), patterns=()) -> Column:
    """Whether ``exclude_notes`` drops a note."""
    by_name = F.col("file_name").isin(list(file_names)) if file_names else F.lit(False)
    return by_name | (_contains_any(F.lower("content"), patterns) if patterns else F.lit(False))


def long_enough(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows with at least n characters besides surrounding whitespace."""
    return df.where(F.length(strip_text(column)) >= n)


def expire(df: DataFrame, now, ttl_days: int = 365) -> DataFrame:
    return df.where(F.col("created_at") >= _before(now, ttl_days))


def _before(now, days: int) -> Column:
    return instant(now) - F.make_dt_interval(days=F.lit(days))


def forgettable(now, days: int = 30, importance: float = 0.3) -> Column:
    old = F.col("created_at") < _before(now, days)
    return F.coalesce(old & (F.col("importance") < importance), F.lit(False))


def forget(df: DataFrame, now, days: int = 30, importance: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one-row count of dropped rows): drops what is both old and unimportant."""
    drop = forgettable(now, days, importance)
    return df.where(~drop), df.agg(F.count_if(drop).alias("dropped"))
