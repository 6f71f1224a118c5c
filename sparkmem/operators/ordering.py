"""Order-dependent steps that stay parallel when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import unused
from ..sources.staging import stage


def spread_of(df: DataFrame) -> int:
    """How many ways to split a group: the session's shuffle parallelism."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL meets NULL; the keys appear once."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(other[f"_right_{k}"])
    return left.join(other, same).drop(*[f"_right_{k}" for k in keys])


def number_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Add ``position`` (1, 2, … per group in ``order``) and ``group_rows``; without ``keys`` all rows are one group.

    One exchange deals the rows out by ranges of (keys, order), so a group of any size, or a single moment that holds most
    rows, is spread over tasks; ties go by a hash of the row, and only rows that are equal throughout share a
    task for certain. Numbers inside a task are shifted by the rows of the group in the tasks before, of which there is one
    count a task and group. The rows are written down in between, so a lost executor cannot deal them anew; so are the counts, as
    few as they are, so that the rows are not dealt out once more to meet them. NULL keys form groups too; columns of the added
    names are replaced.
    """
    df = df.drop("position", "group_rows")
    tie, at, task, first, n, before = unused(df, "_tie", "_at", "_task", "_first", "_n", "_before")
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    by = [*keys, *order, tie]
    dealt = df.withColumn(tie, F.xxhash64(*plain)).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stage(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()), "numbered")
    # The upper bits of such an id are the task, the lower ones the place in it.
    rows = rows.withColumn(task, F.shiftright(at, 33))
    parts = rows.groupBy(*keys, task).agg(F.min(at).alias(first), F.count("*").alias(n))
    group = Window.partitionBy(*keys)
    earlier = F.sum(n).over(group.orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.withColumns({before: F.coalesce(earlier, F.lit(0)), "group_rows": F.sum(n).over(group)}).drop(n)
    return (
        null_safe_join(rows, stage(shifts, "shifts"), [*keys, task])
        .withColumn("position", F.col(before) + F.col(at) - F.col(first) + 1)
        .drop(at, task, first, before)
    )


def leading_rows(df: DataFrame, keys: list[str], order: list, size, budget: int, tie: list[str]) -> DataFrame:
    """Rows whose predecessors in the group add up to at most ``budget``; adds ``_before``.

    A row inside the budget of its group is inside the budget of any part of the
    group, so salted parts are cut first and only their short heads meet.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(spread_of(df))))
    for part in ([*keys, "_salt"], keys):
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("_before") <= budget)
    return df.drop("_salt")


def top_rows(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group with their rank; Spark cuts each task's input to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
