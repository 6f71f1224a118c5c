"""Naming intermediate values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, value, fields) -> DataFrame:
    """Add the columns ``fields(value)``, with ``value`` evaluated once per row.

    The columns come out of a generator of one row, so a later filter on them does not
    push the whole computation below and repeat it.
    """
    return df.select("*", F.inline(F.transform(F.array(value), lambda v: F.struct(*fields(v)))))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
