"""Building blocks that keep plans safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """First row of every key, pruned as in ``top_per_key``.

    The columns stay columns (a struct in an aggregate would carry all of them through the shuffle), so that a caller
    pays for those it reads.
    """
    return top_per_key(df, keys, order, 1, rank="_nth").select(*keys, *[c for c in columns if c not in keys])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rn") -> DataFrame:
    """First ``limit`` rows of every key.

    The rank filter sits directly on the window, so Spark prunes each group to
    ``limit`` rows per input partition before the shuffle (window group limit);
    a hot key sends ``limit`` rows per task, not all its rows.
    """
    from pyspark.sql import Window

    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= limit)


def ranked_top(df: DataFrame, order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows overall with their rank (take-ordered, then number the kept rows)."""
    from pyspark.sql import Window

    kept = df.orderBy(*order).limit(limit)
    return kept.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def scalar_max(df: DataFrame, column: str) -> Column:
    """``max(column)`` of a frame as a scalar subquery (partial aggregates, one row)."""
    return df.agg(F.max(column).alias("m")).scalar()


def empty_array(element: T.DataType | str) -> Column:
    name = element if isinstance(element, str) else element.simpleString()
    return F.array().cast(f"array<{name}>")
