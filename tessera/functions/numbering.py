"""Consecutive numbers over large frames without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: str, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with numbers by (``group``, ``order``), from ``start`` on.

    ``group`` is the leading part of the order, a position on an axis: rows are sorted inside
    each of its values, and only one count for each value is summed up along the axis.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select(F.col(group).alias("_g"), (F.sum("_n").over(Window.orderBy(group)) - F.col("_n")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.join(ahead, df[group].eqNullSafe(ahead["_g"])).withColumn(name, (F.col("_ahead") + inside + (start - 1)).cast("long")).drop("_g", "_ahead")
