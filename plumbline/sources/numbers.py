"""Numbers for rows in the order of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column], into: str = "row_id", by: list[str] | None = None) -> DataFrame:
    """df with rows numbered from 1 by `order`, whose first column is a place in the source such as a split.

    Rows are counted for each first value; within it they are ranked, and counts of earlier ones are
    added. No task sorts more than one split's rows.
    """
    by = by or []
    own = df.withColumn("_split", order[0])
    counts = own.groupBy(*by, "_split").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, "_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    own = own.join(F.broadcast(base), [*by, "_split"])  # a row for each split
    rank = F.row_number().over(Window.partitionBy(*by, "_split").orderBy(*order))
    return own.withColumn(into, (F.col("_base") + rank).cast("long")).drop("_split", "_base")
