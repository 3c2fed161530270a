"""Connected components of an edge table by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle
from .vptree import forest


def _digest(edges: DataFrame) -> tuple:
    sums = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003))
    return tuple(sums.first())


def _together(edges: DataFrame) -> pa.Table:
    """What star_components returns, found by the driver."""
    table = edges.toArrow()
    ends = [table.column(c).to_numpy() for c in ("u", "v")]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    label = forest(len(nodes), at[: len(ends[0])], at[len(ends[0]) :])
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"u": pa.array(nodes[own], pa.int64()), "v": pa.array(nodes[label[own]], pa.int64())})


def star_components(edges: DataFrame, few: int = 0) -> DataFrame:
    """u, v: each node that is not the least of its component, with that least node.

    edges has columns u and v of one ordered type without nulls; loops and repeats do no harm. Each
    round is two group-and-join passes over the edges, whose number doesn't grow, and is settled;
    rounds grow with the logarithm of the longest path. Minima are taken before rows are joined back,
    so a hub's edges are never gathered, and Spark may split its side of the join. At most `few`
    edges, repeats left out if they are more, between longs, are joined by the driver instead, with the same result.
    """
    own = edges.select("u", "v").where("u <> v")
    if few and edges.count() <= few:  # nothing is dealt out for so few
        return settle(edges.sparkSession.createDataFrame(_together(own)), "edges")
    now = settle(own.distinct(), "edges")
    if few and now.count() <= few:
        found = settle(edges.sparkSession.createDataFrame(_together(now)), "edges")
        forget(now)
        return found
    seen = None
    while (digest := _digest(now)) != seen:
        seen = digest
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        before, now = now, settle(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        forget(before)
    return now
