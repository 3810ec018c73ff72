"""Latest rows, top rows and ranks that stay distributed under hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwater.session import stored


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: list[str] | None = None) -> DataFrame:
    """One row per key: the newest by ``ts``, ties settled by ``tie`` (largest).

    ``max_by`` combines on the map side, so a key holding most of the rows
    still leaves each task with one row.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in [ts, *(tie or rest)]])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. A literal bound on row_number lets Spark keep
    only ``n`` rows per key and task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def full_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based rank of every row within its key, without gathering a key in one task.

    Rows are range-sorted over the cluster and written down (which fixes their
    place); a rank is the row's place within its slice plus the rows of the
    same key in earlier slices. Only the per-slice counts meet in a window.
    """
    placed = stored(
        df.orderBy(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_place", 33))
    )
    slices = placed.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")
    )
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # Null is a key of its own here.
    own = [*keys, "_slice"]
    slices = slices.select(*[F.col(k).alias(f"_k_{k}") for k in own], "_before", "_first")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in own])
    return placed.join(slices, same).select(
        *df.columns, (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(rank)
    )
