"""Exact quantiles of money amounts per key, spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Amounts are looked up in blocks of this many cents: one window ranks the
# blocks of a key, a second one the cents inside the block that holds the rank.
BLOCK_CENTS = 100_000


def exact_median(df: DataFrame, keys: list[str], amount: str, out: str = "median") -> DataFrame:
    """Median of two-decimal amounts per key (mean of the two middle ones).

    Counting equal amounts first combines on the map side. The built-in exact
    percentile would hold all distinct amounts of a hot key in one task.
    """
    cents = F.round(F.col(amount).cast("decimal(38,2)") * 100, 0).cast("bigint")
    counts = (
        df.filter(F.col(amount).isNotNull())
        .select(*keys, cents.alias("_c"))
        .withColumn("_b", F.floor(F.col("_c") / BLOCK_CENTS).cast("bigint"))
        .groupBy(*keys, "_b", "_c")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    blocks = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    running = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = (
        blocks.withColumn("_end", F.sum("_bn").over(running))
        .withColumn("_total", F.sum("_bn").over(W.partitionBy(*keys)))
        .withColumn("_lo", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_hi", F.floor((F.col("_total") + 2) / 2))
        .withColumn("_start", F.col("_end") - F.col("_bn"))
        .filter(
            F.col("_lo").between(F.col("_start") + 1, F.col("_end"))
            | F.col("_hi").between(F.col("_start") + 1, F.col("_end"))
        )
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_c").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        counts.join(blocks, [*keys, "_b"])
        .withColumn("_to", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_n") + 1)
    )
    pick = lambda r: F.max(F.when(F.col(r).between(F.col("_from"), F.col("_to")), F.col("_c")))
    return ranked.groupBy(*keys).agg(((pick("_lo") + pick("_hi")) / F.lit(200.0)).alias(out))
