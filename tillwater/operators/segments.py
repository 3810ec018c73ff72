"""Customer segments: standardised features, k-means with restarts, ranked names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwater.functions.scalars import exact_sum, rounded
from tillwater.session import stored

AXES = ["recency", "frequency", "monetary", "average_order_value"]
POINT = [f"x{i}" for i in range(len(AXES))]
# Clusters, restarts, rounds and the squared shift (in standard deviations) that ends them.
MAX_CLUSTERS, RESTARTS, MAX_ROUNDS, TOLERANCE = 3, 10, 300, 1e-4
UNIT = 1_000_000
# Names by rank.
NAMES = ["High Value", "Regular", "At Risk"]
DEFAULT_NAME = "Regular"


class BadFeatures(ValueError):
    pass


def usable(features: DataFrame) -> DataFrame:
    """Fail on missing or infinite features."""
    bad = F.lit(False)
    for c in AXES:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if features.filter(bad).limit(1).count():
        raise BadFeatures("features must be finite numbers")
    return features


def scaled(features: DataFrame) -> DataFrame:
    """Features in millionths of their tenant's standard deviation from its mean, as whole numbers; a constant axis is 0.

    Sums of whole numbers are exact, so clusters don't depend on the order of rows.
    """
    stats = features.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), *[
        f(c).alias(f"_{name}_{c}") for c in AXES for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))
    ])
    place = lambda c: F.when(
        F.col(f"_high_{c}") > F.col(f"_low_{c}"),
        F.floor((F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}") * UNIT + 0.5).cast("long"),
    ).otherwise(F.lit(0).cast("long"))
    return features.join(stats.filter("_n >= 2"), "user_id").select(
        "user_id", "customer_id", *AXES, *[place(c).alias(f"x{i}") for i, c in enumerate(AXES)]
    )


def _centre(i: int) -> list[Column]:
    """Columns of centre number ``i``; null where a tenant has fewer customers."""
    return [F.col(f"c{i}_{x}") for x in POINT]


def _columns(k: int) -> list[str]:
    return [f"c{i}_{x}" for i in range(k) for x in POINT]


def first_centres(points: DataFrame, k: int, restarts: int) -> DataFrame:
    """Centres (columns ``c0_x0``, ...) of each tenant and restart, ``k`` customers at most.

    Even restarts draw those whose ids have the smallest hashes with the restart's number. Odd ones draw one so, and go on
    with the customer farthest from all centres so far.
    """
    key = F.md5(F.concat(F.col("restart").cast("string"), F.lit(":"), F.col("customer_id").cast("string")))
    drawn = points.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    order = W.partitionBy("user_id", "restart").orderBy(key, "customer_id")
    drawn = drawn.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= k)
    drawn = drawn.filter((F.col("restart") % 2 == 0) | (F.col("_nth") == 1))
    state = stored(drawn.groupBy("user_id", "restart").agg(*[
        F.max(F.when(F.col("_nth") == i + 1, F.col(x))).alias(f"c{i}_{x}") for i in range(k) for x in POINT
    ]))
    for i in range(1, k):
        # The largest distance first, which hash aggregation finds; few customers lie that far, and only these are compared by key.
        far = measured(points.join(state.filter("restart % 2 = 1"), "user_id"), k)
        most = stored(far.groupBy("user_id", "restart").agg(F.max("_d").alias("_most")))
        far = far.join(most, ["user_id", "restart"]).filter(F.col("_d") == F.col("_most"))
        far = far.groupBy("user_id", "restart").agg(F.max_by(F.struct(*POINT), key).alias("_more"))
        own = [F.coalesce(F.col(f"c{i}_{x}"), F.col(f"_more.{x}")).alias(f"c{i}_{x}") for x in POINT]
        rest = [c for c in _columns(k) if not c.startswith(f"c{i}_")]
        odd = F.col("restart") % 2 == 1
        more = [F.when(odd, c).otherwise(F.col(f"c{i}_{x}")).alias(f"c{i}_{x}") for c, x in zip(own, POINT)]
        state = stored(state.join(far, ["user_id", "restart"], "left").select("user_id", "restart", *rest, *more))
    return state


def measured(df: DataFrame, k: int) -> DataFrame:
    """Rows of points and centres with the distances ``_d0``, ... and the least one, ``_d``."""
    away = {}
    for i in range(k):
        parts = [(F.col(x) - c).cast("double") for x, c in zip(POINT, _centre(i))]
        away[f"_d{i}"] = sum((d * d for d in parts[1:]), parts[0] * parts[0])
    return df.withColumns(away).withColumn("_d", F.least(*away) if k > 1 else F.col("_d0"))


def nearest(k: int) -> Column:
    """Number of the nearest of ``k`` centres of ``measured`` rows; the first one where several are as near."""
    number = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        number = F.when(F.col(f"_d{i}") == F.col("_d"), F.lit(i)).otherwise(number)
    return number


def next_centres(points: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """The means of the customers nearest to each centre, and whether a restart is ``going`` on."""
    found = measured(points.join(state, "user_id"), k).select("user_id", "restart", *POINT, nearest(k).alias("i"))
    sums = found.groupBy("user_id", "restart", "i").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in POINT])
    mean = lambda c: F.floor(F.col(c) / F.col("n") + 0.5).cast("long")
    new = sums.groupBy("user_id", "restart").agg(*[
        F.max(F.when(F.col("i") == i, mean(x))).alias(f"_new{i}_{x}") for i in range(k) for x in POINT
    ])
    # A centre that nobody is nearest to stays where it is.
    moved = {f"c{i}_{x}": F.coalesce(f"_new{i}_{x}", f"c{i}_{x}") for i in range(k) for x in POINT}
    shift = F.lit(0.0)
    for i in range(k):
        apart = [(F.col(c) - moved[c]).cast("double") for c in (f"c{i}_{x}" for x in POINT)]
        shift = shift + F.coalesce(sum((d * d for d in apart[1:]), apart[0] * apart[0]), F.lit(0.0))
    return state.join(new, ["user_id", "restart"]).select(
        "user_id", "restart", *[m.alias(c) for c, m in moved.items()], (shift > TOLERANCE * UNIT * UNIT).alias("going")
    )


def cluster(features: DataFrame, k: int = MAX_CLUSTERS, restarts: int = RESTARTS) -> DataFrame:
    """K-means of each tenant's customers; the best of several restarts is kept.

    All tenants and restarts go through Lloyd's iteration together: a round assigns every customer for every restart
    that still moves, and one grouped sum, combined before the shuffle, gives the next centres. Centres are plain columns,
    which Spark compiles, and the points are dealt to all cores once. Tenants with one customer are left out; without
    any other tenant that is an error.
    """
    cores = features.sparkSession.sparkContext.defaultParallelism
    points = stored(scaled(usable(stored(features))).repartition(cores, "user_id", "customer_id"))
    if not points.limit(1).count():
        raise BadFeatures("at least two customers are needed")
    state = first_centres(points, k, restarts)
    settled = None
    for turn in range(MAX_ROUNDS):
        step = next_centres(points, state, k)
        step = stored(step)
        last = F.lit(True) if turn == MAX_ROUNDS - 1 else ~F.col("going")
        done = step.filter(last).drop("going")
        settled = done if settled is None else settled.unionByName(done)
        state = step.filter(~last).drop("going")
        if not state.limit(1).count():
            break
    settled = stored(settled)
    assigned = measured(points.join(settled, "user_id"), k)
    cost = assigned.groupBy("user_id", "restart").agg(F.sum(F.col("_d").cast("decimal(38,0)")).alias("_cost"))
    best = cost.groupBy("user_id").agg(F.min_by("restart", F.struct("_cost", "restart")).alias("restart"))
    chosen = stored(settled.join(best, ["user_id", "restart"]).drop("restart"))
    return measured(points.join(chosen, "user_id"), k).select("user_id", "customer_id", *AXES, nearest(k).alias("cluster"))


def name_clusters(clustered: DataFrame) -> DataFrame:
    """Names by mean(monetary) + 100 mean(frequency) - 10 mean(recency), best first, per tenant."""
    mean = lambda c: exact_sum(F.col(c)).cast("double") / F.count(F.lit(1))
    score = mean("monetary") + 100 * mean("frequency") - 10 * mean("recency")
    profile = clustered.groupBy("user_id", "cluster").agg(score.alias("score"))
    # At most three rows per tenant.
    ranked = profile.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cluster"))).alias("_r")
    ).select("user_id", F.posexplode("_r").alias("_place", "_c"))
    names = F.array(*[F.lit(x) for x in NAMES])
    return ranked.select(
        "user_id",
        F.col("_c.cluster").alias("cluster"),
        F.get(names, F.least(F.col("_place"), F.lit(len(NAMES) - 1))).alias("segment_name"),
        (-F.col("_c.s")).alias("score"),
    )


def segment(features: DataFrame, created_at: str, **options) -> DataFrame:
    """Segments of the customers of every tenant."""
    clustered = stored(cluster(features, **options))
    return clustered.join(name_clusters(clustered), ["user_id", "cluster"]).select(
        "user_id",
        "customer_id",
        "segment_name",
        F.col("cluster").alias("cluster_number"),
        rounded(F.col("score"), 4).alias("score"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )


def accepted(assignments: DataFrame, known: DataFrame) -> DataFrame:
    """Assignments of known customers, with default name and number."""
    return assignments.join(known, ["user_id", "customer_id"], "left_semi").withColumns(
        {
            "segment_name": F.coalesce("segment_name", F.lit(DEFAULT_NAME)),
            "cluster_number": F.coalesce("cluster_number", F.lit(0)),
        }
    )
