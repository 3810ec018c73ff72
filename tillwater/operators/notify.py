"""Forecast notifications: candidates, idempotent insert, listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.functions.ranking import top_per_key
from tillwater.functions.scalars import fixed2, grouped_in, iso_day

# Identity of a notification; dates and metrics may be null and then equal each other.
IDENTITY = ["user_id", "type", "title", "related_metric", "related_date"]
FIELDS = ["user_id", "type", "priority", "title", "message", "related_date", "related_metric"]
DEFAULT_LIMIT, MAX_LIMIT = 20, 100


def candidates(risks: DataFrame, recommendations: DataFrame, explained: DataFrame) -> DataFrame:
    """Risks, advice except planning, and each strong or weak forecast day, numbered in that order."""
    no_date = F.lit(None).cast("date")
    # Defaults, titles and texts.
    from_risks = risks.select(
        "user_id",
        F.lit("risk").alias("type"),
        F.coalesce("level", F.lit("medium")).alias("priority"),
        F.coalesce("title", F.lit("Forecast Risk Alert")).alias("title"),
        F.coalesce("message", F.lit("A forecast risk condition was detected.")).alias("message"),
        no_date.alias("related_date"),
        F.col("type").alias("related_metric"),
        F.struct(F.lit(1).alias("part"), F.col("alert_no").cast("string").alias("no")).alias("seq"),
    )
    from_advice = recommendations.filter(F.col("category") != "planning").select(
        "user_id",
        F.when(F.col("category") == "revenue-opportunity", "forecast").otherwise("recommendation").alias("type"),
        F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce("title", F.lit("Forecast Recommendation")).alias("title"),
        F.coalesce("recommendation", F.lit("A forecast-based recommendation is available.")).alias("message"),
        F.get("supporting_dates", F.lit(0)).cast("date").alias("related_date"),
        F.col("metric").alias("related_metric"),
        F.struct(F.lit(2).alias("part"), F.lpad(F.col("place").cast("string"), 4, "0").alias("no")).alias("seq"),
    )
    high = F.col("revenue_position") == "high"
    head = F.concat(iso_day(F.col("date")), F.lit(" is forecast at ?"), grouped_in(F.col("predicted_revenue")), F.lit(" revenue. "))
    strong = F.concat(
        head, F.lit("Expected orders: "), fixed2(F.coalesce("expected_orders", F.lit(0.0))),
        F.lit(" and predicted AOV: ?"), grouped_in(F.coalesce("predicted_aov", F.lit(0.0))), F.lit("."),
    )
    weak = F.concat(head, F.lit("Consider targeted promotional or retention activity."))
    usable = F.col("revenue_position").isin("high", "low") & F.col("predicted_revenue").isNotNull() & F.col("date").isNotNull()
    from_days = explained.filter(usable).select(
        "user_id",
        F.lit("forecast").alias("type"),
        F.when(high, "low").otherwise("medium").alias("priority"),
        F.when(high, "Strong Forecast Day").otherwise("Weak Forecast Day").alias("title"),
        F.when(high, strong).otherwise(weak).alias("message"),
        F.col("date").cast("date").alias("related_date"),
        F.lit("predictedRevenue").alias("related_metric"),
        F.struct(F.lit(3).alias("part"), iso_day(F.col("date")).alias("no")).alias("seq"),
    )
    return from_risks.unionByName(from_advice).unionByName(from_days)


def split_new(batch: DataFrame, stored: DataFrame, created_at: str) -> tuple[DataFrame, DataFrame]:
    """(created, skipped): new identities once each, and the rest of the batch.

    One writer per table replaces row locks: within the batch the first
    candidate of an identity wins, against the table an anti join on null-safe
    equality finds what is new.
    """
    batch = batch if "seq" in batch.columns else batch.withColumn("seq", F.struct(F.lit(1), F.lit("0")))
    rest = [c for c in batch.columns if c not in IDENTITY]
    firsts = batch.groupBy(*IDENTITY).agg(
        F.min_by(F.struct(*rest), F.struct("seq", "message")).alias("_f"), F.count(F.lit(1)).alias("_n")
    )
    old = stored.select(*[F.col(c).alias(f"_old_{c}") for c in IDENTITY]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in IDENTITY])
    marked = firsts.join(old.withColumn("_known", F.lit(True)), same, "left").select(
        *IDENTITY, "_f.*", "_n", F.coalesce("_known", F.lit(False)).alias("_known")
    )
    created = marked.filter(~F.col("_known")).select(
        *FIELDS, F.lit(False).alias("read"), F.lit(created_at).cast("timestamp").alias("created_at")
    )
    skipped = marked.select(
        *IDENTITY, (F.col("_n") - F.when(F.col("_known"), 0).otherwise(1)).alias("times")
    ).filter("times > 0")
    return created, skipped


def listing(notifications: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest first per tenant."""
    limit = max(1, min(MAX_LIMIT, limit))
    order = [F.desc("created_at"), F.asc("type"), F.asc("title"), F.asc_nulls_first("related_date"), F.asc("related_metric")]
    return top_per_key(notifications, ["user_id"], order, limit)


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("notifications"), F.count_if(~F.col("read")).alias("unread")
    )
