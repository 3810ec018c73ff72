"""Stored runs: an append-only ledger of model results, tables published by a pointer, notifications, and a name index.

All write folders that no reader looks at yet, and then the small row or pointer that names them, so readers see all of a
run or nothing of it, and a run that is repeated under its own name replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwater.functions.ranking import latest_per_key
from tillwater.operators import notify
from tillwater.session import stored
from tillwater.sources.schemas import NOTIFICATIONS


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


class RunLedger:
    """Results of model runs by kind, and one row a run and tenant."""

    RUNS = "user_id string, kind string, at timestamp, rows long, run string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def record(self, kind: str, run: str, at: str, results: DataFrame) -> None:
        """Keep the results of a run. ``run`` names it; ``at`` is its time."""
        where = f"{self.root}/results/{kind}/run={run}"
        results.write.mode("overwrite").parquet(where)
        kept = self.spark.read.parquet(where)
        rows = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows")).select(
            "user_id", F.lit(kind).alias("kind"), F.lit(at).cast("timestamp").alias("at"), "rows"
        )
        rows.write.mode("overwrite").parquet(f"{self.root}/runs/run={kind}-{run}")

    def runs(self, kind: str | None = None) -> DataFrame:
        """``user_id``, ``kind``, ``at``, ``rows``, ``run``."""
        if not children(self.spark, f"{self.root}/runs"):
            return self.spark.createDataFrame([], self.RUNS)
        found = self.spark.read.schema(self.RUNS).parquet(f"{self.root}/runs")
        found = found.withColumn("run", F.substring("run", F.length("kind") + 2, F.length("run")))
        return found if kind is None else found.filter(F.col("kind") == kind)

    def history(self, kind: str) -> DataFrame:
        """Results of all recorded runs of a kind, with ``run``."""
        names = children(self.spark, f"{self.root}/results/{kind}")
        like = self.spark.read.parquet(f"{self.root}/results/{kind}/{names[-1]}").schema
        found = self.spark.read.schema(T.StructType([*like.fields, T.StructField("run", T.StringType())]))
        # A run counts from its rows in the ledger on.
        return found.parquet(f"{self.root}/results/{kind}").join(self.runs(kind).select("user_id", "run"), ["user_id", "run"], "left_semi")

    def latest(self, kind: str) -> DataFrame:
        """Results of each tenant's latest run of a kind."""
        newest = latest_per_key(self.runs(kind).select("user_id", "run", "at"), ["user_id"], "at", ["run"])
        return self.history(kind).join(newest.select("user_id", "run"), ["user_id", "run"], "left_semi")


class Published:
    """A result table whose tenants are replaced all at once: a pointer names the version of each."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _pointer(self) -> DataFrame:
        names = [n for n in children(self.spark, f"{self.root}/pointer") if children(self.spark, f"{self.root}/pointer/{n}")[:1] == ["_SUCCESS"]]
        like = "user_id string, version string"
        return self.spark.read.schema(like).parquet(f"{self.root}/pointer/{names[-1]}") if names else self.spark.createDataFrame([], like)

    def replace(self, df: DataFrame, tenants: DataFrame | None = None) -> None:
        """Rows for the tenants in ``df`` and for those of ``tenants`` (recomputed ones, maybe without rows); others keep theirs."""
        old = self._pointer()
        number = len(children(self.spark, f"{self.root}/pointer"))
        version = f"n{number:08}"
        spread = F.pmod(F.xxhash64(*df.columns), F.lit(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        out = df.repartition("user_id", spread).write.mode("overwrite").partitionBy("user_id")
        out.parquet(f"{self.root}/rows/version={version}")
        own = self._rows().filter(F.col("version") == version).select("user_id").distinct()
        gone = own if tenants is None else own.union(tenants.select("user_id")).distinct()
        pointer = old.join(gone, "user_id", "left_anti").unionByName(own.withColumn("version", F.lit(version)))
        pointer.write.mode("overwrite").parquet(f"{self.root}/pointer/{version}")

    def _rows(self) -> DataFrame:
        rest = [f for f in self.schema.fields if f.name != "user_id"]
        typed = T.StructType([*rest, T.StructField("version", T.StringType()), T.StructField("user_id", T.StringType())])
        return self.spark.read.schema(typed).parquet(f"{self.root}/rows")

    def read(self) -> DataFrame:
        if not children(self.spark, f"{self.root}/pointer"):
            return self.spark.createDataFrame([], self.schema)
        return self._rows().join(self._pointer(), ["user_id", "version"], "left_semi").select(*self.schema.names)


class NotificationStore:
    """Notifications in hash buckets of their identity; a run reads the buckets it touches and adds what is new."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self) -> Column:
        # The hash passes over nulls, so equal identities with nulls share a bucket.
        return F.pmod(F.xxhash64(*notify.IDENTITY), F.lit(self.buckets)).cast("int")

    def read(self, touched: list[int] | None = None, but: str | None = None) -> DataFrame:
        """All notifications, or those in ``touched`` buckets of runs other than ``but``."""
        if not children(self.spark, f"{self.root}/runs"):
            return self.spark.createDataFrame([], NOTIFICATIONS)
        typed = T.StructType([*NOTIFICATIONS.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
        found = self.spark.read.schema(typed).parquet(f"{self.root}/runs")
        if touched is not None:
            found = found.filter(F.col("bucket").isin(touched))
        return (found if but is None else found.filter(F.col("run") != but)).select(*NOTIFICATIONS.names)

    def insert(self, batch: DataFrame, run: str, created_at: str) -> tuple[DataFrame, DataFrame]:
        """(created, skipped) of a batch of candidates. The same run again gives the same and stores nothing twice."""
        batch = stored(batch.withColumn("_bucket", self._bucket()))
        touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())
        created, skipped = notify.split_new(batch.drop("_bucket"), self.read(touched, run), created_at)
        created = stored(created.select(*NOTIFICATIONS.names))
        skipped = stored(skipped)
        out = created.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
        out.parquet(f"{self.root}/runs/run={run}")
        return created, skipped


class NameIndex:
    """Customers by the three-letter pieces of their names, for searches that need not read all names."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("piece"), F.lit(self.buckets)).cast("int")

    def build(self, customers: DataFrame) -> None:
        """Write the postings of ``user_id``, ``customer_id``, ``name``. Nulls and names of under three letters have none."""
        low = F.lower("name")
        pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(low, i, F.lit(3))))
        long = customers.select("user_id", "customer_id", "name").filter(F.length("name") >= 3)
        postings = long.withColumn("piece", F.explode(pieces)).withColumn("bucket", self._bucket())
        salt = F.pmod(F.xxhash64("user_id", "customer_id"), F.lit(8))  # a common piece spreads over some files
        postings.repartition("bucket", salt).sortWithinPartitions("bucket", "piece").write.mode("overwrite").partitionBy("bucket").parquet(self.root)

    def search(self, term: str) -> DataFrame:
        """``user_id``, ``customer_id``, ``name`` of customers whose name holds ``term`` (three letters or more) in any case."""
        term = term.strip().lower()
        if len(term) < 3:
            raise ValueError("an indexed search takes three letters or more; scan the names for shorter ones")
        pieces = sorted({term[i : i + 3] for i in range(len(term) - 2)})
        asked = self.spark.createDataFrame([(p,) for p in pieces], "piece string").select(self._bucket()).collect()
        found = self.spark.read.parquet(self.root).filter(F.col("bucket").isin(sorted({r[0] for r in asked})) & F.col("piece").isin(pieces))
        held = found.groupBy("user_id", "customer_id", "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= len(pieces))
        return held.filter(F.contains(F.lower("name"), F.lit(term))).select("user_id", "customer_id", "name")
