"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = {
    # Shuffled rows of a few columns take up to a hundred times their bytes in a task. Spark's own value is 64 MB.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
}


def session(app: str = "tillwater", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with adaptive execution and UTC day bucketing."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Every calendar day in this package is a UTC day."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def bound_tasks(spark: SparkSession) -> None:
    """Settings of adaptive execution (``ADAPTIVE``) that bound a task's memory. Values that the session was given stay."""
    for key, value in ADAPTIVE.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without the setting gets a temporary folder; a cluster without it is an
    error, since a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tillwater-ckpt-")
    sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table of the shared checkpoint folder and read it back.

    For costly intermediate results with several uses. Unlike a cached frame it
    survives lost executors without recomputing, and later reads prune columns
    and know its size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def known_empty(table: DataFrame) -> DataFrame:
    """A ``stored`` table; one without rows is known to be empty while queries are planned, so that joins with it go."""
    return table if table.limit(1).count() else table.limit(0)
