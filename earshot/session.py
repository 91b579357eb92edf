"""Session settings, lineage cuts and size-checked broadcasts shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row bound for which a broadcast hint is given. Above it the hint is left out and
# Catalyst chooses from its own size estimate (sort-merge with AQE skew splitting when large).
BROADCAST_ROW_LIMIT = 200_000


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster supplies its own master."""
    builder = (
        SparkSession.builder.appName("earshot")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that decide results, on whatever session the caller brings."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Call sites for error messages cost two more gateway calls per column expression.
    spark.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")
    # The JVM does not compile methods above this size; Spark then splits the code instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-earshot-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into reliable storage; the result survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, for derived tables and stream checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once as Parquet below the shared folder, for jobs that read them several times: columns are packed
    and a reader takes only those it needs, where a checkpoint keeps whole rows."""
    folder = workspace(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast when `rows`, a known upper bound on the row count, is within the limit."""
    return F.broadcast(df) if rows is not None and rows <= limit else df


def scalar_max(df: DataFrame, column: str):
    """The maximum of a column as a scalar subquery: no join, and usable in scan filters."""
    return df.agg(F.max(column).alias("top")).scalar()
