"""Staged tables partitioned by source and run date, and their replay as keyed records."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.events import iso_micros
from earshot.functions.text import clean_text_columns
from earshot.operators.ranking import ranked
from earshot.sources.sinks import hadoop_path

# Wanted records up to which the first ones are taken from each task, before they are numbered.
FEW_RECORDS = 100_000
STAGE_SCHEMA = ("user_id STRING, track_id STRING, artist_id STRING, event_ts TIMESTAMP, event_type STRING, "
                "track_name STRING, artist_name STRING, source STRING, run_date STRING")
TEXT_FIELDS = ("source", "user_id", "track_id", "artist_id", "track_name", "artist_name")


def write_stage(df: DataFrame, root: str, run_date: str, rows_per_file: int = 100_000, mode: str = "append") -> None:
    (df.withColumn("run_date", F.lit(run_date)).write.mode(mode).partitionBy("source", "run_date")
     .option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(root))


def read_stage(spark: SparkSession, root: str, source: str | None = None, run_date: str | None = None,
               columns: list[str] | None = None, schema: str = STAGE_SCHEMA) -> DataFrame:
    """Staged rows; source and run_date prune directories, `columns` prunes the scan."""
    df = spark.read.schema(schema).parquet(root)
    if source is not None:
        df = df.filter(F.col("source") == source)
    if run_date is not None:
        df = df.filter(F.col("run_date") == run_date)
    return df if columns is None else df.select(*columns)


def latest_run_date(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """Newest run_date per source, from the names of the folders alone: no file is opened."""
    def folders(path: str, key: str) -> list[tuple[str, str]]:
        found, fs = hadoop_path(spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(found)] if fs.exists(found) else []
        return [(unquote(n.removeprefix(f"{key}=")), f"{path}/{n}") for n in names if n.startswith(f"{key}=")]

    dates = [(s, date) for s, path in folders(root.rstrip("/"), "source") if source in (None, s)
             for date, _ in folders(path, "run_date")]
    return spark.createDataFrame(dates, "source string, run_date string").groupBy("source").agg(
        F.max("run_date").alias("run_date"))


def read_latest(spark: SparkSession, root: str, source: str) -> DataFrame:
    newest = latest_run_date(spark, root, source).collect()
    if not newest:
        raise FileNotFoundError(f"no staged run of {source} below {root}")
    return read_stage(spark, root, source, newest[0].run_date)


def replay_events(staged: DataFrame, max_records: int | None = None, max_per_user: int | None = None,
                  max_files: int | None = None, order: str = "sequential", seed: int = 42) -> DataFrame:
    """Keyed JSON records of staged events, ready for a topic.

    The per-user cap keeps each user's first records in time order, or in a seeded random order. `max_records` takes few
    records from the first ones of each task, and in time order cleans only events up to the time of the last one wanted;
    many are numbered over range-partitioned slices, so no task holds them all.
    """
    rows = staged
    if max_files is not None:
        from earshot.operators.quality import sample_files

        rows = sample_files(rows, max_files, order, seed)
    few = max_records is not None and max_records <= FEW_RECORDS
    if few and max_per_user is None and order != "random":
        usable = clean_text_columns(rows.select("user_id", "event_ts"), ["user_id"]).filter("user_id IS NOT NULL AND event_ts IS NOT NULL")
        last = usable.select("event_ts").orderBy("event_ts").limit(max_records).agg(F.max("event_ts").alias("last")).scalar()
        rows = rows.filter(F.col("event_ts") <= last)
    cleaned = clean_text_columns(rows, [*TEXT_FIELDS, "event_type"]).withColumn(
        "event_type", F.coalesce("event_type", F.lit("play")))
    valid = cleaned.filter("user_id IS NOT NULL AND event_ts IS NOT NULL")
    fields = ["source", "user_id", "track_id", "artist_id", "event_ts", "event_type", "track_name", "artist_name"]
    identity = F.xxhash64(*fields, F.lit(seed))
    sequence = ([identity.asc()] if order == "random" else []) + [F.col("event_ts").asc()] + [
        F.col(f).asc_nulls_first() for f in fields if f != "event_ts"]
    if max_per_user is not None:
        valid = ranked(valid, ["user_id"], sequence, "_n", max_per_user)
    if max_records is not None:
        valid = ranked(valid, [], sequence, "_nth", max_records if few else None).filter(F.col("_nth") <= max_records)
    value = F.to_json(F.struct(*[iso_micros(F.col(f)).alias(f) if f == "event_ts" else F.col(f) for f in fields]))
    return valid.select(F.col("user_id").alias("key"), value.alias("value"))


def send(records: DataFrame, fmt: str = "kafka", **options: str) -> None:
    """Write keyed records to a topic (format kafka) or to files of another format."""
    records.write.format(fmt).options(**options).mode("append").save()
