"""Counts, profiles, target checks and metadata repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import UNKNOWN, blank_to_null, clean_text, strip
from earshot.operators.popularity import count_rows
from earshot.session import materialize, small, stored


def _distinct(df: DataFrame, keys: list[str], columns: dict[str, str], partial: list | None = None,
              final: list | None = None) -> DataFrame:
    """Row count and several exact distinct counts per group, in one scan.

    Rows are first folded to one per value combination, so the copy that Spark makes per
    counted column is of the folded table and a hot group is spread over its values.
    """
    folded = df.groupBy(*keys, *columns).agg(count_rows().alias("_n"), *(partial or []))
    return folded.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("events"),
        *[F.countDistinct(c).alias(name) for c, name in columns.items()], *(final or []))


def model_metrics(ev: DataFrame) -> DataFrame:
    counted = _distinct(ev, [], {"user_id": "users", "track_id": "tracks"})
    return counted.withColumn("events_per_user", F.round(F.try_divide("events", "users"), 2))


def summary(ev: DataFrame) -> DataFrame:
    return _distinct(ev, [], {"user_id": "distinct_users", "track_id": "distinct_tracks"},
                     [F.min("event_ts").alias("_lo"), F.max("event_ts").alias("_hi")],
                     [F.min("_lo").alias("min_event_ts"), F.max("_hi").alias("max_event_ts")]
                     ).withColumnRenamed("events", "total_events")


def source_breakdown(ev: DataFrame) -> DataFrame:
    return _distinct(ev, ["source"], {"user_id": "users", "track_id": "tracks"},
                     [F.min("event_ts").alias("_lo"), F.max("event_ts").alias("_hi")],
                     [F.min("_lo").alias("min_event_ts"), F.max("_hi").alias("max_event_ts")])


def top_users_profile(ev: DataFrame, n: int = 100) -> DataFrame:
    return (ev.groupBy("user_id").agg(
        count_rows().alias("plays"), F.countDistinct("track_id").alias("distinct_tracks"),
        F.min("event_ts").alias("first_seen_ts"), F.max("event_ts").alias("last_seen_ts"))
        .orderBy(F.col("plays").desc(), F.col("user_id").asc()).limit(n))


def genre_counts(cat: DataFrame, n: int = 100) -> DataFrame:
    genre = F.coalesce(blank_to_null(F.col("genre")), F.lit(UNKNOWN)).alias("genre")
    return (cat.groupBy(genre).agg(count_rows().alias("tracks"))
            .orderBy(F.col("tracks").desc(), F.col("genre").asc()).limit(n))


def sample_files(df: DataFrame, files: int, strategy: str = "random", seed: int = 42) -> DataFrame:
    """Rows of `files` input files: the first by name, or those with the smallest seeded hash.

    The choice is made from file names, of which there are few; it is not a row sample.
    """
    path = F.col("_metadata.file_path")
    order = F.xxhash64(path, F.lit(seed)) if strategy == "random" else path
    chosen = df.select(path.alias("p"), order.alias("o")).distinct().orderBy("o", "p").limit(files).select("p")
    return df.withColumn("_path", path).join(small(chosen, files), F.col("_path") == F.col("p"), "left_semi").drop("_path")


def user_diversity(ev: DataFrame, top: int = 10, files: int | None = None, strategy: str = "random",
                   seed: int = 42) -> DataFrame:
    """The most frequent users with the totals of the scanned rows."""
    scanned = ev if files is None else sample_files(ev, files, strategy, seed)
    users = scanned.groupBy(strip(F.col("user_id")).alias("user_id")).agg(count_rows().alias("rows"))
    known = users.filter("user_id <> ''")
    totals = users.agg(F.sum("rows").alias("total_rows"), F.count_if(F.col("user_id") != "").alias("unique_users"))
    return (known.orderBy(F.col("rows").desc(), F.col("user_id").asc()).limit(top)
            .withColumn("total_rows", totals.select("total_rows").scalar())
            .withColumn("unique_users", totals.select("unique_users").scalar()))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (df.filter(F.coalesce(F.col(column), F.lit("")) != "")
            .groupBy(F.col(column).alias("value")).agg(count_rows().alias("n")))


def target_checks(ev: DataFrame, ready: DataFrame, events: int = 500_000, users: int = 1000, tracks: int = 50_000,
                  scope: str = "ready") -> DataFrame:
    """Actual against target per metric, and an overall row per scope ('raw', 'ready' or 'both')."""
    targets = {"total_events": events, "distinct_users": users, "distinct_tracks": tracks}
    out = None
    for name, df in (("raw", ev), ("ready", ready)):
        if scope not in (name, "both"):
            continue
        counted = _distinct(df, [], {"user_id": "distinct_users", "track_id": "distinct_tracks"})
        counted = counted.withColumnRenamed("events", "total_events")

        def status(ok):
            return F.when(ok, "PASS").otherwise("FAIL").alias("status")

        rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("actual"),
                         F.lit(t).cast("long").alias("target"), status(F.col(m) >= t)) for m, t in targets.items()]
        all_ok = F.lit(True)
        for m, t in targets.items():
            all_ok = all_ok & (F.col(m) >= t)
        rows.append(F.struct(F.lit("overall").alias("metric"), F.lit(None).cast("long").alias("actual"),
                             F.lit(None).cast("long").alias("target"), status(all_ok)))
        part = counted.select(F.explode(F.array(*rows)).alias("r")).select(F.lit(name).alias("scope"), "r.*")
        out = part if out is None else out.unionByName(part)
    return out


def _folded_counts(names: DataFrame, column: str) -> DataFrame:
    """value_counts of a column from rows with their number, `n`."""
    return (names.filter(F.coalesce(F.col(column), F.lit("")) != "")
            .groupBy(F.col(column).alias("value")).agg(F.sum("n").alias("n")))


def text_mapping(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that cleaning changes, with their new text and row count."""
    return (value_counts(df, column).withColumn("new", clean_text("value"))
            .filter(F.col("new").isNotNull() & (F.col("new") != F.col("value"))))


def folded_names(df: DataFrame, columns: Sequence[str], rows: str | None = None) -> DataFrame:
    """The distinct combinations of the columns with the number of rows that have them, stored; `rows` names a column of `df`
    with the number of rows that a row of it stands for."""
    return materialize(df.groupBy(*columns).agg((count_rows() if rows is None else F.sum(rows)).alias("n")))


def repair_metadata(df: DataFrame, columns: list[str], dry_run: bool = False, rows: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with repaired columns, and a report row per column. Repair goes by value, so a table may be given folded:
    `rows` then names the column with the number of rows that a row stands for.

    One pass folds the table to its distinct combinations of the columns, which all columns are counted from.
    Cleaning runs once per distinct value; the few changed values are joined back. Catalyst
    broadcasts the mapping when it is small and otherwise joins by value with skew splitting.
    """
    out, report = df, None
    names = folded_names(df, columns, rows) if len(columns) > 1 or rows is not None else None
    for column in columns:
        found = value_counts(df, column) if names is None else _folded_counts(names, column)
        counts = materialize(found.withColumn("new", clean_text("value")))
        changed = counts.filter(F.col("new").isNotNull() & (F.col("new") != F.col("value")))
        scanned = counts.agg(count_rows().alias("n")).scalar()
        top = changed.orderBy(F.col("n").desc(), F.col("value").asc()).limit(10).agg(
            F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value", "new"))),
                        lambda e: F.concat_ws(" -> ", e.value, e.new)).alias("e")).scalar()
        row = changed.agg(count_rows().alias("distinct_values_changed"),
                          F.coalesce(F.sum("n"), F.lit(0)).alias("rows_changed")).select(
            F.lit(column).alias("target"), scanned.alias("distinct_values_scanned"), "distinct_values_changed",
            "rows_changed", top.alias("examples"))
        report = row if report is None else report.unionByName(row)
        if not dry_run:
            mapping = changed.select(F.col("value").alias("_old"), F.col("new").alias("_new"))
            out = (out.join(mapping, F.col(column) == F.col("_old"), "left")
                   .withColumn(column, F.coalesce("_new", column)).drop("_old", "_new"))
    return out, report


# The stored tables whose names are repaired.
REPAIR_TABLES = ("listen_events", "track_catalog", "recommendations_mf", "recommendations_hybrid")
REPAIR_COLUMNS = ("track_name", "artist_name")


def repair_tables(tables: dict[str, DataFrame], dry_run: bool = False, rows: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table with its names repaired, and one report: a row per table and column that it has. With `rows` the tables
    are given folded, see repair_metadata."""
    repaired, report = {}, None
    for name, df in tables.items():
        repaired[name], part = repair_metadata(df, [c for c in REPAIR_COLUMNS if c in df.columns], dry_run, rows)
        part = part.withColumn("target", F.concat(F.lit(f"{name}."), "target"))
        report = part if report is None else report.unionByName(part)
    return repaired, report


def snapshot_summary(ev: DataFrame, targets: dict[str, int], files: dict[str, str], notes: list[str] = ()) -> DataFrame:
    """One row with a JSON object: metrics of all events, targets and whether each is met, notes, and report files."""
    metrics = {"events": "total_events", "users": "distinct_users", "tracks": "distinct_tracks"}

    def named(values: dict) -> Column:
        return F.struct(*[v.alias(k) for k, v in values.items()])
    body = named({
        "generated_at_utc": F.current_timestamp(),
        "metrics": F.struct("total_events", "distinct_users", "distinct_tracks", "min_event_ts", "max_event_ts"),
        "targets": named({k: F.lit(v) for k, v in targets.items()}),
        "target_status": named({k: F.when(F.col(metrics[k]) >= v, "PASS").otherwise("FAIL") for k, v in targets.items()}),
        "notes": F.array(*[F.lit(n) for n in notes]).cast("array<string>"),
        "files": named({k: F.lit(v) for k, v in files.items()})})
    return summary(ev).select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def snapshots(ev: DataFrame, cat: DataFrame, users: int = 100, genres: int = 100, sample: int = 1000,
              targets: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The tables of an inspection: summary, sources, most active users, catalog genres and the newest events.

    The columns that are counted are stored once. The newest events are sought among those not before the time of the
    last one wanted, which is read from what is stored; with fewer times than that, among all.
    """
    from earshot.operators.slices import latest_events

    seen = stored(ev.select("source", "user_id", "track_id", "event_ts"), "snapshot")
    last = seen.select("event_ts").orderBy(F.col("event_ts").desc()).limit(sample).agg(
        F.when(F.count("event_ts") == sample, F.min("event_ts")).alias("last")).scalar()
    newest = ev.filter((F.col("event_ts") >= last) | last.isNull())
    tables = {"source_breakdown": source_breakdown(seen), "top_users": top_users_profile(seen, users),
              "catalog_genres": genre_counts(cat, genres), "event_sample": latest_events(newest, sample)}
    goals = targets or {"events": 500_000, "users": 1000, "tracks": 50_000}
    return {"summary": snapshot_summary(seen, goals, {k: k for k in tables})} | tables
