"""Readers for the two raw layouts with fixed columns: the play log and the catalog."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from earshot.functions.text import with_clean_text

# The play log's field order and the accepted catalog column names.
PLAY_LOG_FIELDS = ("user_id", "event_ts", "artist_id", "artist_name", "track_id", "track_name")
CATALOG_NAMES = {
    "track_id": ("track_id",),
    "artist_id": ("artist_id",),
    "track_name": ("track_title", "track_name", "title"),
    "artist_name": ("artist_name", "artist"),
    "genre": ("track_genre_top", "genre_top", "genre"),
    "duration_sec": ("track_duration", "duration", "duration_sec"),
}


def parse_play_log(lines: DataFrame, source: str, observation: Observation | None = None) -> DataFrame:
    """Events of six-field lines in column `value`; other lines and bad times are counted, not kept."""
    parts = lines.filter(F.col("value") != "").select(F.split("value", "\t", -1).alias("p"))
    ts_text = F.when(F.size("p") == 6, F.get("p", F.lit(1)))
    shape = ts_text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$")
    parsed = parts.withColumn("event_ts", F.try_to_timestamp(F.when(shape, ts_text), F.lit("yyyy-M-d'T'H:m:s'Z'")))
    if observation is not None:
        parsed = parsed.observe(observation, F.count("event_ts").alias("rows"),
                                F.count_if(F.col("event_ts").isNull()).alias("bad_rows"))
    texts = {f: F.get("p", F.lit(i)) for i, f in enumerate(PLAY_LOG_FIELDS) if f != "event_ts"}
    return with_clean_text(parsed.filter("event_ts IS NOT NULL"), texts).select(
        F.lit(source).alias("source"), "user_id", "track_id", "artist_id", "event_ts",
        F.lit("play").alias("event_type"), "track_name", "artist_name")


def load_play_log_tsv(spark: SparkSession, path: str, source: str, observation: Observation | None = None) -> DataFrame:
    return parse_play_log(spark.read.text(path), source, observation)


def flatten_header(rows: list[list[str]]) -> list[str]:
    """One name per column from its header cells, without blank and 'Unnamed' ones."""
    names = []
    for cells in zip(*rows):
        kept = [c.strip() for c in cells if c.strip() and not c.strip().startswith("Unnamed")]
        names.append("_".join(kept).lower().replace(" ", "_"))
    if "track_id" not in names and names:
        names[0] = "track_id"
    return names


def catalog_float(col: Column) -> Column:
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number).cast("float")


def parse_catalog(rows: DataFrame, source: str) -> DataFrame:
    """Catalog rows from columns under any of the accepted names."""
    def first(field: str) -> Column | None:
        return next((F.col(f"`{n}`") for n in CATALOG_NAMES[field] if n in rows.columns), None)

    texts = {f: first(f) if first(f) is not None else F.lit(None) for f in CATALOG_NAMES if f != "duration_sec"}
    duration = first("duration_sec")
    seconds = catalog_float(duration) if duration is not None else F.lit(None).cast("float")
    return with_clean_text(rows.select(seconds.alias("duration_sec"), *[c.alias(f) for f, c in texts.items()]),
                           {f: F.col(f) for f in texts}).select(F.lit(source).alias("source"), *texts, "duration_sec")


def header_lines(lines: list[str]) -> int:
    """How many of the first lines (one or two) are header: two, unless the first alone names the track and its title,
    artist or genre, or the second is a data line (its first cell is a number)."""
    cells = [next(csv.reader(io.StringIO(x)), []) for x in lines[:2]]
    if len(cells) < 2:
        return len(cells)
    first = {c.strip().lower().replace(" ", "_") for c in cells[0]}
    others = {n for f in ("track_name", "artist_name", "genre") for n in CATALOG_NAMES[f]}
    lead = cells[1][0].strip() if cells[1] else ""
    return 1 if (first & set(CATALOG_NAMES["track_id"]) and first & others) or lead.isdigit() else 2


def has_long_records(lines: DataFrame) -> bool:
    """Whether a record may go over a line end: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def load_catalog_csv(spark: SparkSession, path: str, source: str, header_rows: int | None = None) -> DataFrame:
    """Catalog files with one or two header lines each; how many is detected unless given.

    Header lines are recognised by their content. Files are split over tasks unless a quoted field holds a line end.
    """
    lines = spark.read.text(path)
    heads = [r.value for r in lines.limit(2 if header_rows is None else header_rows).collect()]
    heads = heads[:header_lines(heads)] if header_rows is None else heads
    cells = [next(csv.reader(io.StringIO(h)), []) for h in heads]
    width = max((len(c) for c in cells), default=0)
    if not width:
        raise ValueError(f"no header in {path}")
    names = flatten_header([c + [""] * (width - len(c)) for c in cells])
    unique = [n if n and names.index(n) == i else f"_column_{i}" for i, n in enumerate(names)]
    schema = ", ".join(f"`{n}` STRING" for n in unique)
    rows = spark.read.schema(schema).option("multiLine", has_long_records(lines)).option("escape", '"').csv(path)
    header = F.lit(False)
    for c in cells:
        same = F.lit(True)
        for n, value in zip(unique, c):
            same = same & F.col(f"`{n}`").eqNullSafe(F.lit(value if value else None))
        header = header | same
    return parse_catalog(rows.filter(~header), source)
