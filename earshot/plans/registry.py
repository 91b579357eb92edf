"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earshot.plans.fixtures import INPUTS, VIEWS, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Further views of the checking SQL; each names the views it reads.
DERIVED = {
    "ready": (("listen_events",), """
SELECT * FROM listen_events
WHERE event_type = 'play' AND coalesce(user_id,'') <> '' AND coalesce(track_id,'') <> ''
  AND coalesce(track_name,'') <> '' AND coalesce(artist_name,'') <> ''
  AND lower(artist_name) <> '__unknown_artist__' AND track_name <> track_id
  AND NOT regexp_full_match(track_name, '[0-9]+')"""),
    "model_users": (("ready",), """
SELECT user_id, count(*) AS plays FROM ready GROUP BY user_id ORDER BY plays DESC, user_id LIMIT 1000"""),
    "mf": (("stored_mf",), """
SELECT *, row_number() OVER (PARTITION BY model_version, user_id
                             ORDER BY recommendation_score DESC, track_id) AS recommendation_rank FROM stored_mf"""),
    "mf_latest": (("mf",), """
SELECT * FROM mf WHERE model_version = (SELECT model_version FROM mf
                                        ORDER BY generated_at DESC, model_version DESC LIMIT 1)"""),
}


def define(name: str, reads: tuple[str, ...], sql: str) -> None:
    """Add a view for the checking SQL."""
    DERIVED[name] = (reads, sql)


def _collect(names: tuple[str, ...], found: dict[str, str]) -> None:
    for name in names:
        if name in found:
            continue
        if name in DERIVED:
            reads, text = DERIVED[name]
            _collect(reads, found)
            found[name] = text
        else:
            text = VIEWS[name]
            for table in INPUTS:
                text = text.replace("{" + table + "}", table)
            found[name] = text.replace("TIMESTAMP_NTZ '", "TIMESTAMP '")


def check_sql(reads: tuple[str, ...], sql: str) -> str:
    """`sql` with the views it reads put in front; it may start with further `name AS (...),`."""
    found: dict[str, str] = {}
    _collect(reads, found)
    body = sql.strip()
    if not found:
        return body
    ctes = ",\n".join(f"{n} AS ({t.strip()})" for n, t in found.items())
    joiner = " " if body[:6].upper() == "SELECT" else ",\n"
    return f"WITH {ctes}{joiner}\n{body}"


def query(name: str, reads: tuple[str, ...] = (), sql: str | None = None):
    """Register a function of Inputs under `name`, with its checking SQL if there is one."""
    def add(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLES[name] = check_sql(reads, sql)
        return fn
    return add
