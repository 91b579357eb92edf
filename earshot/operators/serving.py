"""Serving tables: cascades over recommendation sources, search, and list restriction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import UNKNOWN, UNKNOWN_ARTIST, blank_to_null, readable, strip, track_key
from earshot.functions.vibe_rules import VIBES
from earshot.operators.popularity import best_name, count_rows
from earshot.operators.ranking import ranked
from earshot.session import materialize

ITEM = ("track_id", "track_name", "artist_name")


def latest_version(recs: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Rows of the newest model version; equal times go to the larger version name. `versions`, rows that have all
    versions there are (model_version, generated_at), saves a pass over `recs`."""
    newest = (recs if versions is None else versions).agg(F.max_by("model_version", F.struct("generated_at", "model_version")).alias("v")).scalar()
    return recs.filter(F.col("model_version") == newest)


def is_readable() -> Column:
    return readable(F.col("track_name"), F.col("artist_name"), F.col("track_id"))


def score_bounds(recs: DataFrame, limit: int, near: Sequence[str] = ()) -> DataFrame:
    """Per user a score (`bound`) that the first `limit` readable rows by score all reach; null where there may be fewer.

    Tracks are dealt into 2 * limit classes by their hash, and the best score of each class is kept, an aggregate that sorts
    nothing. The `limit` best of these belong to as many rows, so the limit-th is a bound; some 1.4 * limit rows reach it.
    `near` are columns that follow from the user; where rows are gathered by them, no class is shuffled.
    """
    best = (recs.filter(is_readable())
            .groupBy(*near, "user_id", F.pmod(F.xxhash64("track_id"), F.lit(2 * limit)).alias("_class"))
            .agg(F.max("recommendation_score").alias("_best")))
    return best.groupBy(*near, "user_id").agg(
        F.get(F.sort_array(F.collect_list("_best"), asc=False), F.lit(limit - 1)).alias("bound")).drop(*near)


def recsource_counts(hybrid: DataFrame, mf: DataFrame, dense: DataFrame, trending: DataFrame) -> DataFrame:
    """Rows, users and version of every source. The first two carry model_version, generated_at."""
    def one(name: str, df: DataFrame, versioned: bool) -> DataFrame:
        users = F.countDistinct("user_id") if "user_id" in df.columns else F.lit(None).cast("long")
        if versioned:  # every version is counted in one pass, then the newest is taken
            each = df.groupBy("model_version").agg(count_rows().alias("rows"), users.alias("users"),
                                                   F.max("generated_at").alias("generated_at"))
            newest = F.max_by(F.struct("rows", "users", "model_version", "generated_at"),
                              F.struct("generated_at", "model_version"))
            rows = each.agg(newest.alias("v")).select(
                F.coalesce("v.rows", F.lit(0).cast("long")).alias("rows"),
                F.coalesce("v.users", F.lit(0).cast("long")).alias("users"), "v.model_version", "v.generated_at")
        else:
            rows = df.agg(count_rows().alias("rows"), users.alias("users")).select(
                "*", F.lit(None).cast("string").alias("model_version"), F.lit(None).cast("timestamp_ntz").alias("generated_at"))
        return rows.select(F.lit(name).alias("source"), (F.col("rows") > 0).alias("available"), "rows", "users",
                           "model_version", "generated_at")
    return (one("hybrid", hybrid, True).unionByName(one("mf", mf, True))
            .unionByName(one("dense", dense, False)).unionByName(one("trending", trending, False)))


def trending_items(trending: DataFrame, named: DataFrame, limit: int = 20,
                   modes: tuple[str, str] = ("trending_7d", "trending_7d_named_fallback")) -> DataFrame:
    """The first readable trending rows, or the all-time named ones when there are none.

    At most `limit` rows: the list every user without own items receives.
    """
    order = [F.col("global_rank_7d").asc()]
    columns = ["global_rank_7d", "track_id", "track_name", "artist_id", "artist_name", "plays_7d", "unique_listeners_7d"]
    recent = ranked(trending.filter(is_readable()), [], order, "position", limit)
    all_time = ranked(named, [], order, "position", limit)
    any_recent = recent.agg(count_rows().alias("n")).scalar()
    return (recent.select(*columns, "position").withColumn("mode", F.lit(modes[0]))
            .unionByName(all_time.select(*columns, "position").withColumn("mode", F.lit(modes[1]))
                         .filter(any_recent == 0)))


def recs_cascade(users: DataFrame, hybrid: DataFrame | None, mf: DataFrame | None, dense: DataFrame | None,
                 trending: DataFrame | None, named: DataFrame | None, limit: int = 20, fallback: bool = True, use_hybrid: bool = True,
                 use_mf: bool = True, use_dense: bool = False) -> DataFrame:
    """Items per user from the first source with any row for the user, then readable rows only.

    A source is chosen before rows are tested, so a user whose chosen rows are all unreadable
    gets the trending list, not the next source. Sources that aren't used, and the lists without `fallback`, may be None.
    """
    sources = [(flag, df, mode) for flag, df, mode in (
        (use_hybrid, hybrid, "personalized_hybrid_ready"), (use_mf, mf, "personalized_mf_ready"),
        (use_dense, dense, "personalized_dense_1000")) if flag]
    wanted = users.select("user_id").distinct()
    rows = None
    for priority, (_, df, mode) in enumerate(sources):
        part = (df.join(wanted, "user_id", "left_semi")
                .select("user_id", F.lit(priority).alias("_priority"), F.lit(mode).alias("mode"),
                        "recommendation_rank", *ITEM, "recommendation_score"))
        rows = part if rows is None else rows.unionByName(part)
    chosen = rows.groupBy("user_id").agg(F.min("_priority").alias("_priority"))
    served = (ranked(rows.join(chosen, ["user_id", "_priority"]).filter(is_readable()), ["user_id"],
                     [F.col("recommendation_rank").asc()], "position", limit)
              .select("user_id", "mode", "position", "recommendation_rank", *ITEM, "recommendation_score"))
    if not fallback:
        return served
    items = trending_items(trending, named, limit, ("fallback_trending", "fallback_named_trending"))
    shared = items.agg(F.collect_list(F.struct("mode", "position", *ITEM)).alias("items")).scalar()
    others = (wanted.join(served.select("user_id").distinct(), "user_id", "left_anti")
              .withColumn("i", F.explode(shared))
              .select("user_id", "i.mode", F.col("i.position").alias("position"),
                      F.lit(None).cast("long").alias("recommendation_rank"),
                      *[F.col(f"i.{c}").alias(c) for c in ITEM],
                      F.lit(None).cast("double").alias("recommendation_score")))
    return served.unionByName(others)


def favorites_cascade(users: DataFrame, favorites: DataFrame, recs: DataFrame, limit: int = 20,
                      fallback_to_recs: bool = True) -> DataFrame:
    """Readable favourites of each user, else the user's recs_cascade rows under another mode."""
    wanted = users.select("user_id").distinct()
    own = favorites.join(wanted, "user_id", "left_semi").filter(is_readable())
    served = (ranked(own, ["user_id"], [F.col("favorite_rank").asc()], "position", limit)
              .select("user_id", F.lit("user_favorites").alias("mode"), "position", *ITEM))
    if not fallback_to_recs:
        return served
    mode = (F.when(F.col("mode").startswith("personalized"), "favorites_fallback_personalized")
            .when(F.col("mode").startswith("fallback"), "favorites_fallback_trending").otherwise(F.col("mode")))
    rest = (recs.join(wanted, "user_id", "left_semi")
            .join(served.select("user_id").distinct(), "user_id", "left_anti")
            .select("user_id", mode.alias("mode"), "position", *ITEM))
    return served.unionByName(rest)


def _like(text: Column, before: str, word: Column, after: str) -> Column:
    return F.like(text, F.concat(F.lit(before), word, F.lit(after)))


# A backslash that escapes nothing is left out, as LIKE refuses it.
def _pattern(query: str) -> Column:
    return F.regexp_replace(query, r"(\\[\\%_])|\\(.?)", "$1$2")


def _grams(text: Column, size: Column | int) -> Column:
    """All substrings of `size` characters; size 0 gives one empty text."""
    wide = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - wide + 1)
    return (F.when(wide == 0, F.array(F.lit("")))
            .when(F.length(text) >= wide, F.transform(starts, lambda i: F.substring(text, i, wide)))
            .otherwise(F.array().cast("array<string>")))


def search_requests(requests: DataFrame, gram: int = 3) -> DataFrame:
    """Requests (column `query`) as distinct (query, pattern, grams): in lower case, trimmed, null ones left out.

    `pattern` is the query with backslashes that escape nothing taken away. `grams` are the substrings of `gram` characters
    of its literal parts; of a query without so long a part those of its longest part, and one empty text if it is all wildcards.
    """
    text = F.lower(strip(F.col("query")))
    parts = F.transform(F.regexp_extract_all("pattern", F.lit(r"((?:\\.|[^\\%_])+)"), F.lit(1)),
                        lambda part: F.regexp_replace(part, r"\\(.)", "$1"))
    longest = F.array_max(F.transform("parts", lambda part: F.length(part)))
    size = F.least(F.lit(gram), F.coalesce(longest, F.lit(0)))
    grams = F.flatten(F.transform("parts", lambda part: _grams(part, F.col("size"))))
    return (requests.filter("query IS NOT NULL").select(text.alias("query")).distinct()
            .withColumn("pattern", _pattern("query")).withColumn("parts", parts).withColumn("size", size)
            .select("query", "pattern", F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(
                F.array_distinct(grams)).alias("grams")))


def matching_names(requests: DataFrame, names: DataFrame, gram: int = 3) -> DataFrame:
    """Pairs (query, name) of requests and distinct lower-case names that contain them; `%` and `_` are wildcards.

    The names' grams are posting lists, kept only for grams that some request has. A request is looked up under its rarest
    gram alone, and what that list holds is compared with the whole pattern. A gram in no name ends the request.
    """
    wanted = materialize(search_requests(requests, gram).select("query", "pattern", F.explode("grams").alias("gram")))
    sizes = wanted.agg(F.collect_set(F.length("gram"))).scalar()
    found = F.array_distinct(F.flatten(F.transform("_sizes", lambda size: _grams(F.col("name"), size))))
    postings = (names.select("name", sizes.alias("_sizes")).select("name", F.explode(found).alias("gram"))
                .join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counts = postings.groupBy("gram").agg(count_rows().alias("n"))
    rarest = (wanted.join(counts, "gram", "left").groupBy("query", "pattern")
              .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    return postings.join(rarest, "gram").filter(_like(F.col("name"), "%", F.col("pattern"), "%")).select("query", "name")


def search_sources(requests: DataFrame, ready: DataFrame, cat: DataFrame) -> DataFrame:
    """Tracks of events (with play counts) and of the catalog that contain a request's text (column `query`).

    Events are folded to tracks first. Requests meet distinct names by equi-joins on grams, and the matched names meet their
    tracks by name, so the work follows the tracks and the matches, not requests times tracks.
    """
    played = (ready.filter("track_name IS NOT NULL").groupBy("track_id", "track_name")
              .agg(F.coalesce(best_name("artist_name"), F.lit(UNKNOWN_ARTIST)).alias("artist_name"),
                   F.lit(None).cast("string").alias("genre"), count_rows().alias("popularity_30d")))
    listed = cat.filter("track_name IS NOT NULL").select(
        F.coalesce("track_id", F.lit(UNKNOWN)).alias("track_id"),
        F.coalesce(blank_to_null(F.col("track_name")), "track_id", F.lit(UNKNOWN)).alias("track_name"),
        F.coalesce(blank_to_null(F.col("artist_name")), F.lit(UNKNOWN_ARTIST)).alias("artist_name"),
        "genre", F.lit(0).cast("long").alias("popularity_30d"), F.lower("track_name").alias("name"))
    rows = played.withColumn("name", F.lower("track_name")).unionByName(listed)
    names = (ready.select(F.lower("track_name").alias("name")).union(cat.select(F.lower("track_name")))
             .filter("name IS NOT NULL").distinct())
    return rows.join(matching_names(requests, names), "name").drop("name").select("query", *[c for c in rows.columns if c != "name"])


def search_dedup(matches: DataFrame) -> DataFrame:
    """One row per query, lower-case track and artist name: the most popular, then smallest id.

    An aggregate, so copies of a hot name are dropped before the shuffle.
    """
    fields = [c for c in matches.columns if c != "query"]
    order = F.struct(-F.col("popularity_30d"), F.col("track_id"), F.coalesce("genre", F.lit("")), F.col("track_name"))
    return (matches.groupBy("query", F.lower("track_name").alias("_t"), F.lower("artist_name").alias("_a"))
            .agg(F.min_by(F.struct(*fields), order).alias("kept")).select("query", "kept.*"))


def search_tracks(requests: DataFrame, ready: DataFrame, cat: DataFrame, limit: int = 10) -> DataFrame:
    """Readable matches per request: exact names, then prefixes, then the rest; popular ones first."""
    name, word = F.lower("track_name"), _pattern("query")
    score = (F.when(name == F.col("query"), 300).when(_like(name, "", word, "%"), 200)
             .when(_like(name, "%", word, "%"), 100).otherwise(0))
    found = search_dedup(search_sources(requests, ready, cat)).withColumn("match_score", score)
    order = [F.col("match_score").desc(), F.col("popularity_30d").desc(), F.col("track_name").asc(),
             F.col("artist_name").asc(), F.col("track_id").asc()]
    return ranked(found.filter(is_readable()), ["query"], order, "position", limit).select(
        "query", "position", "track_id", "track_name", "artist_name", "genre", "popularity_30d", "match_score")


def item_key() -> Column:
    return track_key(F.col("track_id"), F.col("track_name"), F.col("artist_name"))


def restrict_to(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items whose track key is among those of `keys`."""
    return (items.withColumn("_key", item_key())
            .join(keys.select(item_key().alias("_key")).distinct(), "_key", "left_semi").drop("_key"))


def personalised_vibe(recs: DataFrame, vibe_items: DataFrame) -> DataFrame:
    """Personalised rows of each user that are also items of a mood; one row per mood."""
    keys = vibe_items.select("vibe", item_key().alias("_key")).distinct()
    own = recs.filter(F.col("mode").startswith("personalized")).withColumn("_key", item_key())
    return own.join(keys, "_key").drop("_key")


def vibe_coverage(recs: DataFrame, vibe_items: DataFrame) -> DataFrame:
    """Per personalised user, how many recommended tracks are items of each mood."""
    users = recs.filter(F.col("mode").startswith("personalized")).select("user_id").distinct()
    counts = (personalised_vibe(recs, vibe_items).groupBy("user_id").pivot("vibe", list(VIBES))
              .agg(F.countDistinct("track_id")))
    return users.join(counts, "user_id", "left").select(
        "user_id", *[F.coalesce(v, F.lit(0)).alias(v) for v in VIBES])


def next_page(items: DataFrame, shown: DataFrame, size: int, group: list[str], order: list[Column]) -> DataFrame:
    """The next `size` items of each list whose keys have not been shown in it."""
    keyed = items.withColumn("_key", item_key())
    seen = shown.select(*group, item_key().alias("_key")).distinct()
    return ranked(keyed.join(seen, [*group, "_key"], "left_anti").drop("_key"), group, order, "page_position", size)
