"""User names and references to users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import name_key, strip
from earshot.operators.ranking import ranked
from earshot.session import materialize

def display_names(users: DataFrame, first_names: Sequence[str], last_names: Sequence[str]) -> DataFrame:
    """A unique name per user: a hashed pair of names, numbered from 2 where more active users have it already."""
    def pick(names: Sequence[str], i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))

    seed = F.conv(F.substring(F.sha2("user_id", 256), 1, 12), 16, 10).cast("long")
    slot = F.pmod(seed, F.lit(len(first_names) * len(last_names)))
    placed = ranked(users.select("user_id", "plays", slot.alias("_slot")), ["_slot"],
                    [F.col("plays").desc(), F.col("user_id").asc()], "_turn")
    name = F.concat(pick(first_names, F.col("_slot") % len(first_names)), F.lit(" "),
                    pick(last_names, F.floor(F.col("_slot") / len(first_names))))
    return placed.select("user_id", F.when(F.col("_turn") == 1, name)
                         .otherwise(F.concat(name, F.lit(" "), F.col("_turn"))).alias("display_name"))


def named_users(users: DataFrame, profiles: DataFrame) -> DataFrame:
    names = profiles.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "display_name")
    return users.join(names, "user_id", "left").select(
        "user_id", "plays", F.coalesce("display_name", "user_id").alias("display_name"))


def list_profiles(profiles: DataFrame, n: int = 100) -> DataFrame:
    return profiles.select("display_name", "user_id").orderBy("display_name", "user_id").limit(n)


def _grams(text: Column) -> Column:
    """The distinct letter pairs of a text, or the text itself if it is one letter."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(F.when(F.length(text) >= 2, pairs).otherwise(F.array(text)))


def _rare_grams(texts: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """The letter pairs of each `text` that a text of similarity `least` or more must share one of.

    Such a text is at most length / least long and (1 - least) of that many edits away, and an edit changes two pairs
    at most; so of any 2 * edits + 1 pairs one is left. The rarest pairs in `counts` are taken.
    """
    edits = F.floor(F.round(F.length("text") * F.lit((1 - least) / least), 6))
    listed = (texts.select("text", (2 * edits + 1).alias("_need"), F.explode(_grams(F.col("text"))).alias("gram"))
              .join(counts, "gram", "left")
              .groupBy("text", "_need").agg(F.sort_array(F.collect_list(
                  F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("grams")))
    return listed.select("text", F.explode(F.slice("grams", F.lit(1), F.col("_need").cast("int"))).alias("g")) \
        .select("text", "g.gram")


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _fuzzy(refs: DataFrame, named: DataFrame) -> DataFrame:
    """The clear best match per reference among the names of the model users, by edit similarity.

    Only pairs that can reach 0.76 are compared (found by their rarest letter pairs); a runner-up
    below 0.79 cannot come within 0.05 of a best score that counts, so it need not be seen.
    """
    targets = materialize(
        named.withColumn("name_norm", name_key(F.col("display_name"))).filter("name_norm <> ''")
        .withColumn("target", F.explode(F.array_distinct(F.concat(F.array("name_norm"), F.split("name_norm", " ")))))
        .select("user_id", "display_name", "name_norm", "target"))
    asked = materialize(refs.withColumn("query", name_key(F.col("key"))).filter("query <> ''").select("key", "query").distinct())
    names = targets.select(F.col("target").alias("text")).distinct()
    counts = names.select(F.explode(_grams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    by_gram = _rare_grams(names, counts, 0.76).withColumnRenamed("text", "target")
    wanted = _rare_grams(asked.select(F.col("query").alias("text")).distinct(), counts, 0.76)
    shorter, longer = F.least(F.length("query"), F.length("target")), F.greatest(F.length("query"), F.length("target"))
    pairs = (wanted.withColumnRenamed("text", "query").join(by_gram, "gram").filter(shorter / longer >= 0.76)
             .select("query", "target").distinct()
             .withColumn("sim", edit_similarity(F.col("query"), F.col("target")))
             .filter(F.col("sim") >= 0.76))
    bonus = F.when(F.arrays_overlap(F.split("query", " "), F.split("name_norm", " ")), 0.03).otherwise(0.0)
    scored = (pairs.join(targets, "target").groupBy("query", "user_id", "display_name", "name_norm")
              .agg(F.max("sim").alias("sim")).withColumn("score", F.col("sim") + bonus))
    order = [F.col("score").desc(), F.col("display_name").asc(), F.col("user_id").asc()]
    best = (ranked(scored, ["query"], order, "rn", 2).groupBy("query")
            .agg(F.max(F.when(F.col("rn") == 1, F.struct("user_id", "display_name", "score"))).alias("top"),
                 F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(0.0)).alias("second")))
    clear = (F.col("top.score") >= 0.84) & ((F.col("top.score") - F.col("second") >= 0.05) | (F.col("top.score") >= 0.92))
    return asked.join(best.filter(clear), "query").select(
        "key", F.col("top.user_id").alias("user_id"), F.col("top.display_name").alias("display_name"),
        F.col("top.score").alias("score"))


def resolve_users(refs: DataFrame, profiles: DataFrame, users: DataFrame) -> DataFrame:
    """User of each reference text: by id, name, unique part of a name, or close spelling.

    `refs` has a `ref` column. A step sees only references the earlier steps left open; a
    reference nothing matches keeps its own text as user_id with method 'unresolved'.
    """
    asked = materialize(refs.select("ref").distinct().withColumn("key", strip(F.col("ref"))))
    names = materialize(profiles.filter("coalesce(display_name, '') <> ''").select("user_id", "display_name"))
    by_id = (asked.join(users.select(F.col("user_id").alias("key")), "key", "left_semi")
             .join(names.withColumnRenamed("user_id", "key"), "key", "left")
             .select("ref", F.col("key").alias("user_id"), "display_name", F.lit("user_id").alias("method"),
                     F.lit(None).cast("double").alias("score")))
    open1 = asked.join(by_id.select("ref"), "ref", "left_anti")
    same = (open1.withColumn("_l", F.lower("key"))
            .join(names.withColumn("_l", F.lower("display_name")), "_l")
            .groupBy("ref").agg(F.min(F.struct("display_name", "user_id")).alias("m")))
    by_name = same.select("ref", "m.user_id", "m.display_name", F.lit("display_name").alias("method"),
                          F.lit(None).cast("double").alias("score"))
    open2 = materialize(open1.join(by_name.select("ref"), "ref", "left_anti")
                        .filter((F.length("key") >= 3) & F.col("key").rlike(r"\p{L}")))
    by_part = _unique_part(open2, names)
    open3 = open2.join(by_part.select("ref"), "ref", "left_anti").filter(F.length("key") >= 4)
    candidates = names.join(users.select("user_id"), "user_id", "left_semi")
    close = _fuzzy(open3, candidates)
    by_spelling = open3.join(close, "key").select("ref", "user_id", "display_name", F.lit("fuzzy").alias("method"), "score")
    found = materialize(by_id.unionByName(by_name).unionByName(by_part).unionByName(by_spelling))
    rest = asked.join(found.select("ref"), "ref", "left_anti").select(
        "ref", F.when(F.col("key") == "", F.col("ref")).otherwise(F.col("key")).alias("user_id"),
        F.lit(None).cast("string").alias("display_name"), F.lit("unresolved").alias("method"),
        F.lit(None).cast("double").alias("score"))
    return found.unionByName(rest)


def _unique_part(refs: DataFrame, names: DataFrame) -> DataFrame:
    """References that are part of exactly one name.

    A name contains a text of three letters or more only if it contains its first three, so
    names are joined by their letter triples and the whole text is tested afterwards.
    """
    def triples(s: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))
    lowered = refs.select("ref", F.lower("key").alias("part")).withColumn("triple", F.explode(triples(F.col("part"))))
    listed = materialize(
        names.withColumn("_l", F.lower("display_name")).filter(F.length("_l") >= 3)
        .withColumn("triple", F.explode(triples(F.col("_l"))))
        .join(lowered.select("triple").distinct(), "triple", "left_semi"))
    common = listed.groupBy("triple").agg(F.count(F.lit(1)).alias("_n"))
    # A triple that no name has rules the reference out; otherwise its rarest one is joined on.
    lowered = (lowered.join(common, "triple", "left").groupBy("ref", "part")
               .agg(F.min_by("triple", F.struct(F.coalesce("_n", F.lit(0)), "triple")).alias("triple")))
    hits = (lowered.join(listed, "triple").filter(F.contains("_l", "part"))
            .groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("display_name", "user_id")).alias("m")))
    return hits.filter("n = 1").select("ref", "m.user_id", "m.display_name", F.lit("partial").alias("method"),
                                       F.lit(None).cast("double").alias("score"))
