"""Quality rules: lines that many documents of a host share are removed, depleted documents are rejected.

Native columns only. The first pass hashes normalised lines and counts, for each host, the distinct documents a line
is in. A document is known by the hash of its whole text: exact copies count as one document, and their text isn't taken
for boilerplate. Lines above the host's limit (`max_share` of its documents, and over `min_docs`) are boilerplate. At most
mean lines per document / max_share lines of a large host can be above it, so the lines of a host fit in one row; the
second pass joins that row to each document of the host and works inside the document.

Defined cases: a null or empty text has no words and lines and is rejected as too short. A null host is a host of its
own. Repeated rows are judged alike and all returned. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import SPACE, WORD, bounded, let, shingle_hashes, whole, words_of

SYMBOLS = r"[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    """Lower case, digits as one 0, single spaces, no spaces at the ends."""
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " ")
    return F.trim(squeezed)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))


def _line_hash(line: Column) -> Column:
    """The first 60 bits of the md5 of the normalised line, which any SQL engine can compute."""
    return F.conv(F.substring(F.md5(normal_line(line)), 1, 15), 16, 10).cast("long")


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", max_share: float = 0.05,
                   min_docs: int = 10) -> DataFrame:
    """One row per host that has any: `host`, `frequent` (sorted hashes of the lines above its limit)."""
    named = docs.select(F.col(host).alias("host"), whole(text).alias("body"))
    hashed = named.select("host", F.xxhash64("body").alias("document"),
                          F.array_distinct(F.transform(_lines(F.col("body")), _line_hash)).alias("lines"))
    seen = hashed.select("host", "document", F.explode("lines").alias("line")).distinct()
    per_line = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    hosts = named.groupBy("host", F.xxhash64("body").alias("document")).count() \
        .groupBy("host").agg(F.count(F.lit(1)).alias("all_documents"))
    limit = F.greatest(F.lit(float(min_docs)), F.col("all_documents") * F.lit(max_share))
    marked = per_line.where(F.col("documents") > min_docs).alias("l").join(
        hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
    return (marked.where(F.col("documents") > limit)
            .groupBy(F.col("l.host").alias("host")).agg(F.sort_array(F.collect_set("line")).alias("frequent")))


def repeat_words(words: Column, width: int = 5) -> Column:
    """Number of words in windows of `width` words that occur twice or more in the text."""
    def covered(hashes: Column) -> Column:
        def starts(order: Column) -> Column:
            same = F.filter(order, lambda s, i: (s["h"] == F.get(order, i - 1)["h"])
                            | (s["h"] == F.get(order, i + 1)["h"]))
            return F.array_sort(F.transform(same, lambda s: s["i"]))

        def total(found: Column) -> Column:
            gaps = F.transform(found, lambda p, i: F.least(
                F.lit(width), F.coalesce(F.get(found, i + 1) - p, F.lit(width))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(ordered, starts), total))

    return F.when(F.size(words) >= width, let(shingle_hashes(words, width), covered)).otherwise(F.lit(0).cast("long"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_share: float = 0.05,
          min_docs: int = 10, min_left: float = 0.3, min_words: int = 10, max_repeat_pct: int = 20,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document with its counts, the text without frequent lines, and the verdict.

    Columns: the id, the columns of `carry`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, removed_words, removed_lines, cleaned (null if the text is null), kept. A document is kept if its
    base counts pass and at least `min_left` of its words are left.
    """
    limits = bounded(frequent_lines(docs, text, host, max_share, min_docs), F.size("frequent"))
    named = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate((doc_id, *carry))],
                        F.col(host).alias("its_host"), F.col(text).alias("its_text"))
    joined = named.join(limits, F.col("its_host").eqNullSafe(F.col("host")), "left")
    body = whole("its_text")
    split = joined.select("*", words_of(body).alias("words"), _lines(body).alias("lines"),
                          F.when(F.col("frequent").isNotNull(), F.split(body, "\n")).alias("raw_lines"))

    def dropped(line: Column) -> Column:
        return F.rlike(line, F.lit(WORD)) & F.array_contains("frequent", _line_hash(line))

    split = split.withColumn("gone", F.coalesce(F.filter("raw_lines", dropped), F.array().cast("array<string>")))
    counted = split.select(
        "*", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count(F.concat_ws(" ", "gone"), F.lit(WORD)).cast("long").alias("removed_words"),
        F.size("gone").cast("long").alias("removed_lines"),
        F.when(F.size("gone") == 0, F.col("its_text"))
        .otherwise(F.concat_ws("\n", F.filter("raw_lines", lambda x: ~dropped(x)))).alias("cleaned"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    # A caller's filter on generated columns isn't pushed into the work above, which would then be done twice and more.
    return counted.select(F.inline(F.array(F.struct(
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate((doc_id, *carry))],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "removed_words", "removed_lines", "cleaned", (~failed & (left >= min_left * F.col("n_words"))).alias("kept")))))
