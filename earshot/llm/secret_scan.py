"""Secret scans: three base patterns, and character Markov models that tell random strings from identifiers.

Native columns only. A candidate token gets the log-likelihood ratio of its character pairs under a model of random
strings and a model of ordinary words and identifiers, both trained from labelled samples with add-one smoothing. Random
strings of each class (hexadecimal in either case, base 62, base 64) have a model of their own and the best ratio counts. A
token is a secret if it exceeds the prior odds against it. A model is one array of pair scores, so scoring is a lookup
per character inside the row; its size depends on the alphabet only.

Positions come from cutting the text at the matches: the lengths of gaps and matches add up to them.

Defined cases: a null or empty text has no spans. Repeated rows are scanned alike. An empty table gives an empty table;
with no samples both models are uniform and nothing is added. Other columns are kept only if named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import let, whole

#: Kinds in order, each with its pattern, the group whose length counts, and the least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: What a text must contain before a pattern is worth its positions.
HINTS = (r"(?i)passw|secret|token|api_?key", r"AKIA", r"[0-9a-f]{16}")
#: The run pattern above finds every hex letter of a word; runs long enough are the same matches and far fewer.
HEX_RUN = r"[0-9a-f]{16,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SIDE = len(ALPHABET) + 1
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: A word or identifier of any length that has a pair of characters.
ORDINARY = r"[A-Za-z0-9+/_=-]{2,}"
#: What the base patterns catch, as one match each.
CAUGHT = (KINDS[0][1].replace("=-]+)", "=-]{12,})"), r"AKIA[A-Z0-9]{14,}", HEX_RUN)
#: Classes of random strings; the first whose alphabet holds all of a sample is its class, else the last.
CLASSES = (("hex", "^[0-9a-f]+$"), ("HEX", "^[0-9A-F]+$"), ("base62", "^[A-Za-z0-9]+$"), ("base64", ""))
ADDED = "markov"
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _spans(text: Column, pattern: str, keep, rank: int, kind: str, group: int = 0) -> Column:
    """Spans of the matches for which `keep(match, group text)` holds; starts and ends in code points."""
    def walk(found: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.char_length(F.get(found["gaps"], i))
            end = start + F.char_length(F.get(found["all"], i))
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                            F.lit(kind).alias("kind"))
            passes = keep(F.get(found["all"], i), F.get(found["group"], i))
            return F.struct(end.alias("pos"),
                            F.when(passes, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
        matches = F.size(found["all"])
        return F.when(matches > 0, F.aggregate(F.sequence(F.lit(0), matches - 1), zero, step)["out"]) \
            .otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("group")), walk)


def base_spans(text: Column) -> Column:
    """Base spans of all kinds, in the order of start and kind."""
    parts = []
    for rank, ((kind, pattern, group, least), hint) in enumerate(zip(KINDS, HINTS)):
        found = _spans(text, HEX_RUN if kind == "hex" else pattern,
                       lambda match, part, least=least: F.char_length(part) >= least, rank, kind, group)
        parts.append(F.when(F.rlike(text, F.lit(hint)), found).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.array_sort(F.concat(*parts))


def _place(token: Column, at: Column) -> Column:
    """Index of a character in the alphabet; 0 stands for all others."""
    return F.instr(F.lit(ALPHABET), F.substring(token, at, F.lit(1)))


def _pairs(tokens: DataFrame) -> DataFrame:
    """Rows (`random`, `kind`, `pair`) of each character pair of the tokens (`random` boolean, `token`)."""
    at = F.sequence(F.lit(1), F.char_length("token") - 1)
    kind = F.lit(CLASSES[-1][0])
    for name, alphabet in CLASSES[-2::-1]:
        kind = F.when(F.rlike("token", F.lit(alphabet)), name).otherwise(kind)
    return tokens.where(F.char_length("token") > 1).select(
        "random", F.when(F.col("random"), kind).otherwise("").alias("kind"), F.explode(F.transform(
            at, lambda i: _place(F.col("token"), i) * SIDE + _place(F.col("token"), i + 1))).alias("pair"))


def fit(tokens: DataFrame) -> list[list[float]]:
    """Log-likelihood ratio of each character pair, a list for each class of random strings that has samples, from
    labelled tokens (`random` boolean, `token` string).

    All samples count; what reaches the driver is one number per pair and label. A pair's first character is scored as
    its own start, so a token's ratio is the sum over its pairs.
    """
    counts = {(r["kind"], r["pair"]): r["n"] for r in
              _pairs(tokens).groupBy("kind", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}

    def chances(label: str) -> list[float]:
        out = []
        for first in range(SIDE):
            row = [counts.get((label, first * SIDE + second), 0) + 1 for second in range(SIDE)]
            out += [n / sum(row) for n in row]
        return out

    seen = {kind for kind, _ in counts}
    ordinary = chances("")
    return [[round(math.log(r / o), 6) for r, o in zip(chances(kind), ordinary)]
            for kind, _ in CLASSES if kind in seen] or [[0.0] * SIDE ** 2]


def score(token: Column, model: list) -> Column:
    """Log-likelihood ratio of a token, the best of the model's lists: above zero it is more like a random string."""
    lists = model if isinstance(model[0], list) else [model]
    at = F.sequence(F.lit(1), F.greatest(F.char_length(token) - 1, F.lit(1)))

    def total(pairs: Column, ratios: list[float]) -> Column:
        table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
        return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.get(table, p))

    def best(pairs: Column) -> Column:
        sums = [total(pairs, ratios) for ratios in lists]
        return F.greatest(*sums) if len(sums) > 1 else sums[0]

    return F.when(F.char_length(token) > 1, let(F.transform(
        at, lambda i: _place(token, i) * SIDE + _place(token, i + 1)), best)).otherwise(F.lit(0.0))


def labelled_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled samples from the documents themselves.

    Random: values that base patterns catch, and digests of the texts written in base 64, base 62 and hexadecimal.
    Ordinary: all words and identifiers outside what base patterns catch. Each distinct token counts once, so copies of a
    text add nothing.
    """
    body = docs.select(whole(text).alias("body"))
    caught = body.where(F.rlike("body", F.lit(HINTS[0]))).select(F.explode(
        F.regexp_extract_all("body", F.lit(KINDS[0][1]), F.lit(2))).alias("token")) \
        .where(F.char_length("token") >= KINDS[0][3])
    digest = F.base64(F.unhex(F.sha2("body", 256)))
    made = body.where(F.col("body") != "").select(F.explode(F.array(
        digest, F.regexp_replace(digest, "[+/=]", ""), F.upper(F.md5("body")), F.md5("body"))).alias("token"))
    rest = F.col("body")
    for pattern, hint in zip(CAUGHT, HINTS):
        rest = F.when(F.rlike("body", F.lit(hint)), F.regexp_replace(rest, F.lit(pattern), F.lit(" "))).otherwise(rest)
    plain = body.select(F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0)))).alias("token"))
    return (caught.union(made).distinct().select(F.lit(True).alias("random"), "token")
            .union(plain.distinct().select(F.lit(False), "token")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: list[float], doc_id: str = "doc_id", text: str = "text", odds: float = 13.8,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document with its base spans and all spans.

    Columns: the id, the columns of `carry`, `base` and `spans` (arrays of start, rank, end, kind). `odds` is the
    logarithm of the prior odds against a token being a secret (13.8: one in a million). Tokens that overlap a base
    span are not added again.
    """
    named = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate((doc_id, *carry))],
                        whole(text).alias("body"))
    based = named.select("*", base_spans(F.col("body")).alias("base"),
                         _spans(F.col("body"), CANDIDATE, lambda match, _: score(match, model) > odds, len(KINDS),
                                ADDED).alias("found"))
    added = F.filter("found", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return based.select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate((doc_id, *carry))], "base",
                        F.when(F.size("found") == 0, F.col("base"))
                        .otherwise(F.array_sort(F.concat("base", added))).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with the union of its spans replaced; touching or overlapping spans give one mark."""
    def rebuilt(parts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = s["start"] - acc["pos"]
            fresh = F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), gap.cast("int")),
                             F.lit(mark))
            joined = (gap < 0) | ((gap == 0) & (acc["pos"] > 0))
            return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                            F.when(joined, acc["out"]).otherwise(fresh).alias("out"))

        done = F.aggregate(parts, zero, step)
        return let(done, lambda d: F.concat(d["out"], F.substring(
            text, (d["pos"] + 1).cast("int"), F.char_length(text))))

    return F.when(F.size(spans) > 0, let(spans, rebuilt)).otherwise(text)
