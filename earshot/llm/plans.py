"""The registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import (
    fingerprints,
    html_extraction,
    language_id,
    license_scan,
    merkle,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    token_alignment,
)
from earshot.llm.common import read_table

BASE_SQL = r"""
words AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)),
                             lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents)"""

RULES_SQL = r"""
WITH """ + BASE_SQL.strip() + r""",
hashed AS (
  SELECT doc_id, source, text, lines, list_transform(lines, lambda x: ('0x' || substr(md5(trim(regexp_replace(
    regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), 1, 15))::BIGINT) AS h FROM words),
spread AS (SELECT doc_id, source, unnest(h) AS line, unnest(lines) AS raw FROM hashed),
seen AS (SELECT source, coalesce(text, '') AS doc, unnest(list_distinct(h)) AS line
         FROM (SELECT doc_id, source, h, text FROM hashed) WHERE len(h) > 0),
per_line AS (SELECT source, line, count(DISTINCT doc) AS documents FROM seen GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT coalesce(text, '')) AS all_documents FROM documents GROUP BY ALL),
frequent AS (SELECT p.source, p.line FROM per_line p JOIN hosts h ON p.source IS NOT DISTINCT FROM h.source
             WHERE documents > greatest(10.0, all_documents * 0.05)),
gone AS (SELECT s.doc_id, sum(len(regexp_extract_all(s.raw, '[^\x20\x09-\x0D]+'))) AS n FROM spread s
         JOIN frequent f ON s.source IS NOT DISTINCT FROM f.source AND s.line = f.line GROUP BY ALL),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY ALL),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS removed
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND n_words - removed >= 0.3 * n_words AS kept,
       removed::BIGINT AS removed_words
FROM base"""

MIX_SQL = r"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
               FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY ALL),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight,
                    source_size * 3.0::DOUBLE AS most FROM per),
leveled AS (SELECT *, row_number() OVER o AS nth,
                   (sum(source_size) OVER () - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
                                                                               AND 1 PRECEDING), 0) * 3.0::DOUBLE)
                   / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
                                                                      AND 1 PRECEDING), 0))::DOUBLE AS level
            FROM weighted WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
chosen AS (SELECT arg_min(level, nth) AS level FROM leveled WHERE level <= most / weight),
targets AS (SELECT source, source_size, least(weight * chosen.level, most) AS target FROM leveled, chosen),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
placed AS (SELECT doc_id, source, size, ((length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0))) * 64
                  + floor(('0x' || substr(md5('mix:place:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 64))::BIGINT AS stratum,
                  ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM sizes),
strata AS (SELECT source, stratum, count(*) AS n FROM placed GROUP BY ALL),
counted AS (SELECT *, (coalesce(sum(n) OVER (PARTITION BY source ORDER BY stratum
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS before,
                   ('0x' || substr(md5('mix:start:' || coalesce(source, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS start
            FROM strata),
chances AS (SELECT c.source, stratum, source_size, target, rate,
                   (floor((before + n) * (rate - floor(rate)) + start) - floor(before * (rate - floor(rate)) + start)) / n AS chance
            FROM counted c JOIN rated r ON c.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(rate) + (draw < chance)::BIGINT))::BIGINT AS taken
FROM placed p JOIN chances c ON p.source IS NOT DISTINCT FROM c.source AND p.stratum = c.stratum"""

LICENSE_SQL = r"""
WITH templates(template_id, license, template) AS (VALUES {values}),
tw AS (SELECT template_id, license, regexp_extract_all(lower(template), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM templates),
tn AS (SELECT *, least(len(w), 5) AS k FROM tw WHERE len(w) > 0),
ts AS (SELECT template_id, license, k, list_transform(range(0, len(w) - k + 1),
                                                      lambda i: array_to_string(w[i + 1:i + k], ' ')) AS s FROM tn),
tp AS (SELECT template_id, license, k, len(s) AS m, list_distinct(s) AS d, unnest(s) AS g, unnest(range(0, len(s))) AS o FROM ts),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS g,
              unnest(range(0, len(w) - k + 1)) AS p FROM dw, (SELECT DISTINCT k FROM tn) WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, template_id, license, dg.k, m, d, p - o AS start,
               ceil(m * 0.19999999999999996::DOUBLE)::BIGINT AS slack FROM dg JOIN tp ON dg.g = tp.g AND dg.k = tp.k),
part AS (SELECT hit.*, w[greatest(start - slack, 0) + 1:greatest(start - slack, 0) + m + k - 1 + slack
                         + least(slack, greatest(start, 0))] AS r FROM hit JOIN dw USING (doc_id)),
share AS (SELECT doc_id, template_id, license, len(list_intersect(d, there))::DOUBLE / len(d) AS c,
                 greatest(start - slack, 0) + list_position(list_transform(there, lambda x: list_contains(d, x)), true) - 1
                   AS start_word
          FROM (SELECT *, list_transform(range(0, greatest(len(r) - k + 1, 0)),
                                         lambda i: array_to_string(r[i + 1:i + k], ' ')) AS there FROM part))
SELECT doc_id, template_id, license, max(c) AS containment, arg_max(start_word, struct_pack(c := c, s := -start_word)) AS start_word
FROM share WHERE c >= 0.8 GROUP BY doc_id, template_id, license""".replace("{values}", ", ".join(
    "('" + "', '".join(part.replace("'", "''") for part in row) + "')" for row in license_scan.TEMPLATES))

_VALUE = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"


def _manifest_sql(depth: int = 8, groups_depth: int = 4) -> str:
    """Trees of at most 8 ** `depth` leaves and 8 ** `groups_depth` languages."""
    def row(text: str) -> str:
        return "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    # The CRC-32 of the decimal id, by its table of 256 entries.
    parts = [r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
               CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
checked AS (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 3 = 0 AS hit
            FROM documents, crc),
changed AS (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END
                      AS other FROM checked),
leaves AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS tree, """ + row("text") + " AS leaf, "
             + row("other") + r""" AS found FROM changed),
w0 AS (SELECT *, found AS f0, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p0, '' AS path FROM leaves),
n0 AS (SELECT tree, p0 AS pos, leaf AS digest FROM w0)"""]
    for k in range(depth):
        parts.append(f"""
r{k} AS (SELECT tree, pos // 8 AS pos, list(digest ORDER BY pos) AS run, sum(count(*)) OVER (PARTITION BY tree) AS size
         FROM n{k} GROUP BY tree, pos // 8),
n{k + 1} AS (SELECT tree, pos, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM r{k})""")
    parts.append(f"""
top AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS nth FROM n{depth}),
n{depth + 1} AS (SELECT '' AS tree, nth AS pos, subroot AS digest FROM top)""")
    for k in range(depth + 1, depth + 1 + groups_depth):
        parts.append(f"""
r{k} AS (SELECT tree, pos // 8 AS pos, list(digest ORDER BY pos) AS run, sum(count(*)) OVER (PARTITION BY tree) AS size
         FROM n{k} GROUP BY tree, pos // 8),
n{k + 1} AS (SELECT tree, pos, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM r{k})""")
    steps = [*range(depth), *range(depth + 1, depth + 1 + groups_depth)]
    for i, k in enumerate(steps):
        if k == depth + 1:
            parts.append(f"\nt{i} AS (SELECT w{i}.* REPLACE (nth AS p{i}, '' AS tree), subroot FROM w{i} JOIN top USING (tree))")
        left, right = (f"array_to_string(run[{r}], '')" for r in (f"1:p{i} % 8", f"p{i} % 8 + 2:"))
        parts.append(f"""
w{i + 1} AS (SELECT w.* REPLACE (CASE WHEN r.size > 1 THEN path || {left} || {right} ELSE path END AS path),
             CASE WHEN r.size > 1 THEN sha256({left} || f{i} || {right}) ELSE f{i} END AS f{i + 1}, p{i} // 8 AS p{i + 1}
      FROM {'t' if k == depth + 1 else 'w'}{i} w JOIN r{k} r ON w.tree = r.tree AND p{i} // 8 = r.pos)""")
    last = len(steps)
    return ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(path) AS proof_sha256, f{last} AS folded_root, f{last} = digest AS verified
FROM w{last}, n{steps[-1] + 1}"""


MANIFEST_SQL = _manifest_sql()


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the line-frequency verdict of every document."""
    judged = quality_rules.judge(read_table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "removed_words")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Target and taken words of every document in the mix of its source."""
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document in eight shards of near-equal bytes."""
    placed = sharding.shard(read_table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices found in every document."""
    return license_scan.scan(read_table(spark, folder, "documents"), license_scan.template_table(spark))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, from models that never saw a held-out quarter's labels."""
    return language_id.held_out_languages(read_table(spark, folder, "documents"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edit with the next document, and how alike they are."""
    return fingerprints.with_next(read_table(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, from labels outside the held-out fifth."""
    return quality_classifier.held_out_quality(read_table(spark, folder, "documents"),
                                               read_table(spark, folder, "labels"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens in pieces of sequences of at most 2048, balanced by cost."""
    return packing.pack(read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: base spans and those the Markov models add."""
    docs = read_table(spark, folder, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(secret_scan.labelled_tokens(docs)))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda k: k == kind), False)).cast("long").alias(f"n_{kind}")
              for kind, *_ in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.written(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Digest, roots, proof and check of every document; texts of a third of the ids are tampered with before the check."""
    return merkle.manifest(read_table(spark, folder, "documents"), altered={"text": merkle.lowered_thirds()})


def op12_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page, by wrappers induced from all pages."""
    return html_extraction.main_text(read_table(spark, folder, "pages"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers over every document, and how frequent the linked ids are corpus-wide."""
    return token_alignment.consistency(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_html_extraction": op12_html_extraction,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {
    "op1_quality_rules": RULES_SQL,
    "op2_mixing": MIX_SQL,
    "op4_license_scan": LICENSE_SQL,
    "op11_merkle_manifest": MANIFEST_SQL,
}
