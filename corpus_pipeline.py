"""The corpus pipeline: quality rules, near-dedup, secret scans, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes the rows of a stage as Parquet below the
shared folder and reads them again as the next one's documents, so a lost executor repeats one stage at most.

Defined cases: nulls in any column, empty texts, repeated rows, an empty table and extra columns pass through every
stage without error; stages return the columns of documents and drop others. Rows that repeat both id and text
count as one in the dedup stage; ties between copies go to the smallest id, then text hash. Very long texts pass whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import mixing, near_copies, packing, quality_rules, secret_scan
from earshot.llm.common import read_table, whole
from earshot.session import materialize, workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, and lines that too many documents of a source share."""
    judged = quality_rules.judge(docs, carry=("lang", "source", "n_chars"))
    return judged.where("kept").select(
        "doc_id", F.col("cleaned").alias("text"), "lang", "source",
        F.when(F.col("removed_lines") > 0, F.char_length("cleaned").cast("long")).otherwise(F.col("n_chars"))
        .alias("n_chars"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (SimHash balls and MinHash keys, then Jaccard 0.8 of five
    words): the one with the smallest id, nulls last, then the smallest text hash. Different texts of one id, or without
    an id, are documents of their own; rows equal in both are one."""
    classes = near_copies.near_classes(docs)
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"))
    chosen = materialize(classes.groupBy("root").agg(F.min(mine).alias("first"))
                         .select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key")))
    kept = docs.select(*COLUMNS, F.xxhash64(whole("text")).alias("text_key")).join(
        chosen, (F.col("text_key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    repeated = materialize(kept.groupBy("doc_id", "text_key").count().where("count > 1")
                           .select(F.col("doc_id").alias("again"), F.col("text_key").alias("again_key")))
    same = (F.col("text_key") == F.col("again_key")) & F.col("doc_id").eqNullSafe(F.col("again"))
    one = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return kept.join(repeated, same, "left_anti").union(one).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark."""
    model = secret_scan.fit(secret_scan.labelled_tokens(docs))
    found = secret_scan.scan(docs, model, carry=("text", "lang", "source", "n_chars"))
    clean = found.withColumn("safe", secret_scan.redact(F.col("text"), F.col("spans")))
    return clean.select("doc_id", F.col("safe").alias("text"), "lang", "source",
                        F.when(F.size("spans") > 0, F.char_length("safe").cast("long")).otherwise(F.col("n_chars"))
                        .alias("n_chars"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights."""
    return mixing.emit(mixing.mix(docs, carry=("text", "lang", "source", "n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' tokens in sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", rules_stage),
    ("simhash_dedup", dedup_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mix_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the hash of the fingerprints nor the tokenizer; tests/llm checks stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of `sf_dir`."""
    docs = read_table(spark, sf_dir, "documents")
    folder = workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
