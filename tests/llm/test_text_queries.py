"""Registered text queries against their SQL and the pipeline as a whole, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check_queries import TABLES, rows_of
from earshot.llm import plans, secret_scan
from earshot.llm.common import read_table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = plans.QUERIES[name](spark, FOLDER)
    res = con.execute(plans.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall())


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in plans.QUERIES) == list(range(1, 14))


def test_trained_secret_model_finds_unseen_random_tokens(spark):
    fitted = secret_scan.fit(secret_scan.labelled_tokens(read_table(spark, FOLDER, "documents")))
    rng = np.random.default_rng(8)
    signs = {"HEX": "0123456789ABCDEF", "base62": secret_scan.ALPHABET[:62], "base64": secret_scan.ALPHABET[:64]}
    unseen = [(kind, "".join(rng.choice(list(letters), n))) for kind, letters in signs.items() for n in (20, 24, 32, 40)
              for _ in range(100)]
    words = read_table(spark, FOLDER, "benchmark").select(F.lit("word"), F.explode(F.regexp_extract_all(
        "text", F.lit("[A-Za-z]{8,}"), F.lit(0)))).distinct()
    got = spark.createDataFrame(unseen, "kind string, token string").union(words).groupBy("kind").agg(F.avg(
        (secret_scan.score(F.col("token"), fitted) > 13.8).cast("int")).alias("share")).collect()
    shares = {r["kind"]: r["share"] for r in got}
    assert shares.pop("word") == 0 and len(shares) == 3 and min(shares.values()) > 0.95, shares
