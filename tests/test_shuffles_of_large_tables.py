"""What is shuffled must not jump when a table outgrows Spark's own broadcast limit."""

from earshot.plans.fixtures import Inputs
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def test_line_items_are_not_shuffled_to_meet_suppliers(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Inputs(spark, FOLDER).listens._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(l_suppkey" not in plan
