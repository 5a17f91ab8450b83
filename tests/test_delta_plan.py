"""Evidence rows are dealt once: more exchanges of whole evidence sets don't fit the disks of large inputs."""

from tidemark.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString(), QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_match_deals_rows_once(spark):
    assert plan(spark, "q_delta_match")[1].count("Exchange ") == 1


def test_items_read_both_sides_once(spark):
    assert plan(spark, "q_delta_items")[0].count("Union") == 1
