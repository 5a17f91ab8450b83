"""Items and the roll-up are made of the rows of identities that differ; the others are not dealt."""

import pytest

from tidemark.operators import delta
from tidemark.plans.registry import QUERIES
from tidemark.plans.relation import RELATIONS
from tidemark.schema import FINDINGS, STAGES

ROW = "'c' as snapshot_id, 's' as stage_id, cast(id as string) as ord, 'r' as rule, 'm' as message, 'low' as severity, 'p' as path, id as line, '' as symbol, concat('f', id) as fingerprint, '' as metric, cast(null as double) as value, 'name' as identity_kind"


def findings(spark, *rows):
    """Rows of (fingerprint, ord, severity, metric, value, path)."""
    return spark.createDataFrame([("c", "s", o, "r", "m", s, p, 5, "", f, m, v, "name") for f, o, s, m, v, p in rows], FINDINGS)


def names(base, head):
    return sorted({r.identity for r in RELATIONS["differing_rows"].over(ev_base=base, ev_head=head).select("identity").collect()})


def test_rows_of_equal_identities_are_not_dealt(spark):
    base = spark.sql(f"select {ROW} from range(20000)")
    head = base.where("ord <> '7'").withColumn("severity", delta.F.expr("case when ord = '9' then 'high' else severity end"))
    dealt = RELATIONS["differing_rows"].over(ev_base=base, ev_head=head)
    got = {r.identity for r in dealt.select("identity").collect()}
    assert {"f7", "f9"} <= got and len(got) < 100


def test_no_difference_is_left_out(spark):
    same = [("same", "1", "low", "m", 1.0, "p"), ("zero", "1", "low", "m", 0.0, "p"), ("nan", "1", "low", "m", float("nan"), "p"), ("null", "1", None, "", None, "p")]
    base = findings(spark, *same, ("copies", "1", "low", "m", 1.0, "p"), ("copies", "2", "low", "m", 1.0, "p"), ("value", "1", "low", "m", 1.0, "p"), ("moved", "1", "low", "", None, "p"), ("nulls", "1", "low", None, None, "p"), ("gone", "1", "low", "m", 1.0, "p"))
    head = findings(spark, *same, ("copies", "1", "low", "m", 1.0, "p"), ("value", "1", "low", "m", 2.0, "p"), ("moved", "3", "low", "", None, "q"), ("nulls", "1", None, "low", None, "p"), ("new", "1", "low", "m", 1.0, "p"))
    assert names(base, head) == ["copies", "gone", "new", "nulls", "value"]
    assert names(base, base) == []


def test_a_kind_that_changes_differs(spark):
    base = findings(spark, ("x", "1", "low", "m", 1.0, "p"), ("y", "1", "low", "m", 1.0, "p"))
    assert names(base, base.withColumn("identity_kind", delta.F.expr("if(fingerprint = 'x', 'body', 'name')"))) == ["x"]


def test_rows_without_snapshot_or_stage_are_apart(spark):
    base = findings(spark, ("x", "1", "low", "m", 1.0, "p"))
    assert names(base.withColumn("stage_id", delta.F.lit("c")).withColumn("snapshot_id", delta.F.lit(None).cast("string")), base.withColumn("stage_id", delta.F.lit(None).cast("string"))) == ["x"]


@pytest.mark.parametrize("name", ["q_comparison_exit", "q_delta_assessment"])
def test_the_roll_up_deals_only_rows_that_differ(spark, name):
    """All rows are dealt for critical observations and blocking values only, of which there are few."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = ["getbit(" in "".join(plan[i : i + 3]) for i, line in enumerate(plan) if "RepartitionByExpression [snapshot_id" in line]
    assert dealt.count(True) == 3 and dealt.count(False) == 2


def items(spark, base, head):
    stage = ("c", "s", "lint", "ok", True, "t", "1", "", "all", 1, 1, 1.0, None, None, None, None, None, None, None, None, "full")
    stages = spark.createDataFrame([stage], STAGES + ", profile string")
    lines = lambda *paths: spark.createDataFrame([(p, 1, 9) for p in paths], "path string, start_line long, end_line long")
    given = {"ev_base": base, "ev_head": head, "ev_base_stages": stages, "ev_head_stages": stages, "ev_changed_lines": lines("p", "new"), "ev_base_lines": lines("old")}
    rows = RELATIONS["delta_items"].frame(spark, "", given).collect()
    return {(r.identity, r.outcome): (r.path, r.in_changed_lines, r.base_path, r.base_in_changed_lines) for r in rows}


def test_each_side_has_the_lines_of_its_own_path(spark):
    base = findings(spark, ("moved", "1", "low", "", None, "old"), ("lost", "1", "low", "", None, "p"), ("gone", "1", "low", "", None, "old"))
    head = findings(spark, ("moved", "1", "high", "", None, "new"), ("lost", "1", "high", "", None, None), ("new", "1", "low", "", None, "p"))
    assert items(spark, base, head) == {
        ("moved", "changed"): ("new", True, "old", True), ("lost", "changed"): (None, False, "p", False),
        ("gone", "resolved"): (None, None, "old", True), ("new", "added"): ("p", True, None, None),
    }


def test_items_deal_only_rows_that_differ(spark):
    plan = QUERIES["q_delta_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert ["getbit(" in "".join(plan[i : i + 3]) for i, line in enumerate(plan) if "RepartitionByExpression [snapshot_id" in line] == [True]
