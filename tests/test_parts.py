"""Rows are dealt into parts that grow in number with the rows, so that a task's memory doesn't grow with the input."""

import re

import pytest

from tidemark.operators import delta, enclosing, token_rules  # noqa: F401  they define relations
from tidemark.plans.relation import RELATIONS

EVIDENCE = "'s' as snapshot_id, 't' as stage_id, cast(id as string) as ord, 'r' as rule, '' as message, 'low' as severity, 'p' as path, id as line, '' as symbol, '' as fingerprint, 'm' as metric, 1.0d as value, 'name' as identity_kind"
GIVEN = {
    "observed_rows": {"ev_base": EVIDENCE, "ev_head": EVIDENCE}, "token_findings": {"ev_tokens": "cast(id % 7 as string) as path, id as seq, concat('T_', id) as kind, substring('(;', cast(id % 2 as int) + 1, 1) as text, 1L as line"},
    "enclosing_names": {"ev_declarations": "'p' as path, 'n' as name, id as start_line, id as end_line", "ev_observations": "'p' as path, id as line, 'f' as function"},
}


@pytest.mark.parametrize("name", GIVEN)
def test_parts_follow_rows(spark, name):
    def most(n):
        made = RELATIONS[name].over(**{k: spark.sql(f"select {columns} from range({n})") for k, columns in GIVEN[name].items()})
        return max(int(x) for x in re.findall(r"hashpartitioning\([^()]*?, (\d+)\), REPARTITION", made._jdf.queryExecution().executedPlan().toString()))

    assert most(100) == spark.sparkContext.defaultParallelism and most(8_000_000) >= 16


def test_the_innermost_of_declarations_on_a_line_names_it(spark):
    declared = spark.createDataFrame([("p", "A", 510, 2000), ("p", "A.f", 512, 1500), ("p", "A.f.g", 512, 600)], "path string, name string, start_line long, end_line long")
    seen = spark.createDataFrame([("p", 512, "x.g"), ("p", 512, "x.f"), ("p", 513, "x.g"), (None, 512, "x.g")], "path string, line long, function string")
    rows = {tuple(r) for r in enclosing.enclosing(seen, declared).collect()}
    assert rows == {("p", 512, "x.g", "A.f.g", "A.f.g"), ("p", 512, "x.f", "A.f.g", "x.f"), ("p", 513, "x.g", "A.f.g", "x.g"), (None, 512, "x.g", None, "x.g")}
