"""Score policy on the canonical tables: fixtures FX-1 to FX-7."""

import math

import pytest

from tidemark import schema
from tidemark.operators import assessment

CLEAN = {
    "lint": {"issue_count": 0.0}, "types": {"error_count": 0.0, "warning_count": 0.0}, "complexity": {"max_cc": 2.0}, "duplication": {"duplication_percent": 0.0},
    "security": {}, "hygiene": dict.fromkeys(("license_file", "nontrivial_readme", "test_files", "gitignore_file"), True),
}
COLUMNS = [f.split()[0] for f in schema.STAGES.split(", ")]


def stages(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], schema.STAGES)


def stage(stage_id, category=None, status="ok", required=True, snapshot="s", **metrics):
    return {"snapshot_id": snapshot, "stage_id": stage_id, "category": category or stage_id, "status": status, "required": required, "reason": "", **metrics}


def clean(**changed):
    return [stage(c, **{**m, **changed.get(c, {})}) for c, m in CLEAN.items()]


def findings(spark, *rows):
    names = [f.split()[0] for f in schema.FINDINGS.split(", ")]
    base = {"snapshot_id": "s", "message": "m", "path": "p", "line": 1, "symbol": "", "fingerprint": "", "metric": "", "identity_kind": "name", "rule": "r"}
    return spark.createDataFrame([tuple({**base, "ord": f"{i:04d}", **r}.get(c) for c in names) for i, r in enumerate(rows)], schema.FINDINGS)


def result(spark, rows, *found):
    return assessment.assess(stages(spark, *rows), findings(spark, *found)).first()


def test_clean_snapshot_earns_everything(spark):
    r = result(spark, clean())
    assert (r.score, r.grade, r.complete, r.decision) == (100.0, "A", True, "no_configured_blockers")


@pytest.mark.parametrize("status", ["missing", "failed", "limited"])
def test_missing_measurement_is_not_a_score(spark, status):
    r = result(spark, clean(lint={"status": status}))
    assert (r.score, r.grade, r.complete, r.decision) == (None, "?", False, "unknown")


def test_invalid_measurement_is_missing(spark):
    assert result(spark, clean(lint={"issue_count": math.nan})).score is None
    assert result(spark, clean(complexity={"max_cc": None})).score is None
    assert result(spark, clean(lint={"issue_count": -1.0})).score is None


def test_critical_finding_holds_despite_a_gap(spark):
    r = result(spark, clean(lint={"status": "missing"}), {"stage_id": "security", "severity": "critical"})
    assert (r.decision, r.score) == ("hold", None)
    codes = assessment.exit_codes(stages(spark, *clean(lint={"status": "missing"})), findings(spark, {"stage_id": "security", "severity": "critical"}))
    assert codes.first().exit_code == 1


def test_worst_stage_of_a_category_counts(spark):
    extra = stage("types2", "types", error_count=12.0, warning_count=0.0)
    r = result(spark, [*clean(), extra])
    assert r.score == 90.0  # types 50, the others 100


def test_blocked_score_is_capped(spark):
    r = result(spark, clean(complexity={"max_cc": 51.0}))
    assert (r.score, r.grade, r.decision, r.blockers) == (20.0, "F", "hold", 1)


def test_observed_score_says_what_it_covers(spark):
    rows = [stage("lint", issue_count=6.0), stage("lint2", "lint", "failed"), stage("types", status="limited"), stage("complexity", max_cc=15.0)]
    r = assessment.observe(stages(spark, *rows), findings(spark)).first()
    assert (r.score, r.weight, r.applicable, r.partial) == (80.71, 35, 55, "lint,types")


def test_rounding_is_half_to_even(spark):
    rows = [stage("lint", issue_count=1.0), stage("duplication", duplication_percent=11.0), stage("hygiene", license_file=True, nontrivial_readme=False, test_files=False, gitignore_file=False)]
    assert result(spark, rows).score == 68.12  # (15*90 + 15*75 + 10*25) / 40 = 68.125


def test_medium_finding_asks_for_review(spark):
    assert result(spark, clean(), {"stage_id": "lint", "severity": "medium"}).decision == "review"
