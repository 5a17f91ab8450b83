"""Delta matching: fixtures FX-8 to FX-11, and random bags against a plain matcher."""

from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import delta

SCHEMA = "stage_id string, ord string, rule string, message string, severity string, path string, line bigint, symbol string, fingerprint string, metric string, value double, identity_kind string"


def rows(spark, found):
    return spark.createDataFrame(
        [("c", f"{i:04d}", "native.high-complexity", m, s, "example.ts", line, "", name, metric, v, "name") for i, (name, metric, v, s, m, line) in enumerate(found)], SCHEMA
    )


def measured(value, name="x", line=2):
    return (name, "cyclomatic_complexity", float(value), "high" if value > 50 else "medium", f"complexity {value}", line)


def outcome(spark, base, head):
    return {r.identity: r for r in delta.match(rows(spark, base), rows(spark, head)).collect()}


def test_a_move_is_no_change(spark):
    r = outcome(spark, [measured(52)], [measured(52, line=40)])["x"]
    assert (r.unchanged, r.added, r.resolved, r.changed) == (1, 0, 0, 0)


def test_growth_is_one_measured_change(spark):
    r = outcome(spark, [measured(52)], [measured(61)])["x"]
    assert (r.changed, r.delta, r.direction) == (1, 9.0, "worsened")


def test_changed_duplicates_are_ambiguous_and_never_resolved(spark):
    r = outcome(spark, [measured(61), measured(60)], [measured(59), measured(55)])["x"]
    assert (r.added, r.resolved, r.changed, r.ambiguous) == (2, 0, 0, True)


def test_location_is_three_valued(spark):
    found = rows(spark, [measured(52, line=20), measured(53, line=5)]).withColumnRenamed("x", "x")
    lines = lambda *r: spark.createDataFrame(list(r), "path string, start_line bigint, end_line bigint")
    flags = lambda m: {r.line: r.in_changed_lines for r in delta.in_changed_lines(found, m).collect()}
    assert flags(lines(("example.ts", 19, 21))) == {20: True, 5: False}
    assert flags(lines()) == {20: False, 5: False}
    assert flags(None) == {20: None, 5: None}


@pytest.mark.parametrize(
    "old,new,expected",
    [([51, 100], [90], "none"), ([52, 52], [52, 52, 52], "more"), ([52, 55], [51, 56], "larger"), ([52, 55], [51, 54], "none"), ([52, 55], [55, 52], "none")],
)
def test_rank_dominance(spark, old, new, expected):
    r = delta.rank_dominance(rows(spark, [measured(v) for v in old]), rows(spark, [measured(v) for v in new])).first()
    assert r.outcome == expected


FINDING = st.tuples(st.sampled_from("abc"), st.sampled_from(["", "cyclomatic_complexity"]), st.sampled_from([None, 51.0, 52.0]), st.sampled_from(["low", "high"]), st.sampled_from(["m", "n"]), st.just(1))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(FINDING, max_size=8), st.lists(FINDING, max_size=8))
def test_bags_match_a_plain_matcher(spark, base, head):
    seen = lambda f: (f[3], f[1], f[2], "" if f[1] else f[4])
    expected = {}
    for name in {f[0] for f in base + head}:
        old, new = (Counter(seen(f) for f in side if f[0] == name) for side in (base, head))
        gone, fresh, duplicate = (old - new).total(), (new - old).total(), old.total() > 1 or new.total() > 1
        change = gone and fresh and not duplicate
        expected[name] = ((old & new).total(), 0 if change else fresh, 0 if change or duplicate else gone, int(bool(change)), bool(duplicate and (gone or fresh)))
    got = {k: (r.unchanged, r.added, r.resolved, r.changed, r.ambiguous) for k, r in outcome(spark, base, head).items()}
    assert got == expected
    assert defaultdict(int, expected) == got
