"""What is sent with evidence rows to find an observation's last row: ord only where rows of one identity may differ in rule or path."""

import hashlib

from tidemark.operators import delta
from tidemark.plans.relation import RELATIONS

SCHEMA = "stage_id string, ord string, rule string, message string, severity string, path string, line bigint, symbol string, fingerprint string, metric string, value double, identity_kind string"


def found(spark, *rows):
    """Rows of (ord, rule, path, symbol, fingerprint)."""
    return spark.createDataFrame([("s", o, r, "m", "low", p, 1, x, f, "", None, "name") for o, r, p, x, f in rows], SCHEMA)


def made(rule, path, symbol):
    return hashlib.sha256("\0".join([rule, path, symbol, "m"]).encode()).hexdigest()[:20]


def last(spark, base, head):
    given = {"ev_base": delta._own(base), "ev_head": delta._own(head)}
    return sorted(str(r["last"]) for r in RELATIONS["observed_rows"].over(**given).select("last").collect())


def rules(spark, base, head):
    return {r.identity: r.rule for r in delta.match(base, head).collect()}


def test_only_rows_with_a_fingerprint_send_their_ord(spark):
    base, head = found(spark, ("1", "a", "p", "x", ""), ("2", "a", "p", "y", "f")), found(spark, ("3", "a", "p", "x", None), (None, "a", "p", "z", ""))
    assert last(spark, base, head) == ["", "", "2", "None"]


def test_a_fingerprint_that_looks_like_a_made_identity_sends_all(spark):
    name = made("a", "p", "x")
    base, head = found(spark, ("2", "a", "p", "x", ""), ("1", "b", "q", "", name)), found(spark, ("9", "c", "r", "", "g"))
    assert last(spark, base, head) == ["1", "2", "9"]
    assert rules(spark, base, head) == {name: "a", "g": "c"}
    assert rules(spark, found(spark, ("2", "a", "p", "x", ""), ("3", "b", "q", "", name)), head)[name] == "b"


def test_texts_that_run_together_have_the_last_rows_rule(spark):
    name = made("a\0b", "p", "x")
    rows = [("2", "a\0b", "p", "x", ""), ("1", "a", "b\0p", "x", "")]
    assert rules(spark, found(spark, *rows), found(spark, ("1", "c", "q", "", "g")))[name] == "a\0b"
    assert rules(spark, found(spark, rows[0], ("3", "a", "b\0p", "x", "")), found(spark, ("1", "c", "q", "", "g")))[name] == "a"
    # without a path there is no identity, but still a last row
    assert rules(spark, found(spark, ("1", "a", None, "x", ""), ("2", "b", None, "x", "")), found(spark, ("1", "c", "q", "", "g")))[None] == "b"
