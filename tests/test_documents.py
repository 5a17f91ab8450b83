"""Guards and walks over JSON documents against plain Python."""

import json
import random
from collections import Counter

from tidemark.operators import documents


def good(n=2, **changes):
    d = {"schema_version": 1, "summary": {"total_files": n, "analyzed_files": n, "skipped_files": 0}, "complexity": {"raw_metrics": [{"file_path": f"f{k}.py"} for k in range(n)], "errors": []}}
    return json.dumps(d | changes)


def test_each_wrong_shape_is_one_failed_row_with_its_reason(spark):
    cases = [
        (good(), ("ok", "")), (good() + " \n", ("ok", "")), ("  " + good(), ("ok", "")), (good() + "x", ("failed", "invalid JSON output")), (good() + "}", ("failed", "invalid JSON output")), (good() + "{}", ("failed", "invalid JSON output")),
        (good()[:-1] + ',"end":1', ("failed", "invalid JSON output")), ('1,"w":2', ("failed", "invalid JSON output")), ("", ("failed", "invalid JSON output")), (None, ("failed", "invalid JSON output")), ("{a:1}", ("failed", "invalid JSON output")),
        ("null", ("failed", "expected JSON object")), ("[]", ("failed", "expected JSON object")), ("3", ("failed", "expected JSON object")), (good(schema_version="1"), ("failed", "unsupported schema version")), (good(schema_version=None), ("failed", "unsupported schema version")),
        (good(schema_version=1.0), ("failed", "unsupported schema version")), (good(summary={"total_files": 2, "analyzed_files": 2}), ("failed", "expected nonnegative integer")), (good(summary={"total_files": 2.0, "analyzed_files": 2, "skipped_files": 0}), ("failed", "expected nonnegative integer")),
        (good(summary={"total_files": 2, "analyzed_files": 2, "skipped_files": False}), ("failed", "expected nonnegative integer")), (good(summary={"total_files": 2, "analyzed_files": 0, "skipped_files": 2}), ("failed", "invalid file coverage counts")),
        (good(summary={"total_files": 2, "analyzed_files": 1, "skipped_files": 1}, complexity={"raw_metrics": [{"file_path": "a"}], "errors": []}), ("limited", "")), (good(3), ("failed", "invalid file coverage counts")),
        (good(complexity={"raw_metrics": [{"file_path": "a"}, {"file_path": "a"}], "errors": []}), ("failed", "analyzed file locations disagree with summary")), (good(complexity={"raw_metrics": [{}, {"file_path": "a"}], "errors": []}), ("failed", "invalid source location")),
        (good(complexity={"raw_metrics": {}, "errors": []}), ("failed", "expected JSON list")), (good(complexity={"raw_metrics": [1, 2], "errors": []}), ("failed", "expected JSON object")), (good(complexity=[]), ("failed", "expected JSON object")),
    ]
    rows = documents.summary_guard(spark.createDataFrame([(k, 2, t) for k, (t, _) in enumerate(cases)], "doc_id long, eligible long, text string")).collect()
    assert {r.doc_id: (r.status, r.reason) for r in rows} == {k: e for k, (_, e) in enumerate(cases)}
    assert all((r.analyzed_files is None) == (r.status == "failed") for r in rows)


def tree(rng, depth):
    kind = rng.choice(["Block", "IfClause", "ForClause", "WhileClause", "CaseClause", "BinaryCmd", "BinaryTest", "FuncDecl", "Lit"])
    node = {"_kind": kind, "Pos": {"Line": rng.randrange(1, 90)}, "Text": "FuncDecl"}
    if kind == "FuncDecl":
        node |= {"Name": {"Value": rng.choice(["a", "b.c", "d\\e"])}, "Body": tree(rng, depth - 1) if depth else {"_kind": "Block"}}
    if kind == "IfClause":
        node |= rng.choice([{}, {"Cond": []}, {"Cond": None}, {"Cond": [{"_kind": "Lit"}]}, {"Cond": ""}])
    if kind in ("BinaryCmd", "BinaryTest"):
        node["Op"] = rng.choice(["&&", "||", "|"])
    if kind == "CaseClause":
        node["Items"] = [{"_kind": "CaseItem"}] * rng.randrange(4)
    if depth:
        node["Stmts"] = [rng.choice([1, "x", None, [tree(rng, 0)], tree(rng, depth - 1), tree(rng, depth - 1)]) for _ in range(rng.randrange(4))]
        node["X"] = tree(rng, depth - 1)
    return node


def model(node, owner, out):
    inner = owner
    if node["_kind"] == "FuncDecl":
        inner = [((owner[0] + ".") if owner else "") + node["Name"]["Value"].replace("\\", "\\\\").replace(".", "\\."), node["Pos"]["Line"], 1]
        out.append(inner)
    elif owner:
        k = node["_kind"]
        owner[2] += {"IfClause": int(bool(node.get("Cond"))), "ForClause": 1, "WhileClause": 1, "CaseClause": max(0, len(node.get("Items", [])) - 1), "BinaryCmd": int(node.get("Op") in ("&&", "||")), "BinaryTest": int(node.get("Op") in ("&&", "||"))}.get(k, 0)
    for v in node.values():
        for child in v if isinstance(v, list) else [v]:
            if isinstance(child, dict) and "_kind" in child:
                model(child, inner, out)
    return out


def test_decisions_of_random_trees(spark):
    rng = random.Random(11)
    trees = [tree(rng, rng.randrange(6)) for _ in range(150)]
    texts = [json.dumps(t) for t in trees] + ["{", "[]", None]
    rows = documents.shell_decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    expected = Counter((k, "ok", f, line, cc) for k, t in enumerate(trees) for f, line, cc in model(t, None, []))
    expected.update((150 + k, "failed", None, None, None) for k in range(3))
    assert Counter((r.doc_id, r.status, r.function, r.line, r.cc) for r in rows) == expected and len(rows) > 100


def test_too_deep_documents_are_limited(spark):
    deep = {"_kind": "Lit"}
    for _ in range(documents.MAX_LEVELS + 5):
        deep = {"_kind": "WhileClause", "Do": [deep]}
    text = json.dumps({"_kind": "FuncDecl", "Name": {"Value": "f"}, "Pos": {"Line": 1}, "Body": deep})
    (row,) = documents.shell_decisions(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.status == "limited" and row.function == "f"


def test_documents_are_walked_without_a_shuffle(spark):
    from tidemark.plans.registry import QUERIES

    plan = QUERIES["q_shell_decisions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "UnionLoop" not in plan


def test_names_lines_and_conditions_of_other_types(spark):
    inner = {"_kind": "FuncDecl", "Name": {"Value": "in"}, "Pos": {"Line": "7"}, "Body": {"_kind": 5, "X": {"_kind": "IfClause", "Cond": 0}, "Y": {"_kind": "IfClause", "Cond": "0"}}}
    cases = [({"_kind": "FuncDecl", "Name": {"Value": 7}, "Pos": {"Line": 2.5}, "B": inner}, {("7", 2, 1), ("7.in", 7, 2)}), ({"_kind": "FuncDecl", "B": [inner]}, {(None, None, 1), ("in", 7, 2)}), ({"_kind": "FuncDecl", "Name": {"Value": True}}, {("true", None, 1)})]
    rows = documents.shell_decisions(spark.createDataFrame([(k, json.dumps(d)) for k, (d, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.function, r.line, r.cc) for r in rows} == {(k, *f) for k, (_, fs) in enumerate(cases) for f in fs}
