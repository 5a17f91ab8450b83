"""A whole check of two snapshots, from files to decisions."""

from tidemark.operators import stages
from tidemark.operators.assessment import assess


def test_a_check_keeps_missing_tools_visible(spark):
    token = "token = '" + "A1b2C3d4" * 3 + "'\n"
    rows = [
        ("one", "src/a.py", "eval('x')\n"), ("one", "tests/test_a.py", "pass\n"), ("one", "README.md", "word " * 40), ("one", "LICENSE", "free\n"), ("one", "node_modules/x.js", "eval(1)\n"),
        ("two", "index.php", "<?php echo 1;\n"), ("two", "notes.txt", token), ("two", "odd.txt", "a‮b\n"),
    ]
    files = spark.createDataFrame([(s, p, len(c), c) for s, p, c in rows], "snapshot_id string, relative_path string, size_bytes long, content string")
    made, found = stages.scan(files)
    status = {(r.snapshot_id, r.stage_id): r.status for r in made.collect()}
    assert status["one", "python.lint.ruff"] == "missing" and status["one", "security.execution"] == "ok"
    assert ("one", "python.health.pyscn") not in status and ("two", "security.execution") not in status
    assert status["two", "php.types.phpstan"] == "missing" and ("one", "javascript.lint.eslint") not in status
    seen = {(r.snapshot_id, r.stage_id, r.rule, r.path) for r in found.collect()}
    assert ("one", "security.execution", "python.eval", "src/a.py") in seen
    assert ("two", "security.unicode", "unicode.bidi-control", "odd.txt") in seen
    assert ("two", "security.secrets", "secret.credential-assignment", "notes.txt") in seen
    assert ("two", "hygiene", "hygiene.license_file", "") in seen and ("one", "hygiene", "hygiene.license_file", "") not in seen
    result = {r.snapshot_id: r for r in assess(made, found).collect()}
    assert result["one"].score is None and not result["one"].complete and result["two"].decision == "hold"
    full = {r.stage_id for r in stages.planned(files, "full").where("snapshot_id = 'one' and not omitted").collect()}
    assert {"python.health.pyscn", "python.duplication.pyscn", "complexity.lizard"} <= full


def test_calls_beside_hidden_text_a_selection_and_what_has_no_parser(spark):
    rows = [
        ("one", "src/a.py", "x = 1 # a‮b\neval('x')\n# ⁦\n"), ("one", "src/b.py", "eval('x')\n"), ("one", "src/c.rb", "x\n"), ("one", "src/d.js", "x\n"), ("one", "other/e.py", "def bad(:\n"),
        ("two", "notes.txt", "plain\n"), ("three", "src/f.py", "pass\n"),
    ]
    files = spark.createDataFrame([(s, p, len(c.encode()), c) for s, p, c in rows], "snapshot_id string, relative_path string, size_bytes long, content string")
    made, found = stages.scan(files)
    stage = {r.snapshot_id: r for r in made.where("stage_id = 'security.execution'").collect()}
    assert (stage["one"].status, stage["one"].analyzed_files, stage["one"].eligible_files) == ("limited", 2, 4)
    assert stage["one"].reason == "1 Python files could not be parsed; No call parser here for: javascript; Call parsing unsupported for: ruby"
    assert stage["two"].status == "skipped" and (stage["three"].status, stage["three"].reason) == ("ok", stages.OBSERVED)
    pairs = [(r.path, r.line, r.severity, r.message) for r in found.where("rule = 'security.obfuscated-execution'").collect()]
    assert pairs == [("src/a.py", 2, "high", "Execution call shares file with U+2066 at line 3; review both locations")]
    made, found = stages.scan(files, selected=["src/"])
    assert {(r.snapshot_id, r.status, r.reason) for r in made.where("stage_id = 'scope.selection'").collect()} == {("one", "limited", stages.PARTIAL), ("three", "limited", stages.PARTIAL)}
    assert {r.status for r in made.where("stage_id = 'security.execution' and snapshot_id = 'three'").collect()} == {"ok"} and not found.where("path = 'other/e.py'").count()


def test_small_rules_of_words(spark):
    import pytest

    from tidemark.functions.paths import normalized_paths
    from tidemark.operators import sinks

    assert normalized_paths(["src/", "a/b.py", "src"]) == ["a/b.py", "src"]
    for bad in ("", "/a", "-a", "a//b", "./a", "a/..", "a*", "a:b", "a\\b", "a\n", ".git/x", "a/.git", "[x]", "x" * 5000):
        with pytest.raises(ValueError):
            normalized_paths([bad])
    with pytest.raises(ValueError):
        normalized_paths([f"p{k}" for k in range(257)])
    rows = spark.createDataFrame([("working-tree", "abc", True, 25), ("working-tree", "abc", False, 20), ("working-tree", "", True, 0), ("commit", "abc", False, 21)], "mode string, commit_sha string, dirty boolean, n long")
    assert [tuple(r) for r in rows.select(sinks.revision_label(), sinks.truncation_note("n", 20, "findings")).collect()] == [
        ("working tree (dirty; HEAD anchor abc)", "Showing 20 of 25 findings; --format json includes every item."), ("working tree (clean; HEAD anchor abc)", ""),
        ("working tree (no Git commit)", ""), ("commit abc", "Showing 20 of 21 findings; --format json includes every item."),
    ]
    found = spark.createDataFrame([("java.unsafe-api",), ("java.long-method",), ("F401",)], "rule string")
    assert [r.rule for r in stages.java_execution(found).collect()] == ["java.unsafe-api"]
    assert found.where("rule = 'F401'").select(stages.withheld("Ruff")).first()[0] == "Ruff F401 diagnostic"
