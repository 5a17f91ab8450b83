"""Inventory, content classes, Unicode controls, Python sources, trees, sinks and the streaming extension."""

import random
import subprocess
import unicodedata

import pytest

from tidemark import schema
from tidemark.operators import assessment, inventory, python_code, sinks, text_rules
from tidemark.sources.trees import blob_oid, tree
from tidemark.streaming.assessments import follow


@pytest.mark.parametrize(
    ("path", "content", "expected"),
    [
        ("asset.jar", b"PK\x03\x04\x00\xff", "binary-asset"), ("asset.png", b"\x89PNG\r\n\x1a\n\x00", "binary-asset"), ("code.py", b"PK\x03\x04\x00\xff", "possible-source"),
        ("asset.jar", b"password = source_is_still_text", "text"), ("asset.dat", b"\x00\xff", "possible-source"), ("readme.md", b"bad\xff", "possible-source"), ("empty", b"", "text"),
    ],
)
def test_content_decides_the_class(spark, path, content, expected):
    rows = spark.createDataFrame([(path, bytearray(content))], "relative_path string, content binary")
    assert rows.select(inventory.classified().alias("c")).first().c == expected


def test_paths_say_language_and_test(spark):
    paths = {"Contest.java": ("java", False), "FeatureTest.java": ("java", True), "widget.test.ts": ("typescript", True), "a/tests/x.py": ("python", True), "v.blade.php": ("php-blade", False), "noext": ("", False)}
    rows = inventory.inventoried(spark.createDataFrame([(p, 1, "") for p in paths], "relative_path string, size_bytes bigint, content string"))
    assert {r.relative_path: (r.language, r.is_test) for r in rows.collect()} == paths


def test_selection_is_literal(spark):
    files = spark.createDataFrame([("src/a",), ("src2/a",), ("srcx",), ("src",)], "relative_path string")
    changed = spark.createDataFrame([("src/a",), ("src2/a",)], "path string")
    assert sorted(r.relative_path for r in inventory.selection(files, ["src"]).collect()) == ["src", "src/a"]
    assert [r.relative_path for r in inventory.selection(files, ["src"], changed).collect()] == ["src/a"]


def test_greedy_folds_follow_plain_models(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 60) for _ in range(200)]
    files = spark.createDataFrame([(i % 3, f"f{i:04d}", s) for i, s in enumerate(sizes)], "snapshot long, relative_path string, size_bytes long")
    taken = {r.relative_path: r.selected for r in inventory.greedy_budget(files, 1000).collect()}
    batches = {r.relative_path: r.batch for r in inventory.batch_packing(files, 4, 90).collect()}
    for k in range(3):
        used = 0
        batch, held, size = 0, 0, 0
        for i in range(k, 200, 3):
            assert taken[f"f{i:04d}"] == (used + sizes[i] <= 1000)
            used += sizes[i] if used + sizes[i] <= 1000 else 0
            if held and (held >= 4 or size + sizes[i] > 90):
                batch, held, size = batch + 1, 0, 0
            held, size = held + 1, size + sizes[i]
            assert batches[f"f{i:04d}"] == batch


def test_unicode_controls_agree_with_every_position(spark):
    rng = random.Random(47)
    odd = "\u00ad\u061c\u200b\u200c\u200d\u202a\u202e\u2060\u2066\ufeff\ufe0f\U000e0041\U000e0100\U0001f600\u0905\u2764\n ab\u00e9"
    texts = ["".join(rng.choice(odd) for _ in range(60)) for _ in range(60)]
    found = text_rules.unicode_controls(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(r.doc_id, r.line, r.col): r.rule for r in found.collect()}
    expected = {}
    for d, t in enumerate(texts):
        line = col = 1
        for i, c in enumerate(t):
            near = [x for x in (t[i - 1] if i else "", t[i + 1 : i + 2]) if x]
            emoji = all(ord(x) >= 0x1F000 or x in "\ufe0f\u2764" for x in near)
            letters = all(ord(x) > 127 and unicodedata.category(x)[0] in "LM" for x in near)
            rule = None
            if c in "\u061c\u202a\u202e\u2066":
                rule = "bidi-control"
            elif c == "\u00ad":
                rule = "soft-hyphen"
            elif c in "\u200b\u2060":
                rule = "invisible-control"
            elif c == "\U000e0041" and not any(0x1F000 <= ord(x) < 0xE0000 for x in t[max(0, i - 12) : i]):
                rule = "unexpected-tag"
            elif c in "\u200c\u200d" and not (len(near) == 2 and (emoji or letters)):
                rule = "unexpected-joiner"
            elif c == "\ufeff" and i:
                rule = "misplaced-bom"
            elif c in "\ufe0f\U000e0100" and (i == 0 or ord(t[i - 1]) < 128):
                rule = "unexpected-variation-selector"
            if rule:
                expected[d, line, col] = "unicode." + rule
            line, col = (line + 1, 1) if c == "\n" else (line, col + 1)
    assert got == expected


@pytest.mark.parametrize(
    "source,expected",
    [
        ("from builtins import eval as inspect\ninspect('x')\n", [("python.eval", "high", 2, "builtins.eval")]),
        ("import subprocess as task\ndef local(task):\n    task.run('x')\ntask.run(['echo'], shell=False)\n", [("python.process-call", "info", 4, "subprocess.run")]),
        ("class Owner:\n    eval = lambda value: value\n    def run(self):\n        return eval('x')\n", [("python.eval", "high", 4, "eval")]),
        ("def run(value=eval('x')):\n    return value\n", [("python.eval", "high", 1, "eval")]),
        ("values = {eval: eval('x') for eval in callbacks}\neval('x')\n", [("python.eval", "high", 2, "eval")]),
        ("import subprocess\nsubprocess.getoutput('x')\ncompile('x', 'f', 'eval')\n", [("python.shell-execution", "high", 2, "subprocess.getoutput"), ("python.dynamic-compile", "info", 3, "compile")]),
        ("import os\nos.system('x')\nimport subprocess\nsubprocess.run('x', shell=flag)\n", [("python.shell-execution", "high", 2, "os.system"), ("python.shell-execution", "high", 4, "subprocess.run")]),
    ],
)
def test_python_calls_are_lexical(spark, source, expected):
    files = spark.createDataFrame([("sample.py", source), ("bad.py", "def syntax(")], "relative_path string, content string")
    rows = python_code.python_calls(files).orderBy("line").collect()
    assert [(r.rule, r.severity, r.line, r.symbol) for r in rows if r.rule] == expected
    assert [r.status for r in rows if r.relative_path == "bad.py"] == ["unavailable"]


def test_decision_complexity(spark):
    nested = "def outer(x):\n    if x:\n        return 1\n    def inner(y):\n        if y:\n            return 2\n        return 3\n    return inner(x)\n"
    mixed = "def choose(x):\n    if x and x > 1:\n        return [y for y in x if y]\n    try:\n        return 1 if x else 0\n    except ValueError:\n        return 3\n"
    assert [c for _, _, c in python_code.complexities_of(nested)] == [2, 2]
    assert [c for _, _, c in python_code.complexities_of(mixed)] == [7]
    rows = python_code.commit_rows(spark.createDataFrame([("c1", "a.py", nested), ("c1", "b.py", mixed), ("c2", "a.py", "x = 1\n")], "commit_id string, relative_path string, content string"))
    assert {r.commit_id: (r.files, r.functions, r.max_cc) for r in rows.collect()} == {"c1": (2, 3, 7), "c2": (1, 0, 0)}


def test_trees_of_a_folder_and_of_a_commit_agree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, body in (("src/a.py", "a = 1\n"), ("b.txt", "b\n" * 3), ("empty", "")):
        (tmp_path / name).write_text(body)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    here = {(r.relative_path, r.oid, bytes(r.content)) for r in tree(spark, str(tmp_path)).collect()}
    there = {(r.relative_path, r.oid, bytes(r.content)) for r in tree(spark, str(tmp_path), "HEAD").collect()}
    assert here == there and len(here) == 3
    rows = tree(spark, str(tmp_path)).select("oid", inventory.blob_oid().alias("native"), "content").collect()
    assert all(r.oid == r.native == blob_oid(bytes(r.content)) for r in rows)


def test_receipts_and_reports(spark):
    stages = spark.createDataFrame([("s|1", "lint", "lint", "ok", True, "t", "1", "", "all", 1, 1, 0.0, *[None] * 8)], schema.STAGES)
    found = spark.createDataFrame([], schema.FINDINGS)
    done = assessment.assess(stages, found)
    assert '"schema_version":"1.2.0"' in sinks.receipts(done, stages, found).first().document
    assert sinks.report_lines(done, as_markdown=True).first().line.startswith("| s\\|1 | A | 100.00 |")


def test_assessments_follow_arriving_stages(spark, tmp_path):
    found = spark.createDataFrame([], schema.FINDINGS)
    row = lambda stage: spark.createDataFrame([("s", stage, "lint", "ok", True, "t", "1", "", "all", 1, 1, 0.0, *[None] * 8)], schema.STAGES)
    for k, stage in enumerate(("lint.1", "lint.2")):
        row(stage).write.mode("append").parquet(str(tmp_path / "in"))
        query = follow(spark.readStream.schema(schema.STAGES).parquet(str(tmp_path / "in")), found, str(tmp_path / "evidence"), str(tmp_path / "results"), str(tmp_path / "checkpoint"))
        query.awaitTermination(60)
        last = spark.read.parquet(str(tmp_path / "results")).where(f"batch = {k}").first()
        assert (last.required_stages, last.score) == (k + 1, 100.0)
