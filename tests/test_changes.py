"""Comparison inputs: changed lines of a patch, both sides of a comparison, and the log."""

import subprocess

import pytest

from tidemark.operators.changes import changed_lines
from tidemark.sources import trees


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (path / "src").mkdir()
    (path / "edited.py").write_text("one\ntwo\n-- a/x.py\nfour\n")
    (path / "gone.py").write_text("a\nb\n")
    (path / "src/kept é.py").write_text("k\n")
    run("add", "-A")
    run("commit", "-qm", "first")
    (path / "edited.py").write_text("one\nTWO\n++ b/y.py\nfour\nfive\n")
    (path / "gone.py").unlink()
    (path / "src/kept é.py").write_text("k\nm\n")
    (path / "src/empty.py").write_text("")
    (path / "vendor").mkdir()
    (path / "vendor/v.py").write_text("v\n")
    run("add", "-A")
    run("commit", "-qm", "second")
    return str(path)


def test_a_comparison_has_both_sides_and_their_changed_lines(spark, repository):
    files, lines = trees.comparison(spark, repository, "HEAD~1", "HEAD")
    assert sorted((r.side, r.relative_path) for r in files.collect()) == [
        ("base", "edited.py"), ("base", "gone.py"), ("base", "src/kept é.py"), ("head", "edited.py"), ("head", "src/empty.py"), ("head", "src/kept é.py"),
    ]
    assert sorted((r.side, r.path, r.start_line, r.end_line) for r in lines.collect()) == [
        ("base", "edited.py", 2, 3), ("base", "gone.py", 1, 2), ("head", "edited.py", 2, 3), ("head", "edited.py", 5, 5), ("head", "src/kept é.py", 2, 2), ("head", "vendor/v.py", 1, 1),
    ]


def test_an_unknown_patch_is_not_an_empty_one(spark):
    rows = changed_lines(spark.createDataFrame([("big", None), ("none", "")], "snapshot_id string, patch string")).collect()
    assert sorted((r.snapshot_id, r.side, r.path) for r in rows) == [("big", "base", None), ("big", "head", None)]


def test_the_log_begins_with_the_oldest(spark, repository):
    rows = trees.log(spark, repository).orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1] and trees.log(spark, repository, limit=1).first().commit_id == rows[1].commit_id
