"""Trees in ranges of about equal bytes, revisions that can't be options, and history whose blobs are read once."""

import subprocess

import pytest

from tidemark.operators.python_code import complexities_of
from tidemark.sources import git, history, trees

CODE = "def f{k}(x):\n    if x and {k}:\n        return [y for y in x if y]\n    return {k}\n"


def run(path, *args):
    who = ["-c", "user.name=t", "-c", "user.email=t@t", "-c", "commit.gpgsign=false"]
    return subprocess.run(["git", "-C", str(path), *who, *args], check=True, capture_output=True).stdout.decode()


def commit(path, message, **files):
    for name, body in files.items():
        target = path / name.replace("__", "/")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body) if body is not None else target.unlink()
    run(path, "add", "-A")
    run(path, "commit", "-qm", message, "--allow-empty")


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    run(path, "init", "-q", "-b", "main")
    # 150 files of which pairs are equal, so more than one call of 64 blobs is needed
    commit(path, "one", **{f"src__deep__er__m{k}.py": CODE.format(k=k // 2) for k in range(150)}, **{"tests__x.py": "def t(): pass\n", "test_y.py": "x = 1\n", "README.md": "x\n"})
    commit(path, "two", **{"src__deep__er__m0.py": CODE.format(k=900), "src__extra.py": "def g():\n    return 1\n"})
    commit(path, "three", **{"src__extra.py": None})
    run(path, "checkout", "-q", "-b", "side", "HEAD~1")
    commit(path, "side", side=CODE.format(k=1))
    run(path, "checkout", "-q", "main")
    run(path, "merge", "-q", "--no-ff", "-m", "merge", "side")
    return path


def direct(path, anchor="HEAD"):
    """Each commit measured by itself."""
    out = []
    for line in reversed(run(path, "log", "--first-parent", "--format=%H", anchor).split()):
        names = [n for n in run(path, "ls-tree", "-r", "--name-only", line).split("\n") if n.endswith(".py") and "tests/" not in n and not n.startswith("test_")]
        cc = [c for n in names for _, _, c in complexities_of(run(path, "show", f"{line}:{n}"))]
        out.append((line, len(names), len(cc), sum(cc) / len(cc) if cc else 0.0, max(cc, default=0)))
    return out


def test_history_equals_each_commit_s_own_measure(spark, repository):
    stage, rows = history.history(spark, str(repository))
    assert (stage["status"], stage["reason"], stage["metrics"]["commit_count"]) == ("ok", "", 4)
    assert [(r.commit_id, r.files, r.functions, r.average_cc, r.max_cc) for r in rows] == direct(repository)
    assert stage["analyzed_files"] == rows[-1].files


def test_each_distinct_blob_is_read_once_in_bounded_calls(spark, repository):
    entries = history.commit_entries(trees.log(spark, str(repository)), str(repository)).where(history.production_python("relative_path"))
    read = history.measured_blobs(entries, str(repository)).collect()
    distinct = {r.oid for r in entries.collect()}
    assert entries.count() > 550 and len(read) == len(distinct) == 77 and {r.oid for r in read} == distinct
    assert [len(r) for r in git.batches([(0, 1)] * 150, lambda r: r[1])] == [64, 64, 22]
    assert [len(r) for r in git.batches([(0, 600_000)] * 3 + [(0, 5 << 20), (0, 1)], lambda r: r[1])] == [1, 1, 1, 1, 1]


def test_history_that_can_t_be_measured_is_a_stage(spark, repository, tmp_path):
    h = lambda *a, **k: (lambda s: (s[0]["status"], s[0]["reason"]))(history.history(spark, *a, **k))
    assert h(str(repository), limit=0) == ("failed", history.BAD_LIMIT) and h(str(repository), limit=51) == ("failed", history.BAD_LIMIT)
    assert h(str(repository), "--output=/tmp/x") == ("failed", history.BAD_REVISION) and h(str(repository), "0" * 40) == ("failed", history.INVALID)
    assert h(str(repository), limit=1) == ("limited", history.SINGLE)
    assert h(str(repository / "src"))[0] == "unsupported" and h(str(tmp_path))[0] == "unsupported"
    run(tmp_path, "init", "-q")
    assert h(str(tmp_path)) == ("unsupported", history.NO_COMMITS)
    commit(tmp_path, "one", **{"a.py": "x = 1\n"})
    commit(tmp_path, "two", **{"b.py": "def broken(:\n"})
    assert h(str(tmp_path)) == ("failed", history.INVALID)
    rows = history.history_rows(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.files, r.max_cc, r.reason) for r in rows] == [(1, 0, ""), (None, None, history.INVALID)]
    shallow = tmp_path / "shallow"
    subprocess.run(["git", "clone", "-q", "--depth", "2", "file://" + str(repository), str(shallow)], check=True, capture_output=True)
    assert h(str(shallow)) == ("limited", history.SHALLOW)


def test_one_deep_folder_is_several_ranges_of_equal_bytes(spark, repository):
    reader = trees.TreeReader(str(repository), "HEAD", True, [], 64 << 10)
    ranges = reader.partitions()
    weights = [sum(r[3] + trees.OPEN_BYTES for r in p.rows) for p in ranges]
    assert len(ranges) > 8 and max(weights) <= 64 << 10 and min(weights[:-1]) > 56 << 10
    assert [r[0] for p in ranges for r in p.rows] == sorted(r[0] for p in ranges for r in p.rows)
    df = trees.tree(spark, str(repository), "HEAD", range_bytes=64 << 10)
    assert df.rdd.getNumPartitions() == len(ranges)
    here = {(r.relative_path, r.oid, bytes(r.content)) for r in trees.tree(spark, str(repository), range_bytes=64 << 10).collect()}
    assert here == {(r.relative_path, r.oid, bytes(r.content)) for r in df.collect()} and len(here) == 154


def test_a_large_file_is_a_range_of_its_own():
    rows = [("a", "", "", 10), ("b", "", "", 50 << 20), ("c", "", "", 0), ("d", "", "", 1 << 20)]
    assert [[r[0] for r in p] for p in trees.planned(rows, 2 << 20)] == [["a"], ["b"], ["c", "d"]]
    assert trees.planned([], 5) == [[]]


def test_bounds_hold_for_the_whole_tree_and_selection_is_counted(spark, repository, monkeypatch):
    assert trees.tree_counts(str(repository), "HEAD") == trees.tree_counts(str(repository)) == (154, 154)
    assert trees.tree_counts(str(repository), "HEAD", ["src", "README.md"]) == trees.tree_counts(str(repository), "", ["src", "README.md"]) == (154, 151)
    assert {r.relative_path for r in trees.tree(spark, str(repository), "HEAD", paths=["tests", "READ"]).collect()} == {"tests/x.py"}
    for name, most in (("MAX_ENTRIES", 100), ("MAX_FILES", 100)):
        with monkeypatch.context() as m:
            m.setattr(trees, name, most)
            for at in ("HEAD", ""):
                with pytest.raises(RuntimeError):
                    trees.TreeReader(str(repository), at, True, [], 1 << 20).partitions()
    with monkeypatch.context() as m:
        m.setattr(trees, "MAX_DEPTH", 2)
        with pytest.raises(RuntimeError):
            trees.TreeReader(str(repository), "", True, [], 1 << 20).partitions()


def test_revisions_are_never_options_and_reading_is_bounded(spark, repository, tmp_path, monkeypatch):
    target = tmp_path / "written"
    for bad in (f"--output={target}", "-h", "main:README.md", "nothing"):
        with pytest.raises(RuntimeError):
            git.revision(str(repository), bad)
        with pytest.raises(RuntimeError):
            trees.comparison(spark, str(repository), bad, "HEAD")
    assert not target.exists()
    with pytest.raises(git.TooLarge):
        git.output(str(repository), "ls-tree", "-r", "HEAD", most=100)
    monkeypatch.setattr(trees, "MAX_PATCH_BYTES", 50)
    _, lines = trees.comparison(spark, str(repository), "HEAD~2", "HEAD")
    assert {(r.side, r.path) for r in lines.collect()} <= {("base", None), ("head", None), (None, None)}
    monkeypatch.undo()
    _, lines = trees.comparison(spark, str(repository), "HEAD~3", "HEAD", ["src/deep"])
    assert {r.path for r in lines.collect()} == {"src/deep/er/m0.py"}
