"""Python complexity over a repository's commits, each distinct blob read and measured once.

Most files of a commit are those of the commit before, so the entries of all commits are joined to their distinct blobs:
tasks list a commit's tree, Spark drops repeated object ids, tasks read the blobs in calls of bounded size and measure them,
and the measures are joined back to (commit, path) by object id. What can't be read or parsed is a row that says so; it
makes the commit, and the stage, failed, never the job.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.locations import production_python
from ..operators.python_code import complexities_of
from . import git
from .trees import MAX_FILE_BYTES, MAX_FILES, log

MAX_COMMITS, MAX_COMMIT_BYTES = 50, 256 << 20
MEASURE = "python-ast-decision-complexity-v1"
# What the stage says.
TOO_LARGE_FILE = "History Python source exceeds the 8 MiB file budget"
TOO_LARGE_COMMIT = "History commit exceeds the 20,000-file/256 MiB source budget"
INVALID = "Git history or Python object analysis failed validation"
SHALLOW = "Shallow history exposes only the available commit window"
SINGLE = "One commit provides no trend comparison"
OTHER_ROOT = "History repository root differs from the selected source"
NO_COMMITS = "Git repository has no committed history"
BAD_LIMIT = "History limit must be between 1 and 50"
BAD_REVISION = "History revision must be a full immutable commit ID"


def commit_entries(commits: DataFrame, path: str) -> DataFrame:
    """commit_id, relative_path, oid, size_bytes of every regular file in each commit, listed by tasks."""

    def listed(frames):
        for f in frames:
            rows = []
            for commit in f["commit_id"]:
                for entry in git.output(path, "ls-tree", "-r", "-z", "-l", commit).decode("utf-8", "surrogateescape").split("\0")[:-1]:
                    facts, name = entry.split("\t", 1)
                    mode, kind, oid, size = facts.split()
                    if kind == "blob" and mode in ("100644", "100755"):
                        rows.append((commit, name.encode("utf-8", "replace").decode(), oid, int(size)))
            yield pd.DataFrame(rows, columns=["commit_id", "relative_path", "oid", "size_bytes"])

    return commits.select("commit_id").repartition("commit_id").mapInPandas(listed, "commit_id string, relative_path string, oid string, size_bytes long")


def measured_blobs(entries: DataFrame, path: str) -> DataFrame:
    """oid, functions, total_cc, max_cc, failed, call of each distinct blob; call numbers a task's cat-file calls."""

    def read(frames):
        rows = (r for f in frames for r in zip(f["oid"], f["size_bytes"]))
        for call, run in enumerate(git.batches(rows, lambda r: int(r[1]))):
            out = []
            for (oid, _), content in zip(run, git.blobs(path, [(o, int(n)) for o, n in run])):
                try:
                    cc = [c for _, _, c in complexities_of(content.decode("utf-8"))]
                    out.append((oid, len(cc), sum(cc), max(cc, default=0), False, call))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    out.append((oid, 0, 0, 0, True, call))
            yield pd.DataFrame(out, columns=["oid", "functions", "total_cc", "max_cc", "failed", "call"])

    return entries.select("oid", "size_bytes").distinct().repartition("oid").mapInPandas(read, "oid string, functions long, total_cc long, max_cc long, failed boolean, call long")


def history_rows(spark: SparkSession, path: str, anchor: str = "HEAD", limit: int = 10) -> DataFrame:
    """One row for each first-parent commit, from the oldest on: seq, commit_id, committed, files, functions, average_cc,
    max_cc of its production Python files, and reason, which says why a commit has no measures."""
    commits = log(spark, path, anchor, limit)
    entries = commit_entries(commits, path).where(production_python("relative_path"))
    size = entries.groupBy("commit_id").agg(
        F.when(F.max("size_bytes") > MAX_FILE_BYTES, TOO_LARGE_FILE).when((F.count("*") > MAX_FILES) | (F.sum("size_bytes") > MAX_COMMIT_BYTES), TOO_LARGE_COMMIT).alias("too_large")
    )
    readable = entries.join(size.where("too_large IS NULL").select("commit_id"), "commit_id")
    found = readable.join(measured_blobs(readable, path), "oid", "left").groupBy("commit_id").agg(
        F.count("*").alias("files"), F.sum("functions").alias("functions"), F.sum("total_cc").alias("total_cc"), F.max("max_cc").alias("max_cc"),
        F.bool_or(F.coalesce("failed", F.lit(True))).alias("failed"),
    )
    none = lambda c: F.coalesce(c, F.lit(0))
    reason = F.coalesce("too_large", F.when(F.col("failed"), INVALID), F.lit(""))
    measured = lambda c: F.when(reason == "", c)
    return commits.join(size, "commit_id", "left").join(found, "commit_id", "left").select(
        "seq", "commit_id", "committed", measured(none("files")).alias("files"), measured(none("functions")).alias("functions"),
        measured(F.when(none("functions") > 0, F.col("total_cc") / F.col("functions")).otherwise(0.0)).alias("average_cc"), measured(none("max_cc")).alias("max_cc"), reason.alias("reason"),
    )


def own_root(path: str) -> bool:
    """Whether the folder is a repository itself; one around it isn't borrowed."""
    inside = git.output(path, "rev-parse", "--is-inside-work-tree").strip() == b"true"
    root = git.output(path, "rev-parse", "--show-toplevel" if inside else "--absolute-git-dir").decode().rstrip("\n")
    return os.path.realpath(root) == os.path.realpath(path)


def history(spark: SparkSession, path: str, revision: str | None = None, limit: int = 10) -> tuple[dict, list]:
    """The stage `history.git` and its rows (at most MAX_COMMITS). A request that can't be met, and history that can't be
    read, are a stage that says so."""

    def stage(status: str, reason: str, rows=()):
        metrics = {"commit_count": len(rows), "limit": limit, "measure": MEASURE, "order": "oldest-first", "traversal": "first-parent"}
        done = {"analyzed_files": rows[-1].files, "eligible_files": rows[-1].files} if rows else {"analyzed_files": None, "eligible_files": None}
        return {"stage_id": "history.git", "category": "history", "status": status, "reason": reason, "required": False, "tool": "git", "metrics": metrics} | done, list(rows)

    if not (isinstance(limit, int) and not isinstance(limit, bool) and 1 <= limit <= MAX_COMMITS):
        return stage("failed", BAD_LIMIT)
    if revision is not None and not git.OBJECT_ID.fullmatch(revision):
        return stage("failed", BAD_REVISION)
    try:
        shallow = git.output(path, "rev-parse", "--is-shallow-repository").strip() == b"true"
    except FileNotFoundError:
        return stage("missing", "Git is not installed")
    except RuntimeError:
        return stage("unsupported", OTHER_ROOT)
    if not own_root(path):
        return stage("unsupported", OTHER_ROOT)
    try:
        anchor = git.revision(path, revision or "HEAD")
    except RuntimeError:
        return stage("unsupported", NO_COMMITS) if revision is None else stage("failed", INVALID)
    rows = history_rows(spark, path, anchor, limit).orderBy("seq").collect()  # at most MAX_COMMITS
    if reasons := [r.reason for r in rows if r.reason]:
        large = [r for r in reasons if r != INVALID]
        return stage("limited", large[0]) if large and len(large) == len(reasons) else stage("failed", INVALID)
    return stage("limited", SHALLOW, rows) if shallow else stage("limited", SINGLE, rows) if len(rows) == 1 else stage("ok", "", rows)
