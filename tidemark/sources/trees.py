"""Source trees as tables: a working folder, and a commit of a Git repository, by Python data sources.

The driver lists names and sizes only, under bounds that hold for the whole tree, and cuts the list in order of paths into
ranges of about equal bytes, whatever the folders: one deep folder is as many tasks as its bytes ask for. A task reads its
range's files, or its blobs by cat-file calls of bounded size. Folders out of scope are not entered. A log of commits and
the patch between two commits are read the same way.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import normalized_paths
from ..operators.changes import changed_lines
from ..schema import EXCLUDED_DIRECTORIES
from . import git

EXCLUDED = frozenset(EXCLUDED_DIRECTORIES)
SCHEMA = "relative_path string, mode string, oid string, size_bytes bigint, content binary, reason string"
LOG_SCHEMA = "seq bigint, commit_id string, committed bigint"
MAX_FILE_BYTES, MAX_PATCH_BYTES = 8 << 20, 16 << 20
MAX_ENTRIES, MAX_FILES, MAX_DEPTH = 100_000, 20_000, 64
#: Bytes of a range, and what opening a file counts for.
RANGE_BYTES, OPEN_BYTES = 8 << 20, 4 << 10


def blob_oid(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


Entry = tuple[str, str, str, int]  # path, mode, object id, size


@dataclass
class Range(InputPartition):
    rows: list[Entry]


def planned(rows: list[Entry], range_bytes: int) -> list[list[Entry]]:
    """Ranges of consecutive paths that hold about range_bytes each; what a file is read of counts, not its whole size."""
    ranges, held = [[]], 0
    for r in rows:
        weight = min(r[3], MAX_FILE_BYTES) + OPEN_BYTES
        if ranges[-1] and held + weight > range_bytes:
            ranges.append([])
            held = 0
        ranges[-1].append(r)
        held += weight
    return ranges


def included(path: str, prefixes: list[str]) -> bool:
    return not prefixes or any(path == p or path.startswith(p + "/") for p in prefixes)


@dataclass
class Listing:
    """The entries to read, how many the tree has, and how many of them are selected."""

    rows: list[Entry]
    total: int
    selected: int


def entries(path: str, commit: str, prefixes: list[str]) -> Listing:
    """Of a commit. Links are kept whether selected or not, as they say where others lead."""
    rows, total, selected = [], 0, 0
    for entry in git.output(path, "ls-tree", "-r", "-z", "-l", commit).decode("utf-8", "surrogateescape").split("\0")[:-1]:
        facts, name = entry.split("\t", 1)
        mode, kind, oid, size = facts.split()
        if kind != "blob" or mode not in ("100644", "100755", "120000"):
            raise RuntimeError(f"entry that isn't a file: {mode} {kind}")
        total += 1
        if total > MAX_ENTRIES:
            raise RuntimeError(f"the tree has more than {MAX_ENTRIES} entries")
        chosen = included(name, prefixes)
        selected += chosen
        if chosen or mode == "120000":
            rows.append((name, mode, oid, int(size)))
    return Listing(rows, total, selected)


def listed(path: str, prefixes: list[str]) -> Listing:
    """Of a working folder; links are not followed, and the repository's own folder isn't part of it."""
    rows, total, seen, todo = [], 0, 0, [("", 0)]
    while todo:
        here, depth = todo.pop()
        if depth > MAX_DEPTH:
            raise RuntimeError(f"the folder has more than {MAX_DEPTH} levels")
        with os.scandir(os.path.join(path, here)) as found:
            for e in found:
                name = f"{here}/{e.name}" if here else e.name
                seen += 1
                if seen > MAX_ENTRIES:
                    raise RuntimeError(f"the folder has more than {MAX_ENTRIES} entries")
                if e.is_dir(follow_symlinks=False):
                    if e.name not in EXCLUDED_DIRECTORIES:
                        todo.append((name, depth + 1))
                elif e.name != ".git":
                    info = e.stat(follow_symlinks=False)
                    rows.append((name, "120000" if e.is_symlink() else "100755" if info.st_mode & 0o100 else "100644", "", info.st_size))
                    total += 1
    rows = [r for r in rows if included(r[0], prefixes)]
    return Listing(rows, total, len(rows))


class TreeReader(DataSourceReader):
    def __init__(self, path: str, commit: str, with_content: bool, prefixes: list[str], range_bytes: int):
        self.path, self.with_content, self.prefixes, self.range_bytes = path, with_content, prefixes, range_bytes
        self.commit = git.revision(path, commit) if commit else ""

    def listing(self) -> Listing:
        found = entries(self.path, self.commit, self.prefixes) if self.commit else listed(self.path, self.prefixes)
        if found.selected > MAX_FILES:
            raise RuntimeError(f"the tree has {found.selected} selected files, of which {MAX_FILES} may be read")
        return found

    def partitions(self) -> list[Range]:
        rows = [r for r in self.listing().rows if not EXCLUDED.intersection(r[0].split("/")[:-1])]
        return [Range(r) for r in planned(sorted(rows), self.range_bytes)]

    def read(self, partition: Range):
        bodies = self.blobs(partition.rows) if self.commit else (self.file(r) for r in partition.rows)
        for (path, mode, oid, size), (content, reason) in zip(partition.rows, bodies):
            yield path, mode, oid or (blob_oid(content) if content is not None else None), size, content if self.with_content else None, reason

    def file(self, row: Entry) -> tuple[bytes | None, str]:
        """One file, if it is regular, small, and the same before and after it is read."""
        full = os.path.join(self.path, row[0])
        if row[1] == "120000":
            return os.readlink(full).encode("utf-8", "surrogateescape"), "Symbolic link not followed"
        if row[3] > MAX_FILE_BYTES:
            return None, "Content exceeds per-file text acquisition budget"
        before = os.stat(full)
        with open(full, "rb") as f:
            content = f.read(MAX_FILE_BYTES + 1)
        after = os.stat(full)
        if (before.st_mtime_ns, before.st_size) != (after.st_mtime_ns, after.st_size) or len(content) != after.st_size:
            return None, "Content identity unavailable: read budget exhausted or file changed"
        return content, ""

    def blobs(self, rows: list[Entry]):
        for run in git.batches(rows, lambda r: min(r[3], MAX_FILE_BYTES)):
            wanted = [r for r in run if r[3] <= MAX_FILE_BYTES]
            found = dict(zip([r[0] for r in wanted], git.blobs(self.path, [(r[2], r[3]) for r in wanted])))
            for r in run:
                yield (found[r[0]], "") if r[0] in found else (None, "Content exceeds per-file text acquisition budget")


class SourceTree(DataSource):
    """Format "tidemark_tree". Options: path; commit ("": the working folder); content ("false": names and ids only);
    selected (lines of paths, which are literal; none: all); range (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        o = self.options
        return TreeReader(o["path"], o.get("commit", ""), o.get("content", "true") != "false", [p for p in o.get("selected", "").split("\n") if p], int(o.get("range", RANGE_BYTES)))


def tree(spark: SparkSession, path: str, commit: str = "", content: bool = True, paths: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(SourceTree)
    rows = spark.read.format("tidemark_tree").option("commit", commit).option("content", str(content).lower())
    return rows.option("selected", "\n".join(normalized_paths(paths or []))).option("range", range_bytes).load(path)


def tree_counts(path: str, commit: str = "", paths: list[str] | None = None) -> tuple[int, int]:
    """Entries of the whole tree, and those of them that are selected."""
    found = TreeReader(path, commit, False, normalized_paths(paths or []), RANGE_BYTES).listing()
    return found.total, found.selected


class LogReader(DataSourceReader):
    def __init__(self, path: str, anchor: str, limit: int):
        self.path, self.anchor, self.limit = path, git.revision(path, anchor), limit

    def read(self, partition):
        lines = git.output(self.path, "log", "--first-parent", f"--max-count={self.limit}", "--format=%H %ct", self.anchor, "--").decode().split("\n")
        for seq, line in enumerate(reversed([x for x in lines if x])):
            commit, when = line.split()
            if not git.OBJECT_ID.fullmatch(commit):
                raise RuntimeError("not a commit id")
            yield seq, commit, int(when)


class CommitLog(DataSource):
    """Format "tidemark_log": first-parent commits from the oldest on. Options: path, anchor, limit."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"], self.options.get("anchor", "HEAD"), int(self.options.get("limit", "10")))


def log(spark: SparkSession, path: str, anchor: str = "HEAD", limit: int = 10) -> DataFrame:
    spark.dataSource.register(CommitLog)
    return spark.read.format("tidemark_log").option("anchor", anchor).option("limit", limit).load(path)


def comparison(spark: SparkSession, path: str, base: str, head: str, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides' files (side, and the columns of a tree), and the changed lines between them (side, path, start_line,
    end_line), of the selected paths. A patch that is too large gives no changed lines but one row with a null path: the
    map is unknown."""
    base, head = git.revision(path, base), git.revision(path, head)
    sides = [tree(spark, path, commit, paths=paths).selectExpr(f"'{side}' as side", "*") for side, commit in (("base", base), ("head", head))]
    options = ["--no-color", "--no-ext-diff", "--no-textconv", "--no-renames", "--patch", "--unified=0"]
    try:
        patch = git.output(path, "diff", *options, base, head, "--", *(f":(literal){p}" for p in normalized_paths(paths or [])), most=MAX_PATCH_BYTES).decode("utf-8", "replace")
    except git.TooLarge:
        patch = None
    return sides[0].unionByName(sides[1]), changed_lines(spark.createDataFrame([("", patch)], "snapshot_id string, patch string")).drop("snapshot_id")
