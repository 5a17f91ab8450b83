"""Places in sources: columns in other units, compiler diagnostics, and declarations that a tool left out."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def utf16_column(before: Column) -> Column:
    """1-based column in UTF-16 units, from the text before it in its line: characters beyond U+FFFF are two."""
    return F.length(before) + F.length(F.regexp_replace(before, r"[^\x{10000}-\x{10FFFF}]", "")) + 1


def byte_column(before: Column) -> Column:
    """1-based column in UTF-8 bytes."""
    return F.octet_length(before) + 1


def tab_column(before: Column) -> Column:
    """1-based column with tab stops every 8 columns."""
    step = lambda at, c: F.when(c == "\t", F.floor((at - 1) / 8) * 8 + 9).when(c.rlike(r"^[\x{10000}-\x{10FFFF}]$"), at + 2).when(c == "", at).otherwise(at + 1)
    return F.aggregate(F.split(before, ""), F.lit(1).cast("long"), lambda at, c: step(at, c).cast("long"))


def javac_diagnostics(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Raw diagnostics (text: path:line:column:rule...) tied to sources: by whole path, else by a base name that only one
    source has. Rows that fit neither have a null path."""
    pattern = r"^(.+):(\d+):(\d+):\s*(compiler\.(?:err|warn)\.[A-Za-z0-9.]+)"
    part = lambda k: F.regexp_extract("text", pattern, k)
    rows = lines.where(F.col("text").rlike(pattern)).select(part(1).alias("said"), part(2).cast("long").alias("line"), part(3).cast("long").alias("col"), part(4).alias("rule"))
    base = F.regexp_extract("relative_path", r"([^/]*)$", 1)
    one = files.select("relative_path", base.alias("name")).withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n = 1").select(F.col("relative_path").alias("by_name"), "name")
    whole = files.select(F.col("relative_path").alias("by_path"))
    tied = rows.join(whole, F.col("said") == F.col("by_path"), "left").join(one, F.col("said") == F.col("name"), "left")
    severity = F.when(F.col("rule").startswith("compiler.err."), "medium").otherwise("low")
    dependency = F.col("rule").isin("compiler.err.doesnt.exist", "compiler.err.cant.access")
    return tied.select(F.coalesce("by_path", "by_name").alias("path"), "line", "col", "rule", severity.alias("severity"), dependency.alias("dependency"))


def _declarations(source: str) -> list[tuple[str, int, bool]]:
    """(dotted name, line, whether the body is an ellipsis) of each function."""
    out = []

    def walk(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{child.name}" if owner else child.name
                if not isinstance(child, ast.ClassDef):
                    body = child.body[1:] if ast.get_docstring(child, clean=False) is not None else child.body
                    bare = len(body) == 1 and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and body[0].value.value is ...
                    out.append((name, child.lineno, bare))
                walk(child, name)
            else:
                walk(child, owner)

    walk(ast.parse(source), "")
    return out


def missing_declarations(files: DataFrame, observed: DataFrame) -> DataFrame:
    """J-10: declarations of files (relative_path, content) without a row in observed (path, line). An ellipsis body is a
    declaration of complexity 1; another body means that the tool's evidence is incomplete (reconciled is false)."""

    def run(frames):
        for f in frames:
            rows = [(p, *d) for p, c in zip(f["relative_path"], f["content"]) for d in _declarations(c)]
            yield pd.DataFrame(rows, columns=["path", "function", "line", "reconciled"])

    declared = files.select("relative_path", "content").mapInPandas(run, "path string, function string, line long, reconciled boolean")
    return declared.join(observed.select("path", "line").distinct(), ["path", "line"], "left_anti").withColumn("cc", F.lit(1))


def production_python(path: str = "path") -> Column:
    """P-12: Python files of the history measure, with its own list of ignored folders."""
    ignored = r"(^|/)(\.git|\.venv|venv|node_modules|vendor|dist|build|tests|test|testing|migrations)(/|$)"
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.col(path).endswith(".py") & ~F.col(path).rlike(ignored) & ~name.startswith("test_") & ~name.endswith("_test.py")
