"""Python sources as rows: calls that run code or processes, and decision complexity of functions.

Parsing needs Python's own parser, so files go through Arrow batches; each file gives flat rows, and a file that can't
be parsed gives one row that says so, never an error of the job.
"""

from __future__ import annotations

import ast
import symtable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a call of a name means. None: by the call's arguments.
CALLS = {
    "eval": ("python.eval", "high"), "builtins.eval": ("python.eval", "high"), "exec": ("python.exec", "high"), "builtins.exec": ("python.exec", "high"),
    "compile": ("python.dynamic-compile", "info"), "builtins.compile": ("python.dynamic-compile", "info"),
    "os.system": ("python.shell-execution", "high"), "os.popen": ("python.shell-execution", "high"),
    "subprocess.getoutput": ("python.shell-execution", "high"), "subprocess.getstatusoutput": ("python.shell-execution", "high"),
    "subprocess.run": None, "subprocess.call": None, "subprocess.Popen": None, "subprocess.check_call": None, "subprocess.check_output": None,
}
MAX_BYTES = 8 << 20


class Names:
    """What a name stands for in a lexical scope: Python's symbol tables say where it is bound, the import statements of
    that scope say to what. A name that is bound otherwise stands for nothing known."""

    def __init__(self, source: str, tree: ast.Module):
        self.tables: dict[int, list[symtable.SymbolTable]] = {}
        self.imported: dict[int, dict[str, str]] = {}
        self.pair(symtable.symtable(source, "source", "exec"), tree, [])

    def pair(self, table: symtable.SymbolTable, node: ast.AST, above: list[symtable.SymbolTable]) -> None:
        """Symbol tables follow the order of scopes in the tree."""
        chain = [*above, table]
        self.tables[id(node)] = chain
        names = self.imported.setdefault(id(table), {})
        left = [c for c in table.get_children() if c.get_type() not in ("annotation", "type parameters", "type parameter", "TypeVar bound")]
        todo: list[ast.AST] = list(own_parts(node))
        while todo:
            child = todo.pop(0)
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                source = f"{child.module}." if isinstance(child, ast.ImportFrom) else ""
                names.update((a.asname or a.name, source + a.name) for a in child.names)
            if isinstance(child, SCOPES):
                inner = next((c for c in left if c.get_lineno() == first_line(child) and c.get_name() == scope_name(child)), None)
                if inner is not None:
                    left.remove(inner)
                    self.pair(inner, child, chain)
                todo[:0] = outer_parts(child)
            else:
                todo[:0] = ast.iter_child_nodes(child)

    def stands_for(self, name: str, scope: ast.AST) -> str:
        chain = self.tables.get(id(scope))
        if chain is None:
            return ""
        here = True
        for table in reversed(chain):
            if table.get_type() == "class" and not here:
                continue
            here = False
            try:
                symbol = table.lookup(name)
            except KeyError:
                continue
            if symbol.is_imported() and not symbol.is_parameter() and not symbol.is_assigned():
                return self.imported[id(table)].get(name, "")
            if symbol.is_local() and (symbol.is_assigned() or symbol.is_parameter() or symbol.is_namespace()):
                return ""
        return name


SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def first_line(node: ast.AST) -> int:
    return node.decorator_list[0].lineno if getattr(node, "decorator_list", None) else node.lineno


def scope_name(node: ast.AST) -> str:
    kind = {ast.Lambda: "lambda", ast.ListComp: "listcomp", ast.SetComp: "setcomp", ast.DictComp: "dictcomp", ast.GeneratorExp: "genexpr"}
    return getattr(node, "name", None) or kind[type(node)]


def outer_parts(node: ast.AST) -> list[ast.AST]:
    """Parts of a scope's statement that the scope around it evaluates."""
    if isinstance(node, ast.ClassDef):
        return [*node.decorator_list, *node.bases, *node.keywords]
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
        return [*getattr(node, "decorator_list", []), *node.args.defaults, *(d for d in node.args.kw_defaults if d)]
    return [node.generators[0].iter]


def own_parts(node: ast.AST) -> list[ast.AST]:
    """Parts that are evaluated inside the scope."""
    if isinstance(node, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
        inner = [x for i, g in enumerate(node.generators) for x in ([] if i == 0 else [g.iter]) + g.ifs]
        return inner + ([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])
    return [node.body] if isinstance(node, ast.Lambda) else list(node.body)


def dotted(node: ast.AST, names: Names, scope: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return names.stands_for(node.id, scope)
    return f"{dotted(node.value, names, scope)}.{node.attr}" if isinstance(node, ast.Attribute) else ""


def calls_of(source: str) -> list[tuple[str, str, int, int, str]]:
    """(rule, severity, line, column, symbol) of the calls of interest, in source order."""
    tree = ast.parse(source)
    names, out = Names(source, tree), []
    todo: list[tuple[ast.AST, ast.AST]] = [(n, tree) for n in tree.body]
    while todo:
        node, scope = todo.pop()
        if isinstance(node, ast.Call) and (symbol := dotted(node.func, names, scope)) in CALLS:
            meaning = CALLS[symbol]
            if meaning is None:
                shell = [k.value for k in node.keywords if k.arg == "shell"]
                off = not shell or isinstance(shell[0], ast.Constant) and shell[0].value is False
                meaning = ("python.process-call", "info") if off else ("python.shell-execution", "high")
            out.append((*meaning, node.lineno, node.col_offset + 1, symbol))
        if isinstance(node, SCOPES):
            todo.extend((n, scope) for n in outer_parts(node))
            todo.extend((n, node) for n in own_parts(node))
        else:
            todo.extend((n, scope) for n in ast.iter_child_nodes(node))
    return sorted(out, key=lambda r: (r[2], r[3]))


class Complexity(ast.NodeVisitor):
    """Decision complexity of one function: one, and one for each way that its own statements can part. What is nested in
    it as a function, class or lambda is measured by itself."""

    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef):
        self.ways = 1
        for statement in function.body:
            self.visit(statement)

    def apart(self, node: ast.AST) -> None:
        """A nested scope."""

    def part(self, node: ast.AST) -> None:
        self.ways += 1
        self.generic_visit(node)

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = visit_Lambda = apart
    visit_If = visit_IfExp = visit_For = visit_AsyncFor = visit_While = visit_ExceptHandler = part

    def visit_BoolOp(self, node: ast.BoolOp) -> None:
        self.ways += len(node.values) - 1
        self.generic_visit(node)

    def visit_comprehension(self, node: ast.comprehension) -> None:
        self.ways += len(node.ifs)
        self.part(node)

    def visit_match_case(self, node: ast.match_case) -> None:
        takes_all = isinstance(node.pattern, ast.MatchAs) and not node.pattern.pattern
        self.ways += int(not takes_all) + int(node.guard is not None)
        self.generic_visit(node)


def complexities_of(source: str) -> list[tuple[str, int, int]]:
    """(name, line, complexity) of each function."""
    functions = (n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
    return [(f.name, f.lineno, Complexity(f).ways) for f in functions]


def _rows(files: DataFrame, analyse, columns: list[str], schema: str) -> DataFrame:
    """analyse(source) of each file, with a status: ok, or why the file has no rows."""

    def run(frames):
        for f in frames:
            rows = []
            for path, source in zip(f["relative_path"], f["content"]):
                try:
                    if source is None or len(source) > MAX_BYTES:
                        raise ValueError
                    found = analyse(source)
                    rows.extend((path, "ok", *r) for r in found)
                    if not found:
                        rows.append((path, "ok", *[None] * len(columns)))
                except (SyntaxError, ValueError, RecursionError):
                    rows.append((path, "unavailable", *[None] * len(columns)))
            yield pd.DataFrame(rows, columns=["relative_path", "status", *columns])

    return files.select("relative_path", "content").mapInPandas(run, f"relative_path string, status string, {schema}")


def python_calls(files: DataFrame) -> DataFrame:
    """Calls in Python files (relative_path, content); a file without any has one row with a null rule."""
    return _rows(files, calls_of, ["rule", "severity", "line", "col", "symbol"], "rule string, severity string, line long, col long, symbol string")


def python_complexity(files: DataFrame) -> DataFrame:
    return _rows(files, complexities_of, ["name", "line", "complexity"], "name string, line long, complexity long")


def commit_rows(files: DataFrame) -> DataFrame:
    """Of files with a commit_id: one row for each commit with files, functions, average and maximum complexity."""
    measured = python_complexity(files.select(F.concat_ws("\x00", "commit_id", "relative_path").alias("relative_path"), "content"))
    return (
        measured.withColumn("commit_id", F.split_part("relative_path", F.lit("\x00"), F.lit(1))).groupBy("commit_id")
        .agg(
            F.countDistinct("relative_path").alias("files"), F.count("complexity").alias("functions"),
            F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average_cc"), F.coalesce(F.max("complexity"), F.lit(0)).alias("max_cc"),
        )
    )
