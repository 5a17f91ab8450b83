"""A whole check of source snapshots: which stages their languages call for, what the built-in analyzers find, and a
missing stage for each tool that isn't there, so that absent evidence stays visible in the assessment.

files: snapshot_id, relative_path, size_bytes, content (text). Every stage is a grouping over all snapshots at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from .inventory import CALL_LANGUAGES, inventoried, selection
from .python_code import python_calls
from .text_rules import secret_lines, unicode_controls

# Stage, category, tool, languages of which one must occur, full profile only, required.
CAPABILITIES = (
    ("complexity.lizard", "complexity", "lizard", ("python", "java", "rust", "go", "c", "cpp", "ruby", "swift", "objc", "scala", "lua", "kotlin", "csharp"), False, True),
    ("python.lint.ruff", "lint", "ruff", ("python",), False, True),
    ("python.types.pyrefly", "types", "pyrefly", ("python",), False, True),
    ("python.health.pyscn", "health", "pyscn", ("python",), True, False),
    ("python.duplication.pyscn", "duplication", "pyscn", ("python",), True, True),
    ("python.deadcode.pyscn", "structure", "pyscn", ("python",), True, True),
    ("python.maintainability.radon", "maintainability", "radon", ("python",), True, False),
    ("complexity.javascript", "complexity", "typescript", ("javascript", "typescript"), False, True),
    ("javascript.lint.eslint", "lint", "eslint", ("javascript", "typescript"), False, True),
    ("javascript.duplication.jscpd", "duplication", "jscpd", ("javascript", "typescript"), True, True),
    ("typescript.types.tsc", "types", "tsc", ("typescript",), False, True),
    ("java.structure", "structure", "jdk", ("java",), False, True),
    ("java.types", "types", "javac", ("java",), False, True),
    ("shell.syntax.shfmt", "structure", "shfmt", ("shell",), False, True),
    ("complexity.shell", "complexity", "shfmt", ("shell",), False, True),
    ("php.syntax.php", "structure", "php", ("php",), False, True),
    ("php.types.phpstan", "types", "phpstan", ("php",), False, True),
    ("complexity.php", "complexity", "lizard", ("php",), False, True),
    ("security.php", "security", "php", ("php",), False, True),
    ("php.duplication.jscpd", "duplication", "jscpd", ("php",), True, True),
    ("php.templates.blade", "structure", "builtin", ("php-blade",), False, True),
)
# The facts of the hygiene stage, and names of lock files.
FACTS = ("license_file", "nontrivial_readme", "test_files", "gitignore_file", "ci_configuration", "dependency_lockfile")
LOCKS = (
    "uv.lock", "poetry.lock", "Pipfile.lock", "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "go.sum", "Gemfile.lock",
    "composer.lock",
)
_STAGE = [tuple(c.split()) for c in schema.STAGES.split(", ")]
_FINDING = [tuple(c.split()) for c in schema.FINDINGS.split(", ")]


def as_stages(rows: DataFrame, **given: Column | str) -> DataFrame:
    """rows (snapshot_id, ...) as stage rows; what neither they nor given have is empty or null."""
    blank = {"reason": "", "version": "", "scope": "all", "tool": "builtin"}
    given = {k: F.lit(v) if isinstance(v, (str, bool)) else v for k, v in given.items()}
    value = lambda c: given.get(c, F.col(c) if c in rows.columns else F.lit(blank.get(c)))
    return rows.select(*(value(c).cast(t).alias(c) for c, t in _STAGE))


def as_findings(rows: DataFrame, stage_id: str, message: Column) -> DataFrame:
    blank = {"fingerprint": "", "metric": "", "symbol": "", "identity_kind": "name", "line": 0}
    order = F.concat_ws(":", F.lit(stage_id), "path", F.lpad(F.col("line").cast("string"), 9, "0"), "rule")
    made = {"stage_id": F.lit(stage_id), "message": message, "ord": order}
    return rows.select(*(made.get(c, F.col(c) if c in rows.columns else F.lit(blank.get(c))).cast(t).alias(c) for c, t in _FINDING))


def planned(files: DataFrame, profile: str = "quick") -> DataFrame:
    """(snapshot_id, stage_id, category, tool, required, omitted, eligible_files): what the observed languages call for."""
    table = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("stage_id", "category", "tool", "full", "required"), (s, c, t, f, r))), F.array(*map(F.lit, langs)).alias("languages")) for s, c, t, langs, f, r in CAPABILITIES))
    here = inventoried(files).where("in_scope and language <> '' and not is_test").groupBy("snapshot_id", "language").agg(F.count("*").alias("n"))
    rows = here.withColumn("c", F.explode(table)).where(F.array_contains("c.languages", F.col("language")))
    rows = rows.groupBy("snapshot_id", "c.stage_id", "c.category", "c.tool", "c.required", "c.full").agg(F.sum("n").alias("eligible_files"))
    return rows.withColumn("omitted", F.col("full") & F.lit(profile != "full")).drop("full")


def missing_stages(files: DataFrame, profile: str = "quick") -> DataFrame:
    """A stage without measurements for each planned external tool. Blade templates have no analyzer at all."""
    rows = planned(files, profile).where("not omitted")
    blade = F.col("stage_id") == "php.templates.blade"
    return as_stages(rows, status=F.when(blade, "unsupported").otherwise("missing"), reason=F.concat(F.col("tool"), F.lit(" is not available")), analyzed_files=F.lit(0))


def hygiene(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    root = ~F.contains(F.col("relative_path"), F.lit("/"))
    name = F.lower(F.split_part("relative_path", F.lit("."), F.lit(1)))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = inventoried(files).where("in_scope").groupBy("snapshot_id").agg(
        some(root & name.isin("license", "licence", "copying") & (F.col("size_bytes") > 0)).alias("license_file"),
        some(root & (name == "readme") & (F.length(F.regexp_replace("content", r"^\s+|\s+$", "")) > 100)).alias("nontrivial_readme"),
        some(F.col("is_test") & (F.col("size_bytes") > 0)).alias("test_files"),
        some(F.col("relative_path") == ".gitignore").alias("gitignore_file"),
        some((F.col("relative_path") == ".gitlab-ci.yml") | F.col("relative_path").rlike(r"^\.github/workflows/.*\.ya?ml$")).alias("ci_configuration"),
        some(F.col("relative_path").isin(*LOCKS)).alias("dependency_lockfile"),
        F.count("*").alias("analyzed_files"),
    )
    absent = facts.select("snapshot_id", F.explode(F.array(*(F.when(~F.col(f), F.lit(f)) for f in FACTS))).alias("fact")).where("fact is not null")
    rows = absent.select("snapshot_id", F.concat(F.lit("hygiene."), F.col("fact")).alias("rule"), F.lit("low").alias("severity"), F.lit("").alias("path"), F.lit(0).alias("line"))
    stage = as_stages(facts, stage_id="hygiene", category="hygiene", status="ok", required=True, eligible_files=F.col("analyzed_files"))
    return stage, as_findings(rows, "hygiene", F.concat(F.col("rule"), F.lit(" was not observed")))


def _keyed(files: DataFrame) -> DataFrame:
    """One text key for snapshot and path, for analyzers that keep a single one."""
    return files.withColumn("relative_path", F.concat_ws("\x00", "snapshot_id", "relative_path"))


def _unkeyed(rows: DataFrame, column: str = "relative_path") -> DataFrame:
    return rows.withColumn("snapshot_id", F.split_part(column, F.lit("\x00"), F.lit(1))).withColumn("path", F.split_part(column, F.lit("\x00"), F.lit(2)))


# What the stages of a selection and of calls say, and Java's rules that run code.
PARTIAL = "Only selected paths were scanned; repository evidence is partial"
OBSERVED = "Syntax observations with approximate lexical bindings; no flow, runtime reachability or authorship inference"
JAVA_EXECUTION = (
    "java.runtime-exec", "java.script-eval", "java.process-builder", "java.shell-execution", "java.unsafe-api", "java.reflective-load", "java.reflective-access",
    "java.script-engine",
)
PARSED = ("python", "javascript", "typescript", "java", "shell")


def java_execution(findings: DataFrame) -> DataFrame:
    """P-13: of Java's structure findings those that run code."""
    return findings.where(F.col("rule").isin(*JAVA_EXECUTION))


def withheld(tool: str, rule: str = "rule") -> Column:
    """P-16: a tool's message can quote sources, so only its rule is published."""
    return F.concat(F.lit(tool + " "), F.col(rule), F.lit(" diagnostic"))


def obfuscated(calls: DataFrame, controls: DataFrame) -> DataFrame:
    """J-6: execution calls from medium on in a file with a suspicious control, of which the last one is named. Both have
    snapshot_id, path, line, severity; controls also col and symbol."""
    weighs = F.col("severity").isin("medium", "high")
    last = controls.where(weighs).groupBy("snapshot_id", "path").agg(F.max_by(F.struct("symbol", F.col("line").alias("at")), F.struct("line", "col")).alias("control"))
    said = F.concat(F.lit("Execution call shares file with "), F.col("control.symbol"), F.lit(" at line "), F.col("control.at").cast("string"), F.lit("; review both locations"))
    rows = calls.where(weighs).select("snapshot_id", "path", "line").join(last, ["snapshot_id", "path"])
    return rows.select("snapshot_id", "path", "line", F.lit("security.obfuscated-execution").alias("rule"), F.lit("high").alias("severity"), said.alias("message"))


def scan(files: DataFrame, profile: str = "quick", selected: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The stages and findings of every snapshot. selected: literal paths to which the evidence is limited."""
    if selected is not None:
        files = selection(files, selected)
    known = inventoried(files).where("in_scope")
    counts = known.groupBy("snapshot_id").agg(F.count("*").alias("analyzed_files"), F.collect_set("language").alias("languages"))
    whole = {"required": True, "eligible_files": F.col("analyzed_files")}
    inventory = as_stages(counts, stage_id="inventory", category="hygiene", status="ok", **whole)

    facts, absent = hygiene(files)
    keyed = _keyed(known)
    controls = _unkeyed(unicode_controls(keyed.select(F.col("relative_path").alias("doc_id"), F.col("content").alias("text")), "string"), "doc_id")
    unicode_stage = as_stages(counts, stage_id="security.unicode", category="security", status="ok", tool="builtin-unicode", **whole)
    unicode_found = as_findings(controls, "security.unicode", F.concat(F.col("symbol"), F.lit("; review text direction/context")))

    line = F.posexplode(F.split("content", "\r\n|\r|\n")).alias("at", "text")
    lines = known.select("snapshot_id", F.col("relative_path").alias("path"), line)
    secrets = secret_lines(lines).select("snapshot_id", "path", (F.col("at") + 1).alias("line"), "rule", F.lit("high").alias("severity"))
    secret_stage = as_stages(counts, stage_id="security.secrets", category="security", status="limited", tool="builtin-patterns", reason="Built-in patterns only; this does not establish absence", **whole)
    secret_found = as_findings(secrets, "security.secrets", F.lit("Potential secret; the value is not published"))

    parsed = _unkeyed(python_calls(keyed.where("language = 'python'").select("relative_path", "content")))
    unread = parsed.where("status <> 'ok'").groupBy("snapshot_id").agg(F.count("*").alias("unread"))
    php_only = (F.size(F.array_except("languages", F.array(*map(F.lit, ("", "php", "php-blade"))))) == 0) & (F.size(F.array_remove("languages", "")) > 0)
    of = known.where(F.col("language").isin(*PARSED)).groupBy("snapshot_id").agg(F.count("*").alias("eligible"), F.count_if(F.col("language") == "python").alias("python"))
    calls = counts.where(~php_only).join(unread, "snapshot_id", "left").join(of, "snapshot_id", "left").fillna(0, ["unread", "eligible", "python"])
    unsupported = F.array_sort(F.array_except("languages", F.array(*map(F.lit, CALL_LANGUAGES))))
    no_parser = F.array_sort(F.array_intersect("languages", F.array(*map(F.lit, PARSED[1:]))))
    reasons = F.concat_ws(
        "; ", F.when(F.col("unread") > 0, F.concat(F.col("unread").cast("string"), F.lit(" Python files could not be parsed"))), F.when(F.size(no_parser) > 0, F.concat(F.lit("No call parser here for: "), F.array_join(no_parser, ", "))),
        F.when(F.size(unsupported) > 0, F.concat(F.lit("Call parsing unsupported for: "), F.array_join(unsupported, ", "))),
    )
    status = F.when(reasons != "", "limited").when(F.col("eligible") > 0, "ok").otherwise("skipped")
    call_stage = as_stages(
        calls, stage_id="security.execution", category="security", status=status, reason=F.when(reasons != "", reasons).otherwise(OBSERVED), required=True, analyzed_files=F.col("python") - F.col("unread"),
        eligible_files=F.col("eligible"),
    )
    seen = parsed.where("rule is not null")
    call_found = as_findings(seen, "security.execution", F.concat(F.lit("Review "), F.col("rule"), F.lit(" call; syntax does not establish malicious intent")))
    pair_found = as_findings(obfuscated(seen, controls), "security.execution", F.col("message"))

    made = [inventory, facts, unicode_stage, secret_stage, call_stage, missing_stages(files, profile)]
    if selected is not None:
        made.append(as_stages(counts, stage_id="scope.selection", category="structure", status="limited", reason=PARTIAL, scope="selected-paths", **whole))
    return reduce(DataFrame.unionByName, made), reduce(DataFrame.unionByName, (absent, unicode_found, secret_found, call_found, pair_found))
