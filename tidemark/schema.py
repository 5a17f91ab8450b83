"""Canonical evidence tables and the policy's fixed values."""

from __future__ import annotations

def struct(**fields: str) -> str:
    """A schema as DDL text."""
    return ", ".join(f"{k} {v}" for k, v in fields.items())


STAGES = struct(
    snapshot_id="string", stage_id="string", category="string", status="string", required="boolean", tool="string", version="string", reason="string",
    scope="string", analyzed_files="bigint", eligible_files="bigint", issue_count="double", error_count="double", warning_count="double", max_cc="double",
    duplication_percent="double", license_file="boolean", nontrivial_readme="boolean", test_files="boolean", gitignore_file="boolean",
)
FINDINGS = struct(
    snapshot_id="string", stage_id="string", ord="string", rule="string", message="string", severity="string", path="string", line="bigint",
    symbol="string", fingerprint="string", metric="string", value="double", identity_kind="string",
)

# Fixed values of score policy 1.1.0.
WEIGHTS = {"lint": 15, "types": 20, "complexity": 20, "duplication": 15, "security": 20, "hygiene": 10}
LINT_BANDS = ((0, 100), (5, 90), (20, 75), (50, 60), (100, 40))
TYPE_BANDS = ((0, 100), (3, 90), (10, 75), (30, 50), (100, 25))
COMPLEXITY_BANDS = ((10, 100), (20, 85), (30, 70), (40, 50), (50, 30))
DUPLICATION_BANDS = ((5, 100), (10, 90), (20, 75), (40, 55), (60, 30))
PENALTIES = {"info": 0, "low": 2, "medium": 8, "high": 25, "critical": 100}
SEVERITIES = ("info", "low", "medium", "high", "critical")
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
BLOCKED_CAP = 20
COMPLEXITY_LIMIT, DUPLICATION_LIMIT = 50, 60
COMPLEXITY_MEASURES = ("cyclomatic_complexity", "shell-ast-decision-complexity-v1")
# Folders out of scope, and languages by suffix.
EXCLUDED_DIRECTORIES = (
    ".git", "node_modules", "vendor", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".pyscn", ".wily", "target",
    "build", "dist", ".next", ".gradle", ".idea",
)
LANGUAGES = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript",
    "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "rs": "rust", "go": "go", "c": "c", "h": "c", "cc": "cpp",
    "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "swift": "swift", "m": "objc", "mm": "objc", "scala": "scala", "lua": "lua",
    "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "php": "php", "sh": "shell",
}
MAX_FILE_BYTES, MAX_TREE_BYTES, MAX_FILES = 8 << 20, 256 << 20, 20_000
BATCH_FILES, BATCH_BYTES = 32, 512 << 10
