"""The driver queries: each relation of the survey's index by its key, with its check statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assessment, delta, documents, findings, inventory, messages, text_rules  # noqa: F401  they define relations
from ..schema import BATCH_BYTES, BATCH_FILES
from ..sources import projections  # noqa: F401
from .checks import checks
from .relation import RELATIONS

KEYS = [
    "assessment", "band_scores", "batch_packing", "blob_hash", "blockers", "category_scores", "changed_line_join", "changed_paths", "classify_content", "clone_ratio", "clone_reconcile",
    "clone_validate", "comparison_exit", "complexity_summary", "count_reconcile", "coverage_gaps", "delta_assessment", "delta_counts", "delta_document", "delta_items", "delta_match", "delta_rows",
    "duplicate_identities", "enclosing_names", "environment_split", "excluded_directories", "execution_counts", "execution_status", "exit_code", "foreign_locations", "grades", "greedy_budget", "history_rows", "hotspots",
    "hunk_parse", "hygiene_facts", "hygiene_score", "identity", "in_scope", "inventory", "inventory_equal", "language_slice", "languages", "limited_regressions",
    "line_window_clones", "markdown_escape", "metric_deltas", "metric_regressions", "mi_average", "next_actions", "obfuscation_pairs", "observation_except_all",
    "observed_score", "omitted_paths", "path_selection", "prioritized_findings", "rank_dominance", "receipt_summary", "redact_urls", "review_url", "rule_histogram",
    "running_budget", "safe_links", "safe_paths", "scope_manifest", "secret_rules", "secret_scan", "security_score", "shell_decisions", "shell_dialect", "stage_pairs", "stage_scores", "stage_union",
    "strict_score", "summary_guard", "test_paths", "text_lines", "token_findings", "tool_version", "top20_findings", "tree_diff", "uncertain_identities", "unicode_controls", "unresolved_groups",
    "unsupported_languages", "working_status",
]


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: RELATIONS[name].frame(spark, sf_dir)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RELATIONS["ev_files"].frame(spark, sf_dir).withColumn("snapshot", F.floor(F.col("doc_id") / 500))


QUERIES = {f"q_{name}": query(name) for name in KEYS}
QUERIES["q_greedy_budget"] = lambda spark, sf_dir: inventory.greedy_budget(_files(spark, sf_dir), 200_000)
QUERIES["q_batch_packing"] = lambda spark, sf_dir: inventory.batch_packing(_files(spark, sf_dir), BATCH_FILES, BATCH_BYTES)
QUERIES["q_unicode_controls"] = lambda spark, sf_dir: text_rules.unicode_controls(RELATIONS["ev_text_controls"].frame(spark, sf_dir).withColumnRenamed("t", "text"))
QUERIES["q_secret_scan"] = lambda spark, sf_dir: text_rules.secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
QUERIES["q_secret_rules"] = lambda spark, sf_dir: RELATIONS["secret_rules"].over(secret_scan=QUERIES["q_secret_scan"](spark, sf_dir))
QUERIES["q_classify_content"] = lambda spark, sf_dir: (
    RELATIONS["ev_contents"].frame(spark, sf_dir).select("relative_path", F.unhex("content_hex").alias("content")).select("relative_path", inventory.classified().alias("classification"))
)
QUERIES["q_shell_decisions"] = lambda spark, sf_dir: documents.shell_decisions(RELATIONS["ev_syntax"].frame(spark, sf_dir))
QUERIES["q_diagnostic_messages"] = lambda spark, sf_dir: messages.messages(RELATIONS["ev_messages"].frame(spark, sf_dir))

_CHECKS = checks()
ORACLE_SQL = {f"q_{name}": s for name in [*KEYS, "diagnostic_messages"] if (s := _CHECKS.get(name) or RELATIONS[name].statement())}
