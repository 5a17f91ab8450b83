"""Score policy: guards, bands, grades and severities as SQL expressions."""

from __future__ import annotations

from ..schema import COMPLEXITY_BANDS, COMPLEXITY_MEASURES, DUPLICATION_BANDS, GRADES, LINT_BANDS, PENALTIES, SEVERITIES, TYPE_BANDS, WEIGHTS


def number(x: str) -> str:
    """The measurement, or NULL unless it is finite and not negative."""
    return f"(case when not isnan({x}) and {x} >= 0 and {x} < cast('Infinity' as double) then {x} end)"


def finite(x: str) -> str:
    return f"coalesce(not isnan({x}) and {x} > cast('-Infinity' as double) and {x} < cast('Infinity' as double), false)"


def band(x: str, bands: tuple[tuple[int, int], ...]) -> str:
    """The score of the first inclusive ceiling; 0 beyond the last; NULL stays NULL."""
    steps = " ".join(f"when {x} <= {ceiling} then {score}" for ceiling, score in bands)
    return f"(case when {x} is null then null {steps} else 0 end)"


def lookup(x: str, table: dict[str, object], default: str = "null") -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"(case {x} {' '.join(f"when '{k}' then {value(v)}" for k, v in table.items())} else {default} end)"


def severity_rank(x: str) -> str:
    return lookup(x, {s: i for i, s in enumerate(SEVERITIES)})


def penalty(x: str) -> str:
    return lookup(x, PENALTIES)


def weight(x: str) -> str:
    return lookup(x, WEIGHTS)


def grade(x: str) -> str:
    """Unknown is '?', which isn't a failing grade."""
    return f"(case when {x} is null then '?' {' '.join(f"when {x} >= {floor} then '{g}'" for floor, g in GRADES)} else 'F' end)"


def stage_score(penalties: str = "penalties") -> str:
    """Score of a stage row; only an ok stage has one. least() skips NULL, so the types score is guarded."""
    errors, warnings = band(number("error_count"), TYPE_BANDS), band(number("warning_count"), LINT_BANDS)
    facts = ("license_file", "nontrivial_readme", "test_files", "gitignore_file")
    return f"""(case when status <> 'ok' then null
        when category = 'lint' then {band(number("issue_count"), LINT_BANDS)}
        when category = 'types' then case when {errors} is null or {warnings} is null then null else least({errors}, {warnings}) end
        when category = 'complexity' then {band(number("max_cc"), COMPLEXITY_BANDS)}
        when category = 'duplication' then {band(number("duplication_percent"), DUPLICATION_BANDS)}
        when category = 'security' then greatest(0, 100 - coalesce({penalties}, 0))
        when category = 'hygiene' then 25 * ({" + ".join(f"cast({f} as int)" for f in facts)})
        end)"""


def blocking_value(metric: str, value: str) -> str:
    """A named complexity measure that is finite and above 50."""
    named = ", ".join(f"'{m}'" for m in COMPLEXITY_MEASURES)
    return f"({metric} in ({named}) and coalesce(not isnan({value}) and {value} > 50 and {value} < cast('Infinity' as double), false))"


def identity(alias: str = "") -> str:
    """A finding's name: its fingerprint, else 20 hex digits over rule, path, symbol and metric or message."""
    a = f"{alias}." if alias else ""
    said = f"case when {a}metric <> '' then {a}metric else {a}message end"
    return f"(case when {a}fingerprint <> '' then {a}fingerprint else substring(sha2({a}rule || char(0) || {a}path || char(0) || {a}symbol || char(0) || {said}, 256), 1, 20) end)"
