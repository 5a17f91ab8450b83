"""Assessment of a snapshot: stage, category and strict scores, gaps, blockers, decision, observed score, gates.

Missing evidence is never a clean result: a stage that isn't ok has no score, and one missing score leaves its category
without one. Python's round is half to even, as bround is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.policy import band, grade, number, penalty, severity_rank, stage_score, weight
from ..plans.relation import RELATIONS, relation
from ..schema import BLOCKED_CAP, COMPLEXITY_LIMIT, DUPLICATION_BANDS, DUPLICATION_LIMIT, LINT_BANDS, WEIGHTS

_CATEGORIES = ", ".join(f"'{c}'" for c in WEIGHTS)
_SELECTED = f"required and stage_id <> 'inventory' and category in ({_CATEGORIES})"

# A-8: penalties are summed before the join, one row for each stage.
relation("stage_penalties", f"""
select snapshot_id, stage_id, sum({penalty("severity")}) as penalties, count_if(severity = 'critical') as critical,
  bool_or(severity in ('medium', 'high')) as to_review
from {{ev_findings}} group by snapshot_id, stage_id
""", "ev_findings")

relation("security_score", """
select s.snapshot_id, s.stage_id, cast(greatest(0, 100 - coalesce(p.penalties, 0)) as bigint) as score
from {ev_stages} s left join {stage_penalties} p on s.snapshot_id = p.snapshot_id and s.stage_id = p.stage_id
where s.category = 'security'
""", "ev_stages", "stage_penalties")

# F-2, F-4, F-5, P-15
relation("scored_stages", f"""
select s.*, cast({stage_score("p.penalties")} as bigint) as score, coalesce(p.to_review, false) as to_review
from {{ev_stages}} s left join {{stage_penalties}} p on s.snapshot_id = p.snapshot_id and s.stage_id = p.stage_id
""", "ev_stages", "stage_penalties")

relation("stage_scores", "select snapshot_id, stage_id, category, status, required, score from {scored_stages}", "scored_stages")

relation("hygiene_score", """
select snapshot_id, stage_id, cast(25 * (cast(license_file as int) + cast(nontrivial_readme as int) + cast(test_files as int) + cast(gitignore_file as int)) as bigint) as score
from {ev_stages} where category = 'hygiene'
""", "ev_stages")

relation("band_scores", f"""
select o_orderkey, cast({band("x", LINT_BANDS)} as bigint) as lint, cast({band("x", DUPLICATION_BANDS)} as bigint) as duplication
from (select o_orderkey, {number("o_totalprice / 2000")} as x from {{orders}}) t
""", "orders")

relation("grades", f"select o_orderkey, score, {grade('score')} as grade from (select o_orderkey, case when o_orderkey % 9 = 0 then null else bround(o_totalprice / 4000, 2) end as score from {{orders}}) t", "orders",
         check=f"select o_orderkey, score, {grade('score')} as grade from (select o_orderkey, case when o_orderkey % 9 = 0 then null else round_even(o_totalprice / 4000, 2) end as score from {{orders}}) t")

# A-1: min() skips NULL, so the count of scores guards it. Stages are selected in the sums and not before: a filter would
# go below the scores, which are then dealt apart from those that other relations ask for.
_CATEGORY_SCORES = """
select snapshot_id, category, case when count(*) = count(score) then min(score) end as score
from {{scored_stages}} where {selected} group by snapshot_id, category"""
relation("category_scores", f"""
select snapshot_id, category, case when count_if({_SELECTED}) = count(case when {_SELECTED} then score end) then min(case when {_SELECTED} then score end) end as score
from {{scored_stages}} group by snapshot_id, category having count_if({_SELECTED}) > 0
""", "scored_stages", check=_CATEGORY_SCORES.format(selected=_SELECTED).strip())

# A-4
relation("coverage_gaps", f"""
select snapshot_id, stage_id, status, reason from {{scored_stages}}
where required and (status <> 'ok' or (category in ({_CATEGORIES}) and stage_id <> 'inventory' and score is null))
""", "scored_stages")

# A-5: whatever a stage's status or required flag.
relation("blockers", f"""
select distinct snapshot_id, reason from (
  select snapshot_id, stage_id || ': a function exceeds 50 cyclomatic complexity' as reason from {{ev_stages}}
    where category = 'complexity' and coalesce({number("max_cc")}, 0) > {COMPLEXITY_LIMIT}
  union all select snapshot_id, stage_id || ': duplication exceeds 60%' from {{ev_stages}}
    where category = 'duplication' and coalesce({number("duplication_percent")}, 0) > {DUPLICATION_LIMIT}
  union all select snapshot_id, stage_id || ': no license file observed; adoption terms need review' from {{ev_stages}}
    where category = 'hygiene' and license_file = false
  union all select f.snapshot_id, f.stage_id || ': ' || f.rule || ' (' || f.path || ':' || cast(f.line as string) || ')'
    from {{ev_findings}} f join (select distinct snapshot_id, stage_id from {{ev_stages}}) s on f.snapshot_id = s.snapshot_id and f.stage_id = s.stage_id
    where f.severity = 'critical') t
""", "ev_stages", "ev_findings")

# A-2
relation("strict_score", f"""
select r.snapshot_id, r.required_stages, r.required_stages - r.gaps as completed_stages, r.required_stages > 0 and r.gaps = 0 as complete,
  case when r.required_stages > 0 and r.gaps = 0 then bround(cast(c.numerator as double) / c.denominator, 2) end as score
from (select snapshot_id, count_if(required) as required_stages,
    count_if(required and (status <> 'ok' or (category in ({_CATEGORIES}) and stage_id <> 'inventory' and score is null))) as gaps
  from {{scored_stages}} group by snapshot_id) r
left join (select snapshot_id, sum({weight("category")} * score) as numerator, sum({weight("category")}) as denominator from {{category_scores}} group by snapshot_id) c
  on r.snapshot_id = c.snapshot_id
""", "scored_stages", "category_scores")

# A-6, A-7
relation("assessment", f"""
select snapshot_id, score, {grade("score")} as grade, complete, required_stages, completed_stages, blockers,
  case when blockers > 0 then 'hold' when not complete then 'unknown' when to_review then 'review' else 'no_configured_blockers' end as decision
from (select s.snapshot_id, case when coalesce(b.n, 0) > 0 then least(s.score, cast({BLOCKED_CAP} as double)) else s.score end as raw, s.score is null as none,
    case when s.score is null then null when coalesce(b.n, 0) > 0 then least(s.score, cast({BLOCKED_CAP} as double)) else s.score end as score,
    s.complete, s.required_stages, s.completed_stages, coalesce(b.n, 0) as blockers, r.to_review
  from {{strict_score}} s
  left join (select snapshot_id, count(*) as n from {{blockers}} group by snapshot_id) b on s.snapshot_id = b.snapshot_id
  left join (select snapshot_id, bool_or(to_review) as to_review from {{scored_stages}} group by snapshot_id) r on s.snapshot_id = r.snapshot_id) t
""", "strict_score", "blockers", "scored_stages")

# A-3
relation("observed_score", f"""
select o.snapshot_id, case when o.weight = 0 then null when coalesce(b.n, 0) > 0 then least(bround(cast(o.numerator as double) / o.weight, 2), cast({BLOCKED_CAP} as double))
    else bround(cast(o.numerator as double) / o.weight, 2) end as score, o.weight, o.applicable, coalesce(o.partial, '') as partial, o.contributors, o.exclusions
from (select snapshot_id, coalesce(sum(case when score is not null then w end), 0) as weight, sum(w) as applicable, coalesce(sum(w * score), 0) as numerator,
    array_join(array_sort(collect_list(case when missing > 0 then category end)), ',') as partial, sum(measured) as contributors, sum(missing) as exclusions
  from (select snapshot_id, category, {weight("category")} as w, min(score) as score, count(score) as measured, count(*) - count(score) as missing
    from {{scored_stages}} where {_SELECTED} group by snapshot_id, category) c group by snapshot_id) o
left join (select snapshot_id, count(*) as n from {{blockers}} group by snapshot_id) b on o.snapshot_id = b.snapshot_id
""", "scored_stages", "blockers")

# F-8: the gate fails under 60 or on a high finding.
relation("exit_code", f"""
select a.snapshot_id, case when a.blockers > 0 or (a.score is not null and a.score < 60) or coalesce(f.worst, 0) >= 3 then 1 when not a.complete then 3 else 0 end as exit_code
from {{assessment}} a left join (select snapshot_id, max({severity_rank("severity")}) as worst from {{ev_findings}} group by snapshot_id) f on a.snapshot_id = f.snapshot_id
""", "assessment", "ev_findings")

# K-1, F-34
relation("receipt_summary", """
select a.snapshot_id, a.snapshot_id || ' ' || a.grade || ' ' || a.decision || ' ' || cast(a.completed_stages as string) || '/' || cast(a.required_stages as string) as label,
  '1.2.0' as schema_version, s.stages, s.limited, coalesce(f.findings, 0) as findings
from {assessment} a
left join (select snapshot_id, count(*) as stages, count_if(status <> 'ok') as limited from {ev_stages} group by snapshot_id) s on a.snapshot_id = s.snapshot_id
left join (select snapshot_id, count(*) as findings from {ev_findings} group by snapshot_id) f on a.snapshot_id = f.snapshot_id
""", "assessment", "ev_stages", "ev_findings")


# The head's report of a comparison is assessed by the same relations under names of their own.
_NAMES = ("stage_penalties", "scored_stages", "category_scores", "blockers", "strict_score", "assessment", "exit_code")
for _name in _NAMES:
    _r = RELATIONS[_name]
    _of = {n: f"head_{n}" for n in _NAMES} | {"ev_stages": "ev_head_stages", "ev_findings": "ev_head"}
    relation(f"head_{_name}", _r.sql.format(**{n: f"{{{_of[n]}}}" for n in _r.inputs}), *(_of[n] for n in _r.inputs))


def assess(stages: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each snapshot: strict score, grade, coverage, number of blockers and decision."""
    return _with(stages, findings, "assessment")


def observe(stages: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each snapshot: the score over validated stages, and what it covers."""
    return _with(stages, findings, "observed_score")


def blockers(stages: DataFrame, findings: DataFrame) -> DataFrame:
    return _with(stages, findings, "blockers")


def exit_codes(stages: DataFrame, findings: DataFrame) -> DataFrame:
    return _with(stages, findings, "exit_code")


def _with(stages: DataFrame, findings: DataFrame, name: str) -> DataFrame:
    return RELATIONS[name].frame(stages.sparkSession, "", {"ev_stages": stages, "ev_findings": findings})
