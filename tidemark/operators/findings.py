"""Findings: order, top rows, grouping by rule, correlations, and counts that must agree."""

from __future__ import annotations

from ..functions.policy import severity_rank
from ..plans.relation import relation

_ORDER = f"{severity_rank('severity')} desc, path, line, rule, ord"

# T-1, T-2
relation("prioritized_findings", f"""
select snapshot_id, stage_id, rule, severity, path, line, row_number() over (partition by snapshot_id order by {_ORDER}) as place from {{ev_findings}} where severity <> 'info'
""", "ev_findings")
relation("top20_findings", f"""
select snapshot_id, stage_id, rule, severity, path, line, ord from {{ev_findings}} order by {_ORDER} limit 20
""", "ev_findings")

# P-9, T-3, H-8
relation("hotspots", """
select snapshot_id, path, symbol, value, case when value > 50 then 'high' else 'medium' end as severity, substring(sha2('complexity.hotspot' || char(0) || path || char(0) || symbol, 256), 1, 20) as fingerprint,
  row_number() over (partition by snapshot_id order by value desc, path, line, ord) as place
from {ev_findings} where metric = 'cyclomatic_complexity' and value > 10
""", "ev_findings")

# A-10
relation("complexity_summary", """
select s.snapshot_id, s.stage_id, coalesce(f.functions, 0) as functions, case when f.functions is not null or s.status <> 'limited' then coalesce(f.max_cc, cast(0 as double)) end as max_cc,
  case when f.functions is not null or s.status <> 'limited' then bround(coalesce(f.average_cc, cast(0 as double)), 4) end as average_cc
from {ev_stages} s left join (select snapshot_id, stage_id, count(value) as functions, max(value) as max_cc, avg(value) as average_cc from {ev_findings} where metric <> '' group by snapshot_id, stage_id) f
  on f.snapshot_id = s.snapshot_id and f.stage_id = s.stage_id
where s.category = 'complexity'
""", "ev_stages", "ev_findings")
# A-11, E-16: maintainability of files from their volume, complexity and lines; under 20 is a finding
relation("mi_average", """
select snapshot_id, bround(avg(mi), 4) as average_mi, count_if(mi < 20) as low, count(*) as files
from (select snapshot_id, path, greatest(0, 100 - 2 * sum(coalesce(value, 0)) / greatest(1, count(value)) - count(*)) as mi from {ev_findings} group by snapshot_id, path) t group by snapshot_id
""", "ev_findings")

# P-10, T-4: blockers, gaps, findings from medium on in order, the hint at omitted stages, and a fallback
relation("sectioned_actions", f"""
select snapshot_id, 1 as section, 0 as urgency, '' as path, cast(0 as bigint) as line, '' as rule, 'Resolve blocker: ' || reason as action from {{blockers}}
union all select snapshot_id, 2, 0, '', 0, stage_id, 'Complete ' || stage_id || ': ' || case when reason <> '' then reason else status end from {{coverage_gaps}}
union all select snapshot_id, 3, -{severity_rank("severity")}, path, line, rule, 'Review ' || rule || ' at ' || case when path <> '' then path else 'repository' end || ':' || cast(line as string) || ': ' || message from {{ev_findings}} where {severity_rank("severity")} >= 2
union all select snapshot_id, 4, 0, '', 0, '', 'Run --profile full to include: ' || array_join(array_sort(collect_list(stage_id)), ', ') from {{ev_stages}} where profile = 'quick' and category = 'duplication' group by snapshot_id
""", "blockers", "coverage_gaps", "ev_findings", "ev_stages")
relation("next_actions", """
select s.snapshot_id, coalesce(a.section, 5) as section, coalesce(a.action, 'Read the tests, dependency policy and maintainer history before adopting or merging.') as action,
  row_number() over (partition by s.snapshot_id order by a.section, a.urgency, a.path, a.line, a.rule, a.action) as place
from (select distinct snapshot_id from {ev_stages}) s left join {sectioned_actions} a on a.snapshot_id = s.snapshot_id
""", "ev_stages", "sectioned_actions")

# U-1
relation("stage_union", "select stage_id, status from {ev_base_stages} union all select stage_id, status from {ev_head_stages}", "ev_base_stages", "ev_head_stages")

# A-12
relation("rule_histogram", """
select rule, severity, count(*) as n, min_by(message, ord) as example from {ev_diagnostics} group by rule, severity
""", "ev_diagnostics")

# Diagnostic codes that speak of the environment, and rules of unresolved references.
ENVIRONMENT = ("TS2307", "TS2688", "TS2792", "TS7016", "TS6059", "TS6307", "TS7026", "TS2875")
UNRESOLVED = (
    "require.fileNotFound", "include.fileNotFound", "class.notFound", "interface.notFound", "trait.notFound", "function.notFound", "property.notFound", "method.notFound",
    "staticMethod.notFound", "attribute.notFound", "return.unresolvableType", "parameter.unresolvableType", "property.unresolvableType",
)
_quoted = lambda values: ", ".join(f"'{v}'" for v in values)

# A-13, W-5: a rule's unresolved references become one row where the first of them stood, with the first two distinct short
# contexts in order of occurrence; one alone stays located, and all other rows go on in their place
# The level that messages state, and the summary's sentence.
LEVEL = 5
_SUFFIX = f" (snapshot level {LEVEL})"
_SENTENCE = " unresolved references; may reflect unavailable dependencies or local errors" + _SUFFIX
_RULE = "regexp_replace(rule, r'^phpstan[.]', '')"
relation("unresolved_groups", f"""
with groups as (select snapshot_id, rule, count(*) as n, min(ord) as ord from {{ev_reports}} where {_RULE} in ({_quoted(UNRESOLVED)}) group by snapshot_id, rule having count(*) > 1),
contexts as (
  select snapshot_id, rule, context, min(ord) as ord from (
    select snapshot_id, rule, ord, case when endswith(said, '{_SUFFIX}') then substring(said, 1, length(said) - {len(_SUFFIX)}) else said end as context from (
      select snapshot_id, rule, ord, substring(message, instr(message, ': ') + 2) as said from {{ev_reports}} where instr(message, ': ') > 0) a) b
  where length(context) <= 120 group by snapshot_id, rule, context),
examples as (
  select snapshot_id, rule, max(case when k = 1 then context end) || coalesce(' | ' || max(case when k = 2 then context end), '') as examples
  from (select *, row_number() over (partition by snapshot_id, rule order by ord, context) as k from contexts) c where k <= 2 group by snapshot_id, rule)
select r.snapshot_id, r.ord, r.rule, r.path, r.line, cast(1 as bigint) as n, r.message from {{ev_reports}} r left join groups g on g.snapshot_id = r.snapshot_id and g.rule = r.rule where g.n is null
union all
select g.snapshot_id, g.ord, g.rule, '', 0, g.n, 'PHPStan ' || regexp_replace(g.rule, r'^phpstan[.]', '') || ': ' || cast(g.n as string) || '{_SENTENCE}' || coalesce('; examples: ' || e.examples, '')
from groups g left join examples e on e.snapshot_id = g.snapshot_id and e.rule = g.rule
""", "ev_reports", check=f"""
select snapshot_id, ord, rule, case when n > 1 then '' else path end as path, case when n > 1 then 0 else line end as line, n, case when n = 1 then message
  else 'PHPStan ' || substr(rule, 9) || ': ' || n || '{_SENTENCE}' || case when len(seen) > 0 then '; examples: ' || array_to_string(seen[:2], ' | ') else '' end end as message
from (
  select *, case when grouped then count(*) over g else 1 end as n, row_number() over (g order by ord) as nth, list_reduce(list_prepend([]::varchar[], list_transform(list(context) over (g order by ord rows between unbounded preceding and unbounded following), lambda x: case when x is null then [] else [x] end)),
    lambda a, x: case when len(x) = 0 or list_contains(a, x[1]) then a else list_concat(a, x) end) as seen
  from (select *, substr(rule, 9) in ({_quoted(UNRESOLVED)}) as grouped, case when contains(message, ': ') and length(replace(substr(message, position(': ' in message) + 2), '{_SUFFIX}', '')) <= 120 then replace(substr(message, position(': ' in message) + 2), '{_SUFFIX}', '') end as context from {{ev_reports}})
  window g as (partition by snapshot_id, rule))
where n = 1 or nth = 1
""")

# P-14: what the environment lacks, apart from what the source says
relation("environment_split", f"""
select snapshot_id, rule in ({_quoted(ENVIRONMENT)}) as environment, severity, count(*) as n, count(distinct path) as files from {{ev_diagnostics}} where startswith(rule, 'TS') group by 1, 2, 3
""", "ev_diagnostics")

# J-6: an execution call from medium on meets the last suspicious control of its file
relation("ev_controls", """
select 'snap' || cast(doc_id % 40 as string) as snapshot_id, 'f' || cast(doc_id % 977 as string) || '.py' as path, doc_id as ord, case when doc_id % 3 = 0 then 'info' when doc_id % 3 = 1 then 'medium' else 'high' end as severity,
  'U+' || case when doc_id % 3 = 2 then '202E' else '200E' end as symbol, n_chars % 300 as line from {documents}
""", "documents")
relation("ev_calls", """
select 'snap' || cast(event_id % 40 as string) as snapshot_id, 'f' || cast(event_id % 977 as string) || '.py' as path, event_id as ord, event_id % 500 as line,
  case event_type when 'error' then 'high' when 'view' then 'medium' else 'info' end as severity, case event_type when 'error' then 'python.eval' when 'view' then 'python.shell-execution' else 'python.process-call' end as rule from {events}
""", "events")
relation("obfuscation_pairs", """
select c.snapshot_id, c.path, c.ord, c.line, c.rule, u.last.symbol as symbol, u.last.line as control_line from {ev_calls} c
join (select snapshot_id, path, max_by(struct(symbol, line), ord) as last from {ev_controls} where severity in ('medium', 'high') group by snapshot_id, path) u on u.snapshot_id = c.snapshot_id and u.path = c.path
where c.severity in ('medium', 'high')
""", "ev_calls", "ev_controls", check="""
select c.snapshot_id, c.path, c.ord, c.line, c.rule, u.symbol, u.line as control_line from {ev_calls} c
join (select *, row_number() over (partition by snapshot_id, path order by ord desc) as k from {ev_controls} where severity in ('medium', 'high')) u on u.k = 1 and u.snapshot_id = c.snapshot_id and u.path = c.path
where c.severity in ('medium', 'high')
""")

# A-17
relation("execution_counts", f"select snapshot_id, count(*) as calls, count_if({severity_rank('severity')} >= 2) as actionable from {{ev_calls}} group by snapshot_id", "ev_calls")

# J-9, A-24
relation("count_reconcile", """
select e.snapshot_id, e.path, e.expected, coalesce(o.observed, 0) as observed from (select snapshot_id, path, cast(max(line) / 10 as bigint) as expected from {ev_findings} where metric <> '' group by snapshot_id, path) e
left join (select snapshot_id, path, count(distinct symbol) as observed from {ev_findings} where metric <> '' group by snapshot_id, path) o on e.snapshot_id = o.snapshot_id and e.path = o.path where e.expected <> coalesce(o.observed, 0)
""", "ev_findings")
relation("duplicate_identities", "select stage_id, identity, count(*) as n from {identities} group by stage_id, identity having count(*) > 1", "identities")

# F-36: a process that ended well with an allowed code has no failure; else missing and timeout stay, the rest failed
relation("ev_runs", """
select event_id, case when event_type = 'click' then 'timeout' when event_type = 'signup' and event_id % 4 = 0 then 'missing' when event_type = 'purchase' and event_id % 5 = 0 then 'output-limit' else 'ok' end as status,
  cast(floor(abs(value)) as bigint) % 4 as returncode, case when event_id % 2 = 0 then array(0) else array(0, 1) end as allowed from {events}
""", "events", check="""
select event_id, case when event_type = 'click' then 'timeout' when event_type = 'signup' and event_id % 4 = 0 then 'missing' when event_type = 'purchase' and event_id % 5 = 0 then 'output-limit' else 'ok' end as status,
  cast(floor(abs(value)) as bigint) % 4 as returncode, case when event_id % 2 = 0 then [0] else [0, 1] end as allowed from {events}
""")
relation("execution_status", """
select event_id, case when status = 'ok' and array_contains(allowed, cast(returncode as int)) then '' when status in ('missing', 'timeout') then status else 'failed' end as failure from {ev_runs}
""", "ev_runs", check="select event_id, case when status = 'ok' and list_contains(allowed, returncode) then '' when status in ('missing', 'timeout') then status else 'failed' end as failure from {ev_runs}")

# A-16, W-7
relation("history_rows", """
select repository, commit_id, count(distinct path) as files, count(*) as functions, bround(avg(cc), 4) as average_cc, max(cc) as max_cc, row_number() over (partition by repository order by commit_id) as seq
from {ev_commits} group by repository, commit_id
""", "ev_commits")
