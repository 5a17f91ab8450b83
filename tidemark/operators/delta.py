"""Delta of two evidence sets: a bag comparison on identity and observation, with location left out.

Rows of both sides are dealt by snapshot, stage and identity once, then counted together by observation (severity, metric,
value and, without a metric, the message), null-safe. Equal observations cancel by multiplicity. What is left of an
identity that occurs once on each side is a change; of a duplicated identity it is ambiguous, added at the head and never
resolved. One more grouping gives a row for each stage with everything the roll-up says, so that each message is made
once and no evidence is read again for it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import blocking_value, finite, identity, number, severity_rank, stage_score
from ..plans.relation import RELATIONS, relation
from ..schema import COMPLEXITY_LIMIT, COMPLEXITY_MEASURES, DUPLICATION_LIMIT, WEIGHTS

relation("identities", f"select *, {identity()} as identity from {{ev_findings}}", "ev_findings")
relation("identity", "select identity, count(*) as observations from {identities} group by identity", "identities")

_SIDED = f"""
select snapshot_id, stage_id, {identity()} as identity, severity, metric, value, case when metric = '' then message else '' end as said, message, rule, path, line, ord, identity_kind, {{b}} as b, {{h}} as h from {{source}}"""
_OBSERVED = f"{_SIDED.format(b=1, h=0, source='{ev_base}')} union all {_SIDED.format(b=0, h=1, source='{ev_head}')}"
# Rows without fingerprint that have one identity have one rule and path, as it is made of them. Of these the last needs no
# ord, the widest column, unless a fingerprint looks like such an identity (taken), or a zero byte lets texts run together.
_MADE = "(not taken and not coalesce(fingerprint <> '', false) and coalesce(locate(char(0), concat(rule, path, symbol, metric, message)) = 0, false))"
_TAKEN = {"taken": "fingerprint rlike '^[0-9a-f]{20}$'"}
_LAST = f"case when not {_MADE} then ord when ord is not null then '' end as last"
_DEALT = _OBSERVED.replace(" as b,", f" as b, {_LAST.replace('taken', '{taken}')},")
# dealt by identity once, with the columns that are asked for: no grouping or join by observation or identity above deals
# again, and none sorts rows before they are dealt; the parts are as many as the rows ask for, so that no task spills
relation("observed_rows", f"select /*+ repartition({{parts}}, snapshot_id, stage_id, identity) */ * from ({_DEALT}) o", "ev_base", "ev_head", check=_OBSERVED.strip(), rows_each=500_000, asks=_TAKEN)

# The rows of identities whose observations, or their kinds, differ between the sides: items and the roll-up ask for no
# others. Each side's identities are digested first: sums over the 64 bits of each observation's hash. Those whose sums differ
# set a bit each in a filter that is broadcast, so that only rows that pass it are dealt. More than differ may pass, if bits are
# few; none that differs is left out. Bits are found by shifts, which are never null: a key that may be null is tested once more
# in the scan, where it costs as much as the rows.
def _hash(*columns: str) -> str:
    """Of the columns' values; a null is skipped by the function, so it is told apart by a flag."""
    return f"xxhash64({', '.join((*columns, *(f'{c} is null' for c in columns)))})"


_KEY = _hash("snapshot_id", "stage_id", "identity")
_DIGEST = f"""
select k, sum(shiftrightunsigned(o, 32)) as s, sum(o & 4294967295L) as t
  from (select /*+ repartition({{parts}}, k) */ {_KEY} as k, {_hash("severity", "metric", "value", "said", "identity_kind")} as o from ({_SIDED}) x) y group by k"""
relation("differing_rows", f"""
with base_digests as ({_DIGEST.format(b=1, h=0, source="{ev_base}", parts="{parts}")}),
head_digests as ({_DIGEST.format(b=0, h=1, source="{ev_head}", parts="{parts}")}),
differing as (select coalesce(b.k, h.k) & ({{slots}} - 1) as slot from base_digests b full outer join head_digests h on b.k = h.k where not (b.s <=> h.s and b.t <=> h.t)),
words as (select shiftright(slot, 12) as chunk, cast(shiftright(slot, 6) & 63 as int) as word, bit_or(shiftleft(1L, cast(slot & 63 as int))) as bits from differing group by 1, 2),
filter_bits as (
  select chunk, transform(sequence(0, 63), i -> coalesce(element_at(bits, i), 0L)) as bits
  from (select chunk, map_from_entries(collect_list(struct(word, bits))) as bits from words group by chunk) w),
placed as (select *, {_KEY} & ({{slots}} - 1) as slot from ({_DEALT}) o)
select /*+ repartition({{parts}}, snapshot_id, stage_id, identity), broadcast(f) */ p.* from placed p join filter_bits f on f.chunk = shiftright(p.slot, 12)
where getbit(f.bits[cast(shiftright(p.slot, 6) & 63 as int)], cast(p.slot & 63 as int)) = 1
""", "ev_base", "ev_head", check="", rows_each=500_000, asks=_TAKEN)

# J-1, W-1: how often each observation occurs on either side; rule and path are those of its last row
_KEYS = "snapshot_id, stage_id, identity, severity, metric, value, said"
_BAG = f"""
select {_KEYS}, sum(b) as b, sum(h) as h, max_by(rule, last) as rule, max_by(path, last) as path, max(identity_kind) as identity_kind
from {{observed_rows}} {{where}} group by {_KEYS}"""
relation("bag", _BAG.replace("{where}", ""), "observed_rows")
relation("body_bag", _BAG.replace("{where}", "where identity_kind = 'body'"), "observed_rows")

# One row for each identity. For a change the rows left on either side are single, so that the maxima are their values.
_BLOCKS = f"(severity = 'critical' or {blocking_value('metric', 'value')})"
_MEASURES = ", ".join(f"max(case when h > 0 and metric = '{m}' and {blocking_value('metric', 'value')} then value end) as head_most_{i}" for i, m in enumerate(COMPLEXITY_MEASURES))
_LEFT = ", ".join(f"max(case when {'b > h' if s == 'base' else 'h > b'} then {c} end) as {s}_{c}" for s in ("base", "head") for c in ("severity", "metric", "value", "path"))
_OUTCOMES = f"""
select snapshot_id, stage_id, identity, max(rule) as rule, sum(b) as base_rows, sum(h) as head_rows, sum(least(b, h)) as unchanged, sum(greatest(b - h, 0)) as base_left, sum(greatest(h - b, 0)) as head_left,
  max(identity_kind) as identity_kind, {_LEFT}, bool_or(h > b and {_BLOCKS}) as head_left_blocks, bool_or(h > 0 and severity = 'critical') as head_critical, {_MEASURES},
  max(case when b > 0 then severity end) as one_severity, max(case when b > 0 then metric end) as one_metric, max(case when b > 0 then value end) as one_value
from {{bag}} group by snapshot_id, stage_id, identity"""
relation("identity_outcomes", _OUTCOMES, "bag")
relation("body_outcomes", _OUTCOMES.replace("{bag}", "{body_bag}"), "body_bag")

# F-37
_DUPLICATE = "(base_rows > 1 or head_rows > 1)"
_CHANGE = f"(not {_DUPLICATE} and base_left > 0 and head_left > 0)"
_DIFFERENCE = "(case when base_metric <> '' and base_metric = head_metric then head_value - base_value end)"
_DIRECTION = f"""case when base_severity <> head_severity then case when {severity_rank("head_severity")} > {severity_rank("base_severity")} then 'worsened' else 'improved' end
      when {_DIFFERENCE} > 0 then 'worsened' when {_DIFFERENCE} < 0 then 'improved' else 'changed' end"""
_MATCH = f"""
select snapshot_id, stage_id, identity, rule, unchanged, {_DUPLICATE} and base_left + head_left > 0 as ambiguous, case when {_CHANGE} then 0 else head_left end as added,
  case when {_DUPLICATE} or {_CHANGE} then 0 else base_left end as resolved, case when {_CHANGE} then 1 else 0 end as changed,
  case when {_CHANGE} then bround({_DIFFERENCE}, 4) end as delta, case when {_CHANGE} then {_DIRECTION} end as direction{{more}}
from {{outcomes}}"""
relation("delta_match", _MATCH.replace("{more}", "").replace("{outcomes}", "{identity_outcomes}"), "identity_outcomes")

# J-3: NULL without a map or a location; else whether an interval of the path's array holds the line
relation("path_intervals", "select path, array_agg(struct(start_line, end_line)) as intervals from {ev_changed_lines} group by path", "ev_changed_lines", check="")
relation("changed_line_join", """
select f.snapshot_id, f.stage_id, f.ord, f.path, f.line,
  case when f.path = '' or f.line < 1 then null else coalesce(exists(c.intervals, x -> f.line between x.start_line and x.end_line), false) end as in_changed_lines
from {ev_head} f left join {path_intervals} c on f.path = c.path
""", "ev_head", "path_intervals")

# J-4: both reports of a stage, why they can't be compared, and what is known of the stage's own measurements
_GAP = f"(required and (status <> 'ok' or (category in ({', '.join(repr(c) for c in WEIGHTS)}) and stage_id <> 'inventory' and {stage_score('0')} is null)))"
_PLAIN = ("status", "required", "category", "profile", "tool", "version", "scope", "license_file")
_METRICS = ("issue_count", "error_count", "warning_count", "max_cc", "duplication_percent")
for _side in ("base", "head"):
    relation(f"{_side}_reports", f"""
select snapshot_id, stage_id, {", ".join(_PLAIN)}, {_GAP} as gap, {", ".join(f"{number(m)} as {m}" for m in _METRICS)} from {{ev_{_side}_stages}}
""", f"ev_{_side}_stages")
relation("report_pairs", f"""
select coalesce(b.snapshot_id, h.snapshot_id) as snapshot_id, coalesce(b.stage_id, h.stage_id) as stage_id, b.stage_id is not null as in_base, h.stage_id is not null as in_head,
  {", ".join(f"{s[0]}.{c} as {s}_{c}" for s in ("base", "head") for c in (*_PLAIN, "gap", *_METRICS))},
  case when b.profile <> h.profile then 'Comparison requires the same analysis profile.'
    when b.stage_id is null or h.stage_id is null or b.status <> 'ok' or h.status <> 'ok' then 'Resolution requires complete observations on both sides.'
    when b.tool <> h.tool or b.version <> h.version then 'Resolution requires observations from the same tool and version.'
    when b.scope <> h.scope or b.category <> h.category then 'Resolution requires observations of the same analysis scope and category.' else '' end as note,
  coalesce(b.profile = h.profile and b.status in ('ok', 'limited') and h.status in ('ok', 'limited') and b.tool = h.tool and b.version = h.version and b.scope = h.scope and b.category = h.category, false) as alike
from {{base_reports}} b full outer join {{head_reports}} h on b.snapshot_id = h.snapshot_id and b.stage_id = h.stage_id
""", "base_reports", "head_reports")
relation("stage_pairs", """
select snapshot_id, stage_id, coalesce(base_status, 'absent') as base_status, coalesce(head_status, 'absent') as head_status, coalesce(base_required, false) or coalesce(head_required, false) as required, note
from {report_pairs}
""", "report_pairs")

# J-5
relation("metric_deltas", f"""
select snapshot_id, stage_id, m.metric as metric, m.base as base, m.head as head, bround(m.head - m.base, 4) as delta
from (select snapshot_id, stage_id, explode(array({", ".join(f"named_struct('metric', '{m}', 'base', base_{m}, 'head', head_{m})" for m in _METRICS)})) as m from {{report_pairs}} where note = '') t
where m.base is not null and m.head is not null
""", "report_pairs")

# J-14: bodies that replace others of the same rule, path and metric
relation("uncertain_identities", f"""
select distinct x.snapshot_id, x.stage_id, x.identity from {{body_outcomes}} x
join (select distinct snapshot_id, stage_id, rule, base_path as path, base_metric as metric from {{body_outcomes}} where base_left > 0 and not {_DUPLICATE} and not {_CHANGE}) y
  on x.snapshot_id = y.snapshot_id and x.stage_id = y.stage_id and x.rule = y.rule and x.head_path = y.path and x.head_metric = y.metric
where x.head_left > 0 and not ((x.base_rows <= 1 and x.head_rows <= 1) and x.base_left > 0 and x.head_left > 0)
""", "body_outcomes")

# J-12: the head has more blocking values, or at some rank in falling order a larger one. Values are counted first, so
# that the window orders distinct values only: the rank is that of the largest value which the head reaches more often.
relation("blocking_counts", f"""
select snapshot_id, stage_id, metric, value, sum(b) as b, sum(h) as h from {{bag}} where {blocking_value("metric", "value")} group by snapshot_id, stage_id, metric, value
""", "bag")
relation("rank_dominance", """
select snapshot_id, stage_id, metric, sum(h) as head_blocking, sum(b) as base_blocking, case when sum(h) > sum(b) then 'more' when bool_or(upto_h > upto_b) then 'larger' else 'none' end as outcome,
  case when sum(h) <= sum(b) then min(case when upto_h > upto_b then upto_b + 1 end) end as first_rank
from (select *, sum(b) over w as upto_b, sum(h) over w as upto_h from {blocking_counts} window w as (partition by snapshot_id, stage_id, metric order by value desc)) t
group by snapshot_id, stage_id, metric having sum(h) > 0
""", "blocking_counts")

# J-13: which head rows prove a worsening although coverage is partial
_WORSE = " or ".join(f"(one_metric = '{m}' and head_most_{i} > one_value and {finite('one_value')})" for i, m in enumerate(COMPLEXITY_MEASURES))
_UNIQUE = f"(base_rows = 1 and ({_WORSE} or (head_critical and one_severity <> 'critical')))"
_NEW = f"(base_rows = 0 and (head_critical or {' or '.join(f'head_most_{i} is not null' for i in range(len(COMPLEXITY_MEASURES)))}))"
relation("known_outcomes", f"""
select d.*, u.identity is not null as uncertain, not d.ambiguous and u.identity is null as certain
from ({_MATCH.replace("{more}", f", head_left_blocks, {_UNIQUE} as unique_worse, {_NEW} as new_blocks, coalesce(({blocking_value('head_metric', 'head_value')} and {_DIFFERENCE} > 0) or (head_severity = 'critical' and base_severity <> 'critical'), false) as change_blocks, coalesce(head_severity, base_severity) as shown_severity").replace("{outcomes}", "{identity_outcomes}")}) d
left join {{uncertain_identities}} u on u.snapshot_id = d.snapshot_id and u.stage_id = d.stage_id and u.identity = d.identity
""", "identity_outcomes", "uncertain_identities")
relation("limited_regressions", """
select k.snapshot_id, k.stage_id, k.identity, k.rule, k.new_blocks from {known_outcomes} k join {report_pairs} p on p.snapshot_id = k.snapshot_id and p.stage_id = k.stage_id
where p.note <> '' and p.alike and k.certain and (k.unique_worse or (k.new_blocks and p.base_status = 'ok'))
""", "known_outcomes", "report_pairs")

# A-22
_HIGHER = f"((head_category = 'complexity' and head_max_cc > base_max_cc and head_max_cc > {COMPLEXITY_LIMIT}) or (head_category = 'duplication' and head_duplication_percent > base_duplication_percent and head_duplication_percent > {DUPLICATION_LIMIT}))"
relation("metric_regressions", f"""
select snapshot_id, stage_id, case head_category when 'complexity' then 'max_cc' when 'duplication' then 'duplication_percent' else 'license_file' end as metric,
  case head_category when 'complexity' then base_max_cc when 'duplication' then base_duplication_percent else cast(1 as double) end as base,
  case head_category when 'complexity' then head_max_cc when 'duplication' then head_duplication_percent else cast(0 as double) end as head
from {{report_pairs}} where note = '' and ({_HIGHER} or (head_category = 'hygiene' and base_license_file and not head_license_file))
""", "report_pairs")

# Everything that findings say of a stage, one row each; rules are few
_RULES = {
    "new_rules": "added > 0 and certain and head_left_blocks", "worse_rules": "changed = 1 and change_blocks", "unique_rules": "certain and unique_worse", "open_rules": "certain and new_blocks",
    "worsened_rules": "direction = 'worsened'", "improved_rules": "direction = 'improved'",
}
relation("stage_outcomes", f"""
select snapshot_id, stage_id, sum(added) as added, sum(resolved) as resolved, sum(changed) as changed, sum(unchanged) as unchanged, count_if(ambiguous) as ambiguous, count_if(uncertain) as uncertain,
  count_if(direction = 'worsened') as worsened, count_if(direction = 'improved') as improved, {", ".join(f"collect_set(case when {c} then rule end) as {k}" for k, c in _RULES.items())}
from {{known_outcomes}} group by snapshot_id, stage_id
""", "known_outcomes")
relation("critical_counts", "select snapshot_id, stage_id, sum(b) as base_critical, sum(h) as head_critical from {bag} where severity = 'critical' group by snapshot_id, stage_id having sum(h) > sum(b)", "bag")
relation("stage_deltas", """
select p.*, coalesce(o.added, 0) as added, coalesce(o.resolved, 0) as resolved, coalesce(o.changed, 0) as changed, coalesce(o.unchanged, 0) as unchanged, coalesce(o.ambiguous, 0) as ambiguous,
  coalesce(o.uncertain, 0) as uncertain, coalesce(o.worsened, 0) as worsened, coalesce(o.improved, 0) as improved, o.stage_id is not null as observed,
  o.new_rules, o.worse_rules, o.unique_rules, o.open_rules, o.worsened_rules, o.improved_rules, c.base_critical, c.head_critical, r.measures
from {report_pairs} p
left join {stage_outcomes} o on p.snapshot_id = o.snapshot_id and p.stage_id = o.stage_id
left join {critical_counts} c on p.snapshot_id = c.snapshot_id and p.stage_id = c.stage_id
left join (select snapshot_id, stage_id, collect_set(metric || case when outcome = 'more' then ' blocks more often' else ' blocks higher at rank ' || cast(first_rank as string) end) as measures
  from {rank_dominance} where outcome <> 'none' group by snapshot_id, stage_id) r on p.snapshot_id = r.snapshot_id and p.stage_id = r.stage_id
""", "report_pairs", "stage_outcomes", "critical_counts", "rank_dominance")

# The same without identities that don't differ, of which the roll-up says nothing: they are neither dealt nor counted.
_ALIKE = {"observed_rows": "differing_rows"} | {n: f"differing_{n}" for n in ("bag", "body_bag", "identity_outcomes", "body_outcomes", "uncertain_identities", "known_outcomes", "stage_outcomes", "stage_deltas")}
for _name, _new in list(_ALIKE.items())[1:]:
    _r = RELATIONS[_name]
    _of = {n: n if n in ("critical_counts", "rank_dominance") else _ALIKE.get(n, n) for n in _r.inputs}
    relation(_new, _r.sql.format(**{n: f"{{{_of[n]}}}" for n in _of}), *_of.values())

# A-21; if the stage isn't comparable, nothing is resolved and changes count as added
relation("delta_counts", """
select snapshot_id, stage_id, case when note = '' then added else added + changed end as added, case when note = '' then resolved else 0 end as resolved, case when note = '' then changed else 0 end as changed,
  unchanged, ambiguous, case when note = '' then worsened else 0 end as worsened, case when note = '' then improved else 0 end as improved
from {stage_deltas} where observed
""", "stage_deltas")

# A-20: the messages of a stage, then one row for each snapshot
def _say(kind: str, when: str, text: str, weighs: str = "false") -> str:
    return f"array(case when {when} then named_struct('kind', '{kind}', 'message', stage_id || ': ' || {text}, 'weighs', {weighs}) end)"


def _each(kind: str, when: str, items: str, text: str) -> str:
    """text before each of the items."""
    return f"transform(case when {when} then coalesce({items}, cast(array() as array<string>)) else cast(array() as array<string>) end, x -> named_struct('kind', '{kind}', 'message', stage_id || ': {text} ' || x, 'weighs', false))"


_SAME, _PART = "note = ''", "(note <> '' and alike)"
_SURPLUS = f"(({_SAME} or {_PART}) and base_status = 'ok')"
_MOVED = "cast(array({}) as array<string>)".format(", ".join(f"case when bround(head_{m} - base_{m}, 4) {{sign}} 0 then '{m}' end" for m in _METRICS))
_MESSAGES = [
    _say("unknown", "note <> ''", "note", "coalesce(base_required, false) or coalesce(head_required, false)"),
    _say("unknown", f"{_SAME} and ambiguous > 0", "'duplicate identities can not be paired'", "true"),
    _say("unknown", f"{_SAME} and uncertain > 0", "'replaced bodies leave continuity open'", "true"),
    _each("blocker", _SAME, "new_rules", "new blocking"), _each("blocker", _SAME, "worse_rules", "worse blocking"),
    _each("blocker", _PART, "unique_rules", "proven worse"), _each("blocker", f"{_PART} and base_status = 'ok'", "open_rules", "proven worse"),
    _say("blocker", f"{_SURPLUS} and head_critical > base_critical", "'critical observations rose from ' || cast(base_critical as string) || ' to ' || cast(head_critical as string)"),
    _each("blocker", _SURPLUS, "measures", "measure"),
    _say("blocker", f"({_SAME} or ({_SURPLUS} and head_category = 'complexity')) and {_HIGHER}", "'its maximum rose beyond the limit'"),
    _say("blocker", f"{_SAME} and head_category = 'hygiene' and base_license_file and not head_license_file", "'the license file is gone'"),
    _say("regression", f"{_SAME} and added > 0", "cast(added as string) || ' added'"), _each("regression", _SAME, "worsened_rules", "worsened"),
    _each("regression", _SAME, f"filter({_MOVED.format(sign='>')}, x -> x is not null)", "raised"), _each("improvement", _SAME, f"filter({_MOVED.format(sign='<')}, x -> x is not null)", "lowered"),
    _say("improvement", f"{_SAME} and resolved > 0", "cast(resolved as string) || ' resolved'"), _each("improvement", _SAME, "improved_rules", "improved"),
    _say("improvement", f"{_SAME} and not base_license_file and head_license_file", "'the license file is there'"),
]
relation("stage_messages", f"""
select *, exists(said, x -> x.kind in ('blocker', 'regression', 'improvement')) as moved
from (select snapshot_id, stage_id, note, coalesce(base_gap, false) or coalesce(head_gap, false) as gap, coalesce(base_required, false) as base_required, coalesce(head_required, false) as head_required,
    array_distinct(filter(concat({", ".join(_MESSAGES)}), x -> x is not null)) as said from {{differing_stage_deltas}}) t
""", "differing_stage_deltas")
_KIND = "size(filter(said, x -> x.kind {}))"
# messages name their stage, so a stage's distinct messages add up to the snapshot's
relation("delta_assessment", f"""
select snapshot_id, blockers, regressions, improvements, unknown, unchanged, complete,
  case when blockers > 0 then 'hold' when not complete then 'unknown' when regressions > 0 then 'review' else 'no_configured_regressions' end as decision
from (select snapshot_id, cast(sum({_KIND.format("= 'blocker'")}) as bigint) as blockers, cast(sum({_KIND.format("in ('blocker', 'regression')")}) as bigint) as regressions,
    cast(sum({_KIND.format("= 'improvement'")}) as bigint) as improvements, cast(sum({_KIND.format("= 'unknown'")}) as bigint) as unknown,
    count_if(note = '' and not moved) as unchanged,
    bool_or(base_required) and bool_or(head_required) and not bool_or(gap) and not bool_or(exists(said, x -> x.weighs)) as complete
  from {{stage_messages}} group by snapshot_id) kinds
""", "stage_messages")

# F-8 of a comparison: known regressions, then the head's own gates where they are set, then incompleteness
relation("comparison_exit", """
select d.snapshot_id, case when d.blockers > 0 then 1 when not d.complete then 3 else 0 end as exit_code, case when d.blockers > 0 then 1 when h.exit_code <> 0 then h.exit_code when not d.complete then 3 else 0 end as gated_exit_code
from {delta_assessment} d left join {head_exit_code} h on h.snapshot_id = d.snapshot_id
""", "delta_assessment", "head_exit_code")

# K-3: the comparison document of a stage, as columns
relation("delta_document", f"""
select snapshot_id, stage_id, coalesce(base_status, 'absent') as base_status, coalesce(head_status, 'absent') as head_status, note = '' as comparable,
  note || case when ambiguous > 0 then ' Duplicate identities with unmatched observations remain ambiguous; their resolutions are unconfirmed.' else '' end
    || case when uncertain > 0 then ' Changed anonymous bodies remain unmatched; function continuity is unknown.' else '' end as resolution_note,
  case when note = '' then added else added + changed end as added, case when note = '' then resolved else 0 end as resolved, case when note = '' then changed else 0 end as changed, unchanged, ambiguous, uncertain,
  cast(case when note = '' then {" + ".join(f"case when base_{m} is not null and head_{m} is not null then 1 else 0 end" for m in _METRICS)} else 0 end as bigint) as metrics
from {{stage_deltas}}
""", "stage_deltas")

# K-3: the comparison's own rows. Of an observation that one side has more often, the later rows are those left over; a
# change is one row with both sides. Without comparable reports nothing is resolved, and a change is an addition. Rows are
# dealt by identity once and sorted by observation; what is said of an observation or an identity are windows of that order.
# Rows of the base that can't be items are dropped before reports are joined. Lines are joined by a path that no item lacks.
relation("base_intervals", "select path, array_agg(struct(start_line, end_line)) as intervals from {ev_base_lines} group by path", "ev_base_lines", check="")
_SHOWN = ("ord", "rule", "severity", "path", "line", "message", "value")
_IN_LINES = "case when {0} is null or {0}.path = '' or {0}.line < 1 then null else coalesce(exists({1}.intervals, x -> {0}.line between x.start_line and x.end_line), false) end"
_SIDE = f"named_struct({', '.join(f"'{c}', {c}" for c in (*_SHOWN, 'metric'))})"
_SINGLE, _CHANGED_BY = (re.sub(r"\bhead_(?=severity|metric|value)", "own.", re.sub(r"\bbase_(?=severity|metric|value)", "base.", x)) for x in (_DIRECTION, _DIFFERENCE))
relation("delta_items", f"""
with counted as (
  select *, row_number() over (partition by {_KEYS} order by h, ord) as nth, sum(b) over (partition by {_KEYS}) as b_each, sum(h) over (partition by {_KEYS}) as h_each,
    sum(b) over (partition by snapshot_id, stage_id, identity) as base_rows, sum(h) over (partition by snapshot_id, stage_id, identity) as head_rows from {{differing_rows}}),
left_over as (
  select snapshot_id, stage_id, identity, {_DUPLICATE} as ambiguous, h = 1 as in_head, {_SIDE} as own
  from counted where identity is not null and case when h = 1 then nth - b_each > b_each else nth > h_each end),
sided as (
  select *, max(case when not in_head then own end) over (partition by snapshot_id, stage_id, identity) as base, bool_or(in_head) over (partition by snapshot_id, stage_id, identity) as at_head from left_over),
paired as (
  select snapshot_id, stage_id, identity, in_head, own, case when in_head and not ambiguous then base end as base from sided where in_head or not (ambiguous or at_head)),
judged as (
  select l.*, p.note = '' and l.in_head and l.base is not null as change
  from paired l join {{report_pairs}} p on p.snapshot_id = l.snapshot_id and p.stage_id = l.stage_id
  where l.in_head or p.note = ''),
items as (
  select snapshot_id, stage_id, identity, case when change then 'changed' when in_head then 'added' else 'resolved' end as outcome, case when change then {_SINGLE} end as direction,
    case when change then bround({_CHANGED_BY}, 4) end as delta, case when in_head then own end as h, case when not in_head then own when change then base end as b from judged),
heads as (select i.*, {_IN_LINES.format("i.h", "c")} as in_changed_lines from items i left join {{path_intervals}} c on c.path = case when i.h is null then i.b.path else i.h.path end)
select i.snapshot_id, i.stage_id, i.identity, i.outcome, i.direction, i.delta, {", ".join(f"i.h.{c} as {c}" for c in _SHOWN)}, i.in_changed_lines, {", ".join(f"i.b.{c} as base_{c}" for c in _SHOWN)},
  {_IN_LINES.format("i.b", "c")} as base_in_changed_lines
from heads i left join {{base_intervals}} c on c.path = case when i.b is null then i.h.path else i.b.path end
""", "differing_rows", "report_pairs", "path_intervals", "base_intervals")

# T-5: placed within their stage
relation("delta_rows", f"""
select snapshot_id, stage_id, rule, identity, case when changed = 1 then coalesce(direction, 'changed') when added > 0 then 'added' else 'resolved' end as outcome,
  row_number() over (partition by snapshot_id, stage_id order by {severity_rank("shown_severity")} desc, rule, identity) as place
from {{known_outcomes}} where added + resolved + changed > 0
""", "known_outcomes")

# U-4
_OBS = "snapshot_id, stage_id, identity, severity, metric, value, said"
relation("observation_except_all", f"""
select snapshot_id, stage_id, count(*) as only_in_head from (select {_OBS} from {{observed_rows}} where h = 1 except all select {_OBS} from {{observed_rows}} where b = 1) t group by snapshot_id, stage_id
""", "observed_rows")


def _own(rows: DataFrame) -> DataFrame:
    """Without a snapshot_id all rows are one comparison."""
    return rows if "snapshot_id" in rows.columns else rows.withColumn("snapshot_id", F.lit(""))


def _sides(base: DataFrame, head: DataFrame) -> dict[str, DataFrame]:
    return {"ev_base": _own(base), "ev_head": _own(head)}


def match(base: DataFrame, head: DataFrame) -> DataFrame:
    """One row for each stage and identity of two sets of findings: what became of it."""
    return RELATIONS["delta_match"].frame(base.sparkSession, "", _sides(base, head))


def compare(base_stages: DataFrame, base: DataFrame, head_stages: DataFrame, head: DataFrame, name: str = "delta_assessment") -> DataFrame:
    """The roll-up of two reports of each snapshot (or another relation of it by name). Stages have a profile."""
    given = {**_sides(base, head), "ev_base_stages": base_stages, "ev_head_stages": head_stages}
    return RELATIONS[name].frame(base.sparkSession, "", given)


def in_changed_lines(findings: DataFrame, changed_lines: DataFrame | None) -> DataFrame:
    """Three-valued: without a map the answer is NULL; an empty map says false."""
    findings = _own(findings)
    if changed_lines is None:
        return findings.selectExpr("snapshot_id", "stage_id", "ord", "path", "line", "cast(null as boolean) as in_changed_lines")
    return RELATIONS["changed_line_join"].frame(findings.sparkSession, "", {"ev_head": findings, "ev_changed_lines": changed_lines})


def rank_dominance(base: DataFrame, head: DataFrame) -> DataFrame:
    return RELATIONS["rank_dominance"].frame(base.sparkSession, "", _sides(base, head))
