"""Check statements written by hand from the rules' text, row by row, apart from the plans that they check."""

from __future__ import annotations

from ..operators import documents, enclosing, messages, token_rules, working
from .relation import RELATIONS

# Fixed values of score policy 1.1.0 and comparison policy 1.0.0, spelt out again.
_SCORED = "('lint', 'types', 'complexity', 'duplication', 'security', 'hygiene')"
_VALID = "({0} IS NOT NULL AND NOT isnan({0}) AND {0} >= 0 AND {0} < 'infinity'::DOUBLE)"
_STEPS = {
    "lint": [(0, 100), (5, 90), (20, 75), (50, 60), (100, 40)], "errors": [(0, 100), (3, 90), (10, 75), (30, 50), (100, 25)],
    "complexity": [(10, 100), (20, 85), (30, 70), (40, 50), (50, 30)], "duplication": [(5, 100), (10, 90), (20, 75), (40, 55), (60, 30)],
}


def _steps(column: str, name: str) -> str:
    return f"CASE WHEN {_VALID.format(column)} THEN CASE {' '.join(f'WHEN {column} <= {c} THEN {s}' for c, s in _STEPS[name])} ELSE 0 END END"


def _score(penalties: str) -> str:
    return f"""CASE WHEN status <> 'ok' THEN NULL WHEN category = 'lint' THEN {_steps("issue_count", "lint")}
  WHEN category = 'types' THEN CASE WHEN {_steps("error_count", "errors")} < {_steps("warning_count", "lint")} THEN {_steps("error_count", "errors")} WHEN {_steps("error_count", "errors")} IS NOT NULL THEN {_steps("warning_count", "lint")} END
  WHEN category = 'complexity' THEN {_steps("max_cc", "complexity")} WHEN category = 'duplication' THEN {_steps("duplication_percent", "duplication")}
  WHEN category = 'security' THEN CASE WHEN {penalties} > 100 THEN 0 ELSE 100 - {penalties} END
  WHEN category = 'hygiene' THEN 25 * (license_file::INT + nontrivial_readme::INT + test_files::INT + gitignore_file::INT) END"""


def assessed(stages: str, findings: str, p: str) -> str:
    """CTEs {p}score, {p}block, {p}whole and {p}exit of one set of reports."""
    return f"""
{p}pen AS (SELECT s.snapshot_id, s.stage_id, sum(CASE f.severity WHEN 'low' THEN 2 WHEN 'medium' THEN 8 WHEN 'high' THEN 25 WHEN 'critical' THEN 100 ELSE 0 END) AS pen
  FROM {stages} s JOIN {findings} f USING (snapshot_id, stage_id) GROUP BY ALL),
{p}score AS (SELECT s.*, ({_score("coalesce(pen, 0)")})::BIGINT AS score FROM {stages} s LEFT JOIN {p}pen USING (snapshot_id, stage_id)),
{p}cat AS (SELECT snapshot_id, category, CASE WHEN bool_and(score IS NOT NULL) THEN min(score) END AS score FROM {p}score WHERE required AND stage_id <> 'inventory' AND category IN {_SCORED} GROUP BY ALL),
{p}gap AS (SELECT snapshot_id, stage_id, status, reason FROM {p}score WHERE required AND (status <> 'ok' OR (category IN {_SCORED} AND stage_id <> 'inventory' AND score IS NULL))),
{p}block AS (
  SELECT snapshot_id, stage_id || ': a function exceeds 50 cyclomatic complexity' AS reason FROM {stages} WHERE category = 'complexity' AND {_VALID.format("max_cc")} AND max_cc > 50
  UNION SELECT snapshot_id, stage_id || ': duplication exceeds 60%' FROM {stages} WHERE category = 'duplication' AND {_VALID.format("duplication_percent")} AND duplication_percent > 60
  UNION SELECT snapshot_id, stage_id || ': no license file observed; adoption terms need review' FROM {stages} WHERE category = 'hygiene' AND license_file IS FALSE
  UNION SELECT f.snapshot_id, f.stage_id || ': ' || f.rule || ' (' || f.path || ':' || f.line || ')' FROM {findings} f SEMI JOIN {stages} s USING (snapshot_id, stage_id) WHERE f.severity = 'critical'),
{p}whole AS (SELECT n.snapshot_id, n.required_stages, n.required_stages - n.gaps AS completed_stages, n.required_stages > 0 AND n.gaps = 0 AS complete, n.blockers,
    CASE WHEN n.required_stages > 0 AND n.gaps = 0 THEN (SELECT round_even(sum(c.score * CASE c.category WHEN 'lint' THEN 15 WHEN 'duplication' THEN 15 WHEN 'hygiene' THEN 10 ELSE 20 END)::DOUBLE
      / sum(CASE c.category WHEN 'lint' THEN 15 WHEN 'duplication' THEN 15 WHEN 'hygiene' THEN 10 ELSE 20 END), 2) FROM {p}cat c WHERE c.snapshot_id = n.snapshot_id) END AS strict
  FROM (SELECT s.snapshot_id, count(*) FILTER (s.required) AS required_stages, (SELECT count(*) FROM {p}gap g WHERE g.snapshot_id = s.snapshot_id) AS gaps,
    (SELECT count(*) FROM {p}block k WHERE k.snapshot_id = s.snapshot_id) AS blockers FROM {p}score s GROUP BY s.snapshot_id) n),
{p}result AS (SELECT *, CASE WHEN strict IS NOT NULL AND blockers > 0 AND strict > 20 THEN 20.0::DOUBLE ELSE strict END AS score FROM {p}whole),
{p}exit AS (SELECT r.snapshot_id, CASE WHEN r.blockers > 0 OR r.score < 60 OR EXISTS (FROM {findings} f WHERE f.snapshot_id = r.snapshot_id AND f.severity IN ('high', 'critical')) THEN 1
  WHEN NOT r.complete THEN 3 ELSE 0 END AS exit_code FROM {p}result r)"""


_BLOCKING = "({0}metric IN ('cyclomatic_complexity', 'shell-ast-decision-complexity-v1') AND {0}value > 50 AND NOT isnan({0}value) AND {0}value < 'infinity'::DOUBLE)"
_RANK = "list_position(['info', 'low', 'medium', 'high', 'critical'], {0})"
_K = ("snapshot_id", "stage_id", "id", "severity", "metric", "value", "said")
_named = lambda t: f"""SELECT *, CASE WHEN fingerprint <> '' THEN fingerprint ELSE sha256(concat_ws(chr(0), rule, path, symbol, CASE WHEN metric = '' THEN message ELSE metric END))[:20] END AS id,
  CASE WHEN metric = '' THEN message ELSE '' END AS said FROM {t}"""  # noqa: E731
_numbered = lambda t: f"SELECT *, row_number() OVER (PARTITION BY {', '.join(_K)} ORDER BY ord) AS occ, count(*) OVER (PARTITION BY snapshot_id, stage_id, id) AS n FROM ({_named(t)})"

#: Row-wise matching: each base row takes the head row with an equal observation and the same number.
MATCHED = f"""
b AS ({_numbered("ev_base")}), h AS ({_numbered("ev_head")}),
j AS (SELECT coalesce(b.snapshot_id, h.snapshot_id) AS snapshot_id, coalesce(b.stage_id, h.stage_id) AS stage_id, coalesce(b.id, h.id) AS id, b.id IS NOT NULL AS in_b, h.id IS NOT NULL AS in_h,
  b.rule AS b_rule, h.rule AS h_rule, b.path AS b_path, h.path AS h_path, b.severity AS b_severity, h.severity AS h_severity, b.metric AS b_metric, h.metric AS h_metric, b.value AS b_value, h.value AS h_value,
  b.identity_kind AS b_kind, h.identity_kind AS h_kind FROM b FULL JOIN h ON {" AND ".join(f"b.{k} IS NOT DISTINCT FROM h.{k}" for k in (*_K, "occ"))}),
size AS (SELECT snapshot_id, stage_id, id, max(n) > 1 AS twice FROM (SELECT snapshot_id, stage_id, id, n FROM b UNION ALL SELECT snapshot_id, stage_id, id, n FROM h) GROUP BY ALL),
tally AS (SELECT snapshot_id, stage_id, id, twice, count(*) FILTER (in_b AND in_h) AS same, count(*) FILTER (NOT in_h) AS gone, count(*) FILTER (NOT in_b) AS fresh, max(coalesce(h_rule, b_rule)) AS rule, max(b_severity) FILTER (NOT in_h) AS b_severity, max(h_severity) FILTER (NOT in_b) AS h_severity, max(b_metric) FILTER (NOT in_h) AS b_metric,
  max(h_metric) FILTER (NOT in_b) AS h_metric, max(b_value) FILTER (NOT in_h) AS b_value, max(h_value) FILTER (NOT in_b) AS h_value
  FROM j JOIN size USING (snapshot_id, stage_id, id) GROUP BY ALL),
fate AS (SELECT *, NOT twice AND gone > 0 AND fresh > 0 AS change, twice AND gone + fresh > 0 AS unsure, CASE WHEN b_metric <> '' AND b_metric = h_metric THEN h_value - b_value END AS diff FROM tally),
turn AS (SELECT *, CASE WHEN change THEN CASE WHEN {_RANK.format("h_severity")} > {_RANK.format("b_severity")} THEN 'worsened' WHEN {_RANK.format("h_severity")} < {_RANK.format("b_severity")} THEN 'improved'
  WHEN diff > 0 THEN 'worsened' WHEN diff < 0 THEN 'improved' ELSE 'changed' END END AS direction FROM fate),
added AS (SELECT j.*, f.unsure FROM j JOIN fate f USING (snapshot_id, stage_id, id) WHERE NOT j.in_b AND NOT f.change),
resolved AS (SELECT j.* FROM j JOIN fate f USING (snapshot_id, stage_id, id) WHERE NOT j.in_h AND NOT f.change AND NOT f.twice),
replaced AS (SELECT DISTINCT a.snapshot_id, a.stage_id, a.id FROM added a JOIN resolved r ON a.snapshot_id = r.snapshot_id AND a.stage_id = r.stage_id AND a.h_rule = r.b_rule AND a.h_path = r.b_path AND a.h_metric = r.b_metric
  WHERE a.h_kind = 'body' AND r.b_kind = 'body')"""

_SHOWN = ("ord", "rule", "severity", "path", "line", "message", "value")
#: Rows of one side that no equal row of the other side answers, and whether a changed line holds them.
ITEMS = ", ".join(
    f"""lone_{x} AS (SELECT m.*, CASE WHEN m.path <> '' AND m.line >= 1 THEN EXISTS (FROM {lines} c WHERE c.path = m.path AND m.line BETWEEN c.start_line AND c.end_line) END AS inside
  FROM {x} m WHERE NOT EXISTS (FROM {y} o WHERE {" AND ".join(f"o.{k} IS NOT DISTINCT FROM m.{k}" for k in (*_K, "occ"))}))"""
    for x, y, lines in (("b", "h", "ev_base_lines"), ("h", "b", "ev_changed_lines"))
)

PAIRED = f"""
pair AS (SELECT coalesce(b.snapshot_id, h.snapshot_id) AS snapshot_id, coalesce(b.stage_id, h.stage_id) AS stage_id, coalesce(b.status, 'absent') AS base_status, coalesce(h.status, 'absent') AS head_status,
  coalesce(b.required, false) OR coalesce(h.required, false) AS required,
  CASE WHEN b.profile IS NOT NULL AND h.profile IS NOT NULL AND b.profile <> h.profile THEN 'Comparison requires the same analysis profile.'
    WHEN NOT (coalesce(b.status, 'absent') = 'ok' AND coalesce(h.status, 'absent') = 'ok') THEN 'Resolution requires complete observations on both sides.'
    WHEN (b.tool, b.version) <> (h.tool, h.version) THEN 'Resolution requires observations from the same tool and version.'
    WHEN (b.scope, b.category) <> (h.scope, h.category) THEN 'Resolution requires observations of the same analysis scope and category.' ELSE '' END AS note,
  b.status IN ('ok', 'limited') AND h.status IN ('ok', 'limited') AND (b.tool, b.version, b.scope, b.category, b.profile) = (h.tool, h.version, h.scope, h.category, h.profile) AS alike,
  h.category AS category, b.license_file AS b_license, h.license_file AS h_license
  FROM ev_base_stages b FULL JOIN ev_head_stages h ON b.snapshot_id = h.snapshot_id AND b.stage_id = h.stage_id),
long AS (FROM (SELECT 'b' AS side, snapshot_id, stage_id, issue_count, error_count, warning_count, max_cc, duplication_percent FROM ev_base_stages
  UNION ALL SELECT 'h', snapshot_id, stage_id, issue_count, error_count, warning_count, max_cc, duplication_percent FROM ev_head_stages) UNPIVOT (v FOR metric IN (issue_count, error_count, warning_count, max_cc, duplication_percent))),
measured AS (SELECT b.snapshot_id, b.stage_id, b.metric, b.v AS base, h.v AS head FROM long b JOIN long h ON b.side = 'b' AND h.side = 'h' AND b.snapshot_id = h.snapshot_id AND b.stage_id = h.stage_id AND b.metric = h.metric
  WHERE {_VALID.format("b.v")} AND {_VALID.format("h.v")}),
higher AS (SELECT p.snapshot_id, p.stage_id, m.metric, m.base, m.head FROM pair p JOIN measured m USING (snapshot_id, stage_id)
  WHERE m.head > m.base AND ((p.category = 'complexity' AND m.metric = 'max_cc' AND m.head > 50) OR (p.category = 'duplication' AND m.metric = 'duplication_percent' AND m.head > 60)))"""

RANKED = f"""
rb AS (SELECT snapshot_id, stage_id, metric, value, row_number() OVER (PARTITION BY snapshot_id, stage_id, metric ORDER BY value DESC) AS r FROM ev_base WHERE {_BLOCKING.format("")}),
rh AS (SELECT snapshot_id, stage_id, metric, value, row_number() OVER (PARTITION BY snapshot_id, stage_id, metric ORDER BY value DESC) AS r FROM ev_head WHERE {_BLOCKING.format("")}),
ranked AS (SELECT rh.snapshot_id, rh.stage_id, rh.metric, count(*) AS head_blocking, (SELECT count(*) FROM rb WHERE rb.snapshot_id = rh.snapshot_id AND rb.stage_id = rh.stage_id AND rb.metric = rh.metric) AS base_blocking,
  min(rh.r) FILTER (rh.value > rb.value) AS higher_at FROM rh LEFT JOIN rb ON rb.snapshot_id = rh.snapshot_id AND rb.stage_id = rh.stage_id AND rb.metric = rh.metric AND rb.r = rh.r GROUP BY ALL),
dominance AS (SELECT snapshot_id, stage_id, metric, head_blocking, base_blocking, CASE WHEN head_blocking > base_blocking THEN 'more' WHEN higher_at IS NOT NULL THEN 'larger' ELSE 'none' END AS outcome,
  CASE WHEN head_blocking <= base_blocking THEN higher_at END AS first_rank FROM ranked)"""

LIMITED = f"""
proven AS (SELECT h.snapshot_id, h.stage_id, h.id, h.rule, bool_or(o.id IS NULL) AS fresh FROM h JOIN pair p USING (snapshot_id, stage_id)
  LEFT JOIN b o ON o.snapshot_id = h.snapshot_id AND o.stage_id = h.stage_id AND o.id = h.id
  WHERE p.note <> '' AND p.alike AND NOT EXISTS (FROM fate f WHERE f.unsure AND f.snapshot_id = h.snapshot_id AND f.stage_id = h.stage_id AND f.id = h.id)
    AND NOT EXISTS (FROM replaced r WHERE r.snapshot_id = h.snapshot_id AND r.stage_id = h.stage_id AND r.id = h.id)
    AND CASE WHEN o.id IS NULL THEN p.base_status = 'ok' AND (h.severity = 'critical' OR {_BLOCKING.format("h.")})
      ELSE o.n = 1 AND ((h.metric = o.metric AND {_BLOCKING.format("h.")} AND h.value > o.value) OR (h.severity = 'critical' AND o.severity <> 'critical')) END
  GROUP BY ALL)"""

ROLLED = f"""
surplus AS (SELECT p.snapshot_id, p.stage_id, 'critical' AS what FROM pair p WHERE p.base_status = 'ok' AND (p.note = '' OR p.alike)
    AND (SELECT count(*) FROM ev_head h WHERE h.severity = 'critical' AND h.snapshot_id = p.snapshot_id AND h.stage_id = p.stage_id) > (SELECT count(*) FROM ev_base b WHERE b.severity = 'critical' AND b.snapshot_id = p.snapshot_id AND b.stage_id = p.stage_id)
  UNION ALL SELECT p.snapshot_id, p.stage_id, d.metric FROM pair p JOIN dominance d USING (snapshot_id, stage_id) WHERE d.outcome <> 'none' AND p.base_status = 'ok' AND (p.note = '' OR p.alike)),
sure AS (SELECT a.* FROM added a ANTI JOIN replaced r USING (snapshot_id, stage_id, id) WHERE NOT a.unsure),
msg AS (
  SELECT snapshot_id, stage_id, 'blocker' AS kind, 'new ' || h_rule AS said, false AS weighs FROM sure JOIN pair USING (snapshot_id, stage_id) WHERE note = '' AND (h_severity = 'critical' OR {_BLOCKING.format("h_")})
  UNION ALL SELECT snapshot_id, stage_id, 'blocker', 'worse ' || rule, false FROM turn JOIN pair USING (snapshot_id, stage_id) WHERE note = '' AND change AND (({_BLOCKING.format("h_")} AND diff > 0) OR (h_severity = 'critical' AND b_severity <> 'critical'))
  UNION ALL SELECT snapshot_id, stage_id, 'blocker', 'proven ' || rule, false FROM proven
  UNION ALL SELECT snapshot_id, stage_id, 'blocker', 'surplus ' || what, false FROM surplus
  UNION ALL SELECT snapshot_id, stage_id, 'blocker', 'higher', false FROM higher JOIN pair USING (snapshot_id, stage_id) WHERE note = '' OR (alike AND base_status = 'ok' AND category = 'complexity')
  UNION ALL SELECT snapshot_id, stage_id, 'blocker', 'license', false FROM pair WHERE note = '' AND category = 'hygiene' AND b_license IS TRUE AND h_license IS FALSE
  UNION ALL SELECT snapshot_id, stage_id, 'regression', 'added', false FROM added JOIN pair USING (snapshot_id, stage_id) WHERE note = ''
  UNION ALL SELECT snapshot_id, stage_id, 'improvement', 'resolved', false FROM resolved JOIN pair USING (snapshot_id, stage_id) WHERE note = ''
  UNION ALL SELECT snapshot_id, stage_id, CASE direction WHEN 'worsened' THEN 'regression' ELSE 'improvement' END, 'turned ' || rule, false FROM turn JOIN pair USING (snapshot_id, stage_id) WHERE note = '' AND direction IN ('worsened', 'improved')
  UNION ALL SELECT snapshot_id, stage_id, CASE WHEN head > base THEN 'regression' ELSE 'improvement' END, metric, false FROM measured JOIN pair USING (snapshot_id, stage_id) WHERE note = '' AND round_even(head - base, 4) <> 0
  UNION ALL SELECT snapshot_id, stage_id, 'improvement', 'license', false FROM pair WHERE note = '' AND b_license IS FALSE AND h_license IS TRUE
  UNION ALL SELECT snapshot_id, stage_id, 'unknown', 'note', required FROM pair WHERE note <> ''
  UNION ALL SELECT snapshot_id, stage_id, 'unknown', 'unsure', true FROM fate JOIN pair USING (snapshot_id, stage_id) WHERE note = '' AND unsure
  UNION ALL SELECT snapshot_id, stage_id, 'unknown', 'replaced', true FROM replaced JOIN pair USING (snapshot_id, stage_id) WHERE note = ''),
rolled AS (SELECT *, CASE WHEN blockers > 0 THEN 'hold' WHEN NOT complete THEN 'unknown' WHEN regressions > 0 THEN 'review' ELSE 'no_configured_regressions' END AS decision
  FROM (SELECT s.snapshot_id, count(DISTINCT (m.stage_id, m.said)) FILTER (m.kind = 'blocker') AS blockers, count(DISTINCT (m.kind, m.stage_id, m.said)) FILTER (m.kind IN ('blocker', 'regression')) AS regressions,
      count(DISTINCT (m.stage_id, m.said)) FILTER (m.kind = 'improvement') AS improvements, count(DISTINCT (m.stage_id, m.said)) FILTER (m.kind = 'unknown') AS unknown,
      (SELECT count(*) FROM pair p WHERE p.snapshot_id = s.snapshot_id AND p.note = '' AND NOT EXISTS (FROM msg x WHERE x.kind <> 'unknown' AND x.snapshot_id = p.snapshot_id AND x.stage_id = p.stage_id)) AS unchanged,
      coalesce((SELECT complete FROM b_whole w WHERE w.snapshot_id = s.snapshot_id), false) AND coalesce((SELECT complete FROM h_whole w WHERE w.snapshot_id = s.snapshot_id), false) AND NOT coalesce(bool_or(m.weighs), false) AS complete
    FROM (SELECT DISTINCT snapshot_id FROM pair) s LEFT JOIN msg m USING (snapshot_id) GROUP BY s.snapshot_id))"""

_ONE, _BASE, _HEAD = assessed("ev_stages", "ev_findings", "s_"), assessed("ev_base_stages", "ev_base", "b_"), assessed("ev_head_stages", "ev_head", "h_")
_FULL = (MATCHED, PAIRED, RANKED, LIMITED, _BASE, _HEAD, ROLLED)
_FINDINGS, _STAGES = ("ev_base", "ev_head"), ("ev_base_stages", "ev_head_stages")


def statement(evidence: tuple[str, ...], parts: tuple[str, ...], select: str) -> str:
    """select over the parts, after the evidence tables that they read."""
    names = list(dict.fromkeys(x for e in evidence for x in (*RELATIONS[e].below(), e)))
    tables = [f"{x} AS ({RELATIONS[x].own_check()})" for x in names] + [p.strip() for p in parts]
    return (f"WITH {', '.join(tables)} " if tables else "") + select


def checks() -> dict[str, str]:
    return {
        "delta_match": statement(_FINDINGS, (MATCHED,), """SELECT snapshot_id, stage_id, id AS identity, rule, same AS unchanged, unsure AS ambiguous, CASE WHEN change THEN 0 ELSE fresh END AS added,
          CASE WHEN change OR twice THEN 0 ELSE gone END AS resolved, change::INT AS changed, CASE WHEN change THEN round_even(diff, 4) END AS delta, direction FROM turn"""),
        "uncertain_identities": statement(_FINDINGS, (MATCHED,), "SELECT snapshot_id, stage_id, id AS identity FROM replaced"),
        "stage_pairs": statement(_STAGES, (PAIRED,), "SELECT snapshot_id, stage_id, base_status, head_status, required, note FROM pair"),
        "metric_deltas": statement(_STAGES, (PAIRED,), "SELECT m.snapshot_id, m.stage_id, m.metric, m.base, m.head, round_even(m.head - m.base, 4) AS delta FROM measured m JOIN pair p USING (snapshot_id, stage_id) WHERE p.note = ''"),
        "metric_regressions": statement(_STAGES, (PAIRED,), """SELECT h.snapshot_id, h.stage_id, h.metric, h.base, h.head FROM higher h JOIN pair p USING (snapshot_id, stage_id) WHERE p.note = ''
          UNION ALL SELECT snapshot_id, stage_id, 'license_file', 1.0::DOUBLE, 0.0::DOUBLE FROM pair WHERE note = '' AND category = 'hygiene' AND b_license IS TRUE AND h_license IS FALSE"""),
        "rank_dominance": statement(_FINDINGS, (RANKED,), "FROM dominance"),
        "limited_regressions": statement(_FINDINGS + _STAGES, (MATCHED, PAIRED, LIMITED), "SELECT snapshot_id, stage_id, id AS identity, max(rule) AS rule, bool_or(fresh) AS new_blocks FROM proven GROUP BY ALL"),
        "delta_counts": statement(_FINDINGS + _STAGES, (MATCHED, PAIRED), """SELECT snapshot_id, stage_id, sum(CASE WHEN change AND note = '' THEN 0 ELSE fresh END) AS added, sum(CASE WHEN change OR twice OR note <> '' THEN 0 ELSE gone END) AS resolved,
          count(*) FILTER (change AND note = '') AS changed, sum(same) AS unchanged, count(*) FILTER (unsure) AS ambiguous, count(*) FILTER (direction = 'worsened' AND note = '') AS worsened,
          count(*) FILTER (direction = 'improved' AND note = '') AS improved FROM turn JOIN pair USING (snapshot_id, stage_id) GROUP BY ALL"""),
        "delta_assessment": statement(_FINDINGS + _STAGES, _FULL, "SELECT snapshot_id, blockers, regressions, improvements, unknown, unchanged, complete, decision FROM rolled"),
        "comparison_exit": statement(_FINDINGS + _STAGES, _FULL, """SELECT r.snapshot_id, CASE WHEN r.blockers > 0 THEN 1 WHEN NOT r.complete THEN 3 ELSE 0 END AS exit_code,
          CASE WHEN r.blockers > 0 OR e.exit_code = 1 THEN 1 WHEN e.exit_code = 3 OR NOT r.complete THEN 3 ELSE 0 END AS gated_exit_code FROM rolled r LEFT JOIN h_exit e USING (snapshot_id)"""),
        "delta_document": statement(_FINDINGS + _STAGES, (MATCHED, PAIRED), """SELECT p.snapshot_id, p.stage_id, p.base_status, p.head_status, p.note = '' AS comparable,
          p.note || CASE WHEN coalesce(t.unsure, 0) > 0 THEN ' Duplicate identities with unmatched observations remain ambiguous; their resolutions are unconfirmed.' ELSE '' END
            || CASE WHEN u.n > 0 THEN ' Changed anonymous bodies remain unmatched; function continuity is unknown.' ELSE '' END AS resolution_note,
          coalesce(t.fresh + CASE WHEN p.note = '' THEN 0 ELSE t.change END, 0) AS added, CASE WHEN p.note = '' THEN coalesce(t.gone, 0) ELSE 0 END AS resolved, CASE WHEN p.note = '' THEN coalesce(t.change, 0) ELSE 0 END AS changed,
          coalesce(t.same, 0) AS unchanged, coalesce(t.unsure, 0) AS ambiguous, coalesce(u.n, 0) AS uncertain, CASE WHEN p.note = '' THEN coalesce(m.n, 0) ELSE 0 END AS metrics
          FROM pair p LEFT JOIN (SELECT snapshot_id, stage_id, sum(CASE WHEN change THEN 0 ELSE fresh END) AS fresh, sum(CASE WHEN change OR twice THEN 0 ELSE gone END) AS gone, sum(change::INT) AS change, sum(same) AS same,
            sum(unsure::INT) AS unsure FROM turn GROUP BY ALL) t USING (snapshot_id, stage_id)
          LEFT JOIN (SELECT snapshot_id, stage_id, count(*) AS n FROM replaced GROUP BY ALL) u USING (snapshot_id, stage_id) LEFT JOIN (SELECT snapshot_id, stage_id, count(*) AS n FROM measured GROUP BY ALL) m USING (snapshot_id, stage_id)"""),
        "delta_items": statement(_FINDINGS + _STAGES + ("ev_changed_lines", "ev_base_lines"), (MATCHED, PAIRED, ITEMS), f"""SELECT snapshot_id, stage_id, h.id AS identity, CASE WHEN b.id IS NULL THEN 'added' ELSE 'changed' END AS outcome, CASE WHEN b.id IS NOT NULL THEN t.direction END AS direction,
          CASE WHEN b.id IS NOT NULL THEN round_even(t.diff, 4) END AS delta, {', '.join(f'h.{c}' for c in _SHOWN)}, h.inside AS in_changed_lines, {', '.join(f'b.{c} AS base_{c}' for c in _SHOWN)}, b.inside AS base_in_changed_lines
          FROM (SELECT * FROM lone_h JOIN turn USING (snapshot_id, stage_id, id)) h JOIN pair USING (snapshot_id, stage_id) JOIN turn t USING (snapshot_id, stage_id, id) LEFT JOIN (SELECT l.*, snapshot_id AS s, stage_id AS g FROM lone_b l) b ON t.change AND pair.note = '' AND b.s = h.snapshot_id AND b.g = h.stage_id AND b.id = h.id
          UNION ALL SELECT snapshot_id, stage_id, l.id, 'resolved', NULL, NULL, {', '.join('NULL' for _ in _SHOWN)}, NULL, {', '.join(f'l.{c}' for c in _SHOWN)}, l.inside FROM lone_b l JOIN turn t USING (snapshot_id, stage_id, id) JOIN pair USING (snapshot_id, stage_id) WHERE note = '' AND NOT t.change AND NOT t.twice"""),
        "delta_rows": statement(_FINDINGS, (MATCHED,), f"""SELECT snapshot_id, stage_id, rule, id AS identity, CASE WHEN change THEN direction WHEN fresh > 0 THEN 'added' ELSE 'resolved' END AS outcome,
          row_number() OVER (PARTITION BY snapshot_id, stage_id ORDER BY {_RANK.format("coalesce(h_severity, b_severity)")} DESC, rule, id) AS place FROM turn WHERE change OR fresh > 0 OR (gone > 0 AND NOT twice)"""),
        "changed_line_join": statement(("ev_head", "ev_changed_lines"), (), """SELECT f.snapshot_id, f.stage_id, f.ord, f.path, f.line, CASE WHEN f.path <> '' AND f.line >= 1
          THEN EXISTS (FROM ev_changed_lines c WHERE c.path = f.path AND f.line >= c.start_line AND f.line <= c.end_line) END AS in_changed_lines FROM ev_head f"""),
        "assessment": statement(("ev_stages", "ev_findings"), (_ONE,), """SELECT r.snapshot_id, r.score, CASE WHEN r.score IS NULL THEN '?' WHEN r.score >= 90 THEN 'A' WHEN r.score >= 80 THEN 'B' WHEN r.score >= 70 THEN 'C' WHEN r.score >= 60 THEN 'D' ELSE 'F' END AS grade,
          r.complete, r.required_stages, r.completed_stages, r.blockers, CASE WHEN r.blockers > 0 THEN 'hold' WHEN NOT r.complete THEN 'unknown'
          WHEN EXISTS (FROM ev_findings f SEMI JOIN ev_stages s USING (snapshot_id, stage_id) WHERE f.snapshot_id = r.snapshot_id AND f.severity IN ('medium', 'high')) THEN 'review' ELSE 'no_configured_blockers' END AS decision FROM s_result r"""),
        "stage_scores": statement(("ev_stages", "ev_findings"), (_ONE,), "SELECT snapshot_id, stage_id, category, status, required, score FROM s_score"),
        "category_scores": statement(("ev_stages", "ev_findings"), (_ONE,), "FROM s_cat"),
        "coverage_gaps": statement(("ev_stages", "ev_findings"), (_ONE,), "FROM s_gap"),
        "blockers": statement(("ev_stages", "ev_findings"), (_ONE,), "FROM s_block"),
        "strict_score": statement(("ev_stages", "ev_findings"), (_ONE,), "SELECT snapshot_id, required_stages, completed_stages, complete, strict AS score FROM s_whole"),
        "enclosing_names": statement(("ev_declarations", "ev_observations"), *enclosing.CHECK),
        "summary_guard": statement((), *documents.SUMMARY_CHECK),
        "shell_decisions": statement((), *documents.SYNTAX_CHECK),
        "diagnostic_messages": statement((), *messages.CHECK),
        "token_findings": statement((), *token_rules.CHECK),
        "working_status": statement(("ev_captured", "ev_expected", "ev_index"), *working.CHECK),
        "exit_code": statement(("ev_stages", "ev_findings"), (_ONE,), "FROM s_exit"),
    }
