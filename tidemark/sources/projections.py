"""Deterministic evidence tables projected from the TPC-H-like tables, so that every operator has a driver query."""

from __future__ import annotations

from ..functions.paths import in_scope, is_test, language
from ..plans.relation import relation

# Twelve consecutive orders are one snapshot, and each order is one of its stages: two of each category.
_SNAPSHOT = "'snap' || cast(cast(floor({key} / 12) as bigint) as string)"
_CATEGORY = "case {key} % 6 when 0 then 'lint' when 1 then 'types' when 2 then 'complexity' when 3 then 'duplication' when 4 then 'security' else 'hygiene' end"
_STAGE = f"{_CATEGORY} || case when {{key}} % 12 < 6 then '.1' else '.2' end"


def of_order(key: str) -> str:
    """snapshot_id and stage_id of an order."""
    return f"{_SNAPSHOT.format(key=key)} as snapshot_id, {_STAGE.format(key=key)} as stage_id"


relation("ev_stages", f"""
select {of_order("o_orderkey")}, category, case when o_orderkey % 23 = 0 then 'limited' when o_orderkey % 101 = 0 then 'failed' else 'ok' end as status,
  o_orderkey % 13 <> 0 as required, 'tool-' || category as tool, '1.' || cast(o_orderkey % 3 as string) as version,
  case when o_orderkey % 23 = 0 then 'partial input' when o_orderkey % 101 = 0 then 'tool failed' else '' end as reason,
  'all' as scope, cast(o_orderkey % 40 as bigint) as analyzed_files, cast(o_orderkey % 40 + o_orderkey % 3 as bigint) as eligible_files,
  case when category = 'lint' then case when o_orderkey % 31 = 0 then cast('NaN' as double) else cast(m % 60 as double) end end as issue_count,
  case when category = 'types' then cast(m % 20 as double) end as error_count, case when category = 'types' then cast(m % 37 as double) end as warning_count,
  case when category = 'complexity' then cast(m % 53 as double) end as max_cc,
  case when category = 'duplication' then case when o_orderkey % 37 = 0 then cast(-1 as double) else cast(m % 62 as double) end end as duplication_percent,
  case when category = 'hygiene' then m % 25 <> 0 end as license_file, case when category = 'hygiene' then m % 4 <> 0 end as nontrivial_readme,
  case when category = 'hygiene' then m % 3 <> 0 end as test_files, case when category = 'hygiene' and o_orderkey % 41 <> 0 then m % 2 = 0 end as gitignore_file,
  case when floor(o_orderkey / 12) % 19 = 0 then 'quick' else 'full' end as profile, o_orderkey
from (select o_orderkey, cast(floor(o_totalprice) as bigint) as m, {_CATEGORY.format(key="o_orderkey")} as category from {{orders}}) t
""", "orders")

relation("ev_findings", f"""
select snapshot_id, stage_id, ord,
  case kind when 2 then 'native.high-complexity' when 4 then 'security.pattern' when 0 then 'lint.rule' when 1 then 'types.mismatch' when 3 then 'duplication.block' else 'hygiene.fact' end as rule,
  'note ' || cast(l_partkey % 7 as string) as message,
  case when kind = 2 then case when l_quantity + 10 > 50 then 'high' when l_quantity + 10 > 20 then 'medium' else 'low' end
    when kind = 4 then case when l_orderkey % 701 = 0 then 'critical' when l_orderkey % 109 = 0 then 'high' when l_orderkey % 37 = 0 then 'medium' when l_orderkey % 11 = 0 then 'low' else 'info' end
    else case when l_partkey % 3 = 0 then 'low' else 'info' end end as severity,
  'src/f' || cast(cast(floor(l_orderkey / 10) as bigint) as string) || '.py' as path, cast(l_linenumber * 10 as bigint) as line,
  's' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) as symbol,
  case when l_orderkey % 19 = 0 then 'fp' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) else '' end as fingerprint,
  case when kind = 2 then case when l_orderkey % 5 = 0 then 'shell-ast-decision-complexity-v1' else 'cyclomatic_complexity' end else '' end as metric,
  case when kind = 2 then l_quantity + 10 end as value, case when l_orderkey % 29 = 0 then 'body' else 'name' end as identity_kind, l_orderkey, l_partkey
from (select *, l_orderkey % 6 as kind, {of_order("l_orderkey")},
  lpad(cast(l_orderkey as string), 12, '0') || lpad(cast(l_linenumber as string), 3, '0') || lpad(cast(l_partkey as string), 12, '0')
    || lpad(cast(l_suppkey as string), 12, '0') || lpad(cast(cast(l_quantity as bigint) as string), 4, '0')
    || lpad(cast(cast(floor(l_extendedprice * 100) as bigint) as string), 14, '0') || cast(cast(l_shipdate as date) as string) as ord
  from {{lineitem}}) t
""", "lineitem")

relation("ev_base", """
select snapshot_id, stage_id, ord, rule, message, severity, path, line, symbol, fingerprint, metric, value, identity_kind
from {ev_findings} where (l_orderkey + l_partkey) % 10 <> 0
""", "ev_findings")

# Bodies change their fingerprint, so that they are new observations in the old place.
relation("ev_head", """
select snapshot_id, stage_id, ord, rule, message, case when l_orderkey % 43 = 0 and severity = 'low' then 'medium' when l_orderkey % 1402 = 4 then 'critical' else severity end as severity, path, line, symbol,
  case when identity_kind = 'body' and l_partkey % 2 = 0 then 'new ' || symbol else fingerprint end as fingerprint, metric,
  case when l_orderkey % 17 = 0 or l_partkey % 11 = 0 then value + 5 when l_orderkey % 18 = 0 then value - 3 else value end as value, identity_kind
from {ev_findings} where (l_orderkey + l_partkey) % 10 <> 1
""", "ev_findings")

# Two reports of each snapshot: stages that either of them lacks, other tools, versions, scopes and profiles, and changed measurements.
relation("ev_base_stages", "select * from {ev_stages} where o_orderkey % 47 <> 5", "ev_stages")
relation("ev_head_stages", """
select snapshot_id, stage_id, category, case when o_orderkey % 59 = 3 or o_orderkey % 12 = 8 and o_orderkey % 5 < 2 then 'limited' when o_orderkey % 61 = 9 then 'ok' else status end as status, required,
  case when o_orderkey % 71 = 3 then 'tool-x' else tool end as tool, case when o_orderkey % 67 = 3 then '9.9' else version end as version, reason,
  case when o_orderkey % 73 = 3 then 'part' else scope end as scope, analyzed_files, eligible_files, issue_count + cast(o_orderkey % 3 - 1 as double) as issue_count,
  error_count + cast(o_orderkey % 4 - 1 as double) as error_count, warning_count, max_cc + case when o_orderkey % 8 = 2 then cast(0.00001 as double) else cast(o_orderkey % 5 - 2 as double) end as max_cc,
  duplication_percent + cast(o_orderkey % 7 - 3 as double) as duplication_percent, case when o_orderkey % 4 = 1 then not license_file else license_file end as license_file,
  nontrivial_readme, test_files, gitignore_file, case when floor(o_orderkey / 12) % 57 = 0 then 'full' else profile end as profile, o_orderkey
from {ev_stages} where o_orderkey % 53 <> 7
""", "ev_stages")

relation("ev_changed_lines", """
select 'src/f' || cast(cast(floor(p_partkey / 2) as bigint) as string) || '.py' as path, cast(p_size as bigint) as start_line, cast(p_size + p_partkey % 5 as bigint) as end_line
from {part}
""", "part")

relation("ev_base_lines", """
select 'src/f' || cast(cast(floor(p_partkey / 3) as bigint) as string) || '.py' as path, cast(p_size + 3 as bigint) as start_line, cast(p_size + 3 + p_partkey % 4 as bigint) as end_line
from {part}
""", "part")

relation("ev_files", f"""
select path as relative_path, {language("path")} as language, {is_test("path")} as is_test, size_bytes, text as content, {in_scope("path")} as in_scope, doc_id
from (
  select case when doc_id % 5 = 0 then 'tests/' when doc_id % 17 = 0 then 'vendor/' else '' end || source || '/doc_' || cast(doc_id as string)
      || case lang when 'en' then case when doc_id % 8 = 3 then '.rs' else '.py' end when 'de' then case when doc_id % 8 = 3 then '.php' else '.ts' end when 'fr' then case when doc_id % 8 = 3 then '.blade.php' else '.java' end else '.txt' end as path,
    cast(octet_length(text) as bigint) as size_bytes, text, doc_id
  from {{documents}}) t
""", "documents")

relation("ev_commits", """
select 'repo' || cast(user_id % 50 as string) as repository, cast(cast(ts as date) as string) as commit_id, 'f' || cast(user_id as string) || '.py' as path,
  cast(1 + cast(floor(abs(value)) as bigint) % 60 as double) as cc, event_id
from {events}
""", "events")

relation("ev_diagnostics", """
select 'snap' || cast(event_id % 40 as string) as snapshot_id,
  case event_id % 9 when 0 then 'TS2307' when 1 then 'TS7016' when 2 then 'TS2322' when 3 then 'TS2345' when 4 then 'class.notFound' when 5 then 'function.notFound'
    when 6 then 'return.type' when 7 then case when event_id % 40 = event_id % 400 then 'trait.notFound' else 'argument.type' end else 'TS6059' end as rule,
  event_type || ' ' || props as message, case when event_id % 3 = 0 then 'error' else 'warning' end as severity, event_id as ord, 'f' || cast(user_id as string) || '.ts' as path
from {events}
""", "events")

# Messages with contexts that repeat, lack and are too long, some rules once only
relation("ev_reports", """
select 'snap' || cast(event_id % 400 as string) as snapshot_id, event_id as ord, 'phpstan.' || case event_id % 7 when 0 then 'class.notFound' when 1 then 'function.notFound' when 2 then 'return.type' when 3 then case when event_id % 11 = 3 then 'trait.notFound' else 'argument.type' end
    when 4 then case when event_id % 13 = 5 then 'attribute.notFound' else 'method.notFound' end when 5 then 'property.notFound' else 'return.unresolvableType' end as rule,
  case when event_id % 5 = 4 then 'no context here' else 'PHPStan: ' || case when event_id % 9 = 2 then repeat('long ', 30) else '' end || event_type || ': ' || chr(cast(122 - event_id % 23 as int)) || ' (snapshot level 5)' end as message,
  'f' || cast(user_id as string) || '.php' as path, event_id % 300 as line from {events}
""", "events")

relation("ev_urls", """
select page_id, case when page_id % 21 = 6 then 'https://GitHub.com:8443/org/repo' || cast(page_id as string) || '/pull/7' when page_id % 33 = 9 then 'https://github.com/org/../pull/' || cast(page_id as string)
  when page_id % 13 = 4 then 'HTTPS://GitHub.com/Org/repo' || cast(page_id as string) || '/pull/5/commits/?x=1#d' when page_id % 17 = 5 then 'http://git.example:' || cast(page_id * 997 as string) || '/a/b/-/merge_requests/3#note'
  when page_id % 19 = 7 then 'https://' || case page_id % 4 when 0 then '@' when 1 then ':@' when 2 then 'u@' else ':p@' end || 'github.com/o/r/pull/' || cast(page_id as string) when page_id % 23 = 8 then 'https://git.example' || case page_id % 3 when 0 then ':' when 1 then ':000' else ':8x' end || '/o/r/pull/8?y'
  when page_id % 29 = 3 then 'ftp://github.com/o/r/pull/3' when page_id % 31 = 2 then 'https://github.com/o/r/pull/0' || cast(page_id as string) when page_id % 37 = 1 then 'https://gitlab.com/a b/c/-/merge_requests/4'
  when page_id % 3 = 0 then 'https://github.com/org' || cast(page_id % 9 as string) || '/repo' || cast(page_id as string) || '/pull/' || cast(page_id as string) || case when page_id % 2 = 0 then '/files' else '' end
  when page_id % 3 = 1 then 'https://gitlab.com/group/sub' || cast(page_id % 9 as string) || '/proj/-/merge_requests/' || cast(page_id + 1 as string)
  when page_id % 7 = 0 then 'https://user:secret@host.example/x/y' else url end as url
from {pages}
""", "pages")
