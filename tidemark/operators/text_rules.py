"""Text rules: lines, Unicode controls, secrets, shebangs, hunks, review addresses, escaping and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.relation import relation

# S-15: line ends become \n
relation("text_lines", """
select doc_id, cast(length(t) - length(replace(t, char(10), '')) + 1 as bigint) as lines, cast(length(t) as bigint) as characters
from (select doc_id, replace(replace(text, char(13) || char(10), char(10)), char(13), char(10)) as t from {documents}) n
""", "documents", check="""
select doc_id, cast(length(t) - length(replace(t, chr(10), '')) + 1 as bigint) as lines, cast(length(t) as bigint) as characters
from (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t from {documents}) n
""")

# F-25: direct interpreters and plain env forms
relation("shell_dialect", """
select doc_id, case i when 'sh' then 'posix' when 'dash' then 'posix' when 'bash' then 'bash' when 'mksh' then 'mksh' else '' end as dialect from (
  select doc_id, regexp_extract(line, r'^#![ ]*(?:/[^ ]*/)?(?:env[ ]+(?:-S[ ]+)?)?(?:[^ ]*/)?([^ /]+)[ ]*$', 1) as i from (
    select doc_id, case doc_id % 6 when 0 then '#!/bin/sh' when 1 then '#!/usr/bin/env bash' when 2 then '#!/usr/bin/env -S mksh' when 3 then '#!/bin/bash -e' when 4 then '#!/opt/x/dash' else regexp_extract(text, r'^([^\n]*)', 1) end as line from {documents}) l) t
""", "documents")

# F-24: zero-length sides have no interval
relation("hunk_parse", """
select o_orderkey, case when old_count > 0 then old_start end as old_start, case when old_count > 0 then old_start + old_count - 1 end as old_end,
  case when new_count > 0 then new_start end as new_start, case when new_count > 0 then new_start + new_count - 1 end as new_end
from (select o_orderkey, cast(regexp_extract(h, r'^@@ -([0-9]+)', 1) as bigint) as old_start, cast(case when regexp_extract(h, r'^@@ -[0-9]+,([0-9]+)', 1) = '' then '1' else regexp_extract(h, r'^@@ -[0-9]+,([0-9]+)', 1) end as bigint) as old_count,
    cast(regexp_extract(h, r'[+]([0-9]+)', 1) as bigint) as new_start, cast(case when regexp_extract(h, r'[+][0-9]+,([0-9]+)', 1) = '' then '1' else regexp_extract(h, r'[+][0-9]+,([0-9]+)', 1) end as bigint) as new_count
  from (select o_orderkey, '@@ -' || cast(o_custkey as string) || case when o_orderkey % 3 = 0 then '' else ',' || cast(o_orderkey % 4 as string) end || ' +' || cast(o_custkey + 1 as string)
    || case when o_orderkey % 5 = 0 then '' else ',' || cast(o_orderkey % 7 as string) end || ' @@ x' as h from {orders}) s) t
""", "orders")

# S-13, F-29 to F-32: scheme, authority and path apart; what follows the path doesn't count
_SCHEME, _NUMBER = "^[A-Za-z][A-Za-z0-9+.-]*://", "([1-9][0-9]*)"
_GITHUB = f"^/([^/]+/[^/]+)/pull/{_NUMBER}(?:/(?:files|commits|checks))?/?$"
_GITLAB = f"^/(.+)/-/merge_requests/{_NUMBER}(?:/(?:diffs|commits|changes|pipelines))?/?$"
relation("review_url", f"""
with split as (
  select page_id, lower(regexp_extract(url, r'^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, regexp_extract(url, r'{_SCHEME}([^/?#]*)', 1) as authority, regexp_extract(url, r'{_SCHEME}[^/?#]*([^?#]*)', 1) as path
  from (select page_id, regexp_replace(regexp_replace(url, r'^[\x00-\x20]+', ''), r'[\t\r\n]', '') as url from {{ev_urls}}) u),
placed as (select *, regexp_extract(authority, r'^(.*)@', 1) as user, regexp_extract(place, r'^([^:]*)', 1) as host, regexp_extract(place, r'^[^:]*:(.*)$', 1) as port from (select *, regexp_replace(authority, r'^.*@', '') as place from split) s),
reviews as (
  select *, case when regexp_like(path, r'{_GITHUB}') then 'github' when regexp_like(path, r'{_GITLAB}') then 'gitlab' else '' end as provider,
    case when regexp_like(path, r'{_GITHUB}') then regexp_extract(path, r'{_GITHUB}', 1) else regexp_extract(path, r'{_GITLAB}', 1) end as project, case when regexp_like(path, r'{_GITHUB}') then regexp_extract(path, r'{_GITHUB}', 2) else regexp_extract(path, r'{_GITLAB}', 2) end as number
  from placed),
known as (
  select page_id, provider, lower(host) || case when regexp_like(port, r'[1-9]') then ':' || regexp_replace(port, r'^0+', '') else '' end as host, project, number, scheme,
    provider <> '' and scheme in ('http', 'https') and user in ('', ':') and regexp_like(host, r'^[A-Za-z0-9.-]+$') and regexp_like(port, r'^[0-9]*$') and coalesce(try_cast(port as bigint), 0) <= 65535
      and regexp_like(project, r'^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$') and not regexp_like('/' || project || '/', r'/[.][.]?/') as valid from reviews)
select page_id, case when valid then provider else '' end as provider, case when valid then host else '' end as host, case when valid then project else '' end as project, case when valid then try_cast(number as bigint) end as request_id,
  case when not valid then '' else scheme || '://' || host || '/' || project || case when provider = 'github' then '/pull/' else '/-/merge_requests/' end || number end as url
from known
""", "ev_urls", check="""
select page_id, case when ok then kind else '' end as provider, case when ok then host || coalesce(':' || nullif(port, 0), '') else '' end as host, case when ok then project else '' end as project, case when ok then number end as request_id,
  case when ok then scheme || '://' || host || coalesce(':' || nullif(port, 0), '') || '/' || project || marker || number else '' end as url
from (
  select *, scheme in ('http', 'https') and not regexp_matches(authority, '[^:@].*@') and regexp_full_match(host, '[a-z0-9.-]+') and (port_text = '' or port is not null and port < 65536) and regexp_full_match(port_text, '[0-9]*') and number >= 1 and not starts_with(number_text, '0')
    and case kind when 'github' then len(parts) = 2 when 'gitlab' then len(parts) >= 1 else false end and len(list_filter(parts, lambda x: not regexp_full_match(x, '[A-Za-z0-9_.-]+') or x in ('.', '..'))) = 0 and regexp_full_match(rest, tail) as ok
  from (
    select *, string_split(project, '/') as parts, try_cast(number_text as bigint) as number, try_cast(port_text as bigint) as port, case kind when 'github' then '(/(files|commits|checks))?/?' else '(/(diffs|commits|changes|pipelines))?/?' end as tail
    from (
      select *, substr(split_part(path, marker, 1), 2) as project, regexp_extract(split_part(path, marker, 2), '^[0-9]*') as number_text, regexp_replace(split_part(path, marker, 2), '^[0-9]*', '') as rest,
        lower(split_part(split_part(authority, '@', -1), ':', 1)) as host, split_part(split_part(authority, '@', -1), ':', 2) as port_text
      from (
        select *, case when contains(path, '/-/merge_requests/') then 'gitlab' when contains(path, '/pull/') then 'github' else '' end as kind, case when contains(path, '/-/merge_requests/') then '/-/merge_requests/' else '/pull/' end as marker
        from (select page_id, lower(split_part(url, '://', 1)) as scheme, split_part(after, '/', 1) as authority, substr(after, length(split_part(after, '/', 1)) + 1) as path
          from (select page_id, url, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) as after from {ev_urls}))))))
""")

# F-21
relation("redact_urls", "select page_id, regexp_replace(url, r'(https?://)[^/ @]+@', '$1[redacted]@') as url from {ev_urls}", "ev_urls",
         check="select page_id, regexp_replace(url, '(https?://)[^/ @]+@', '\\1[redacted]@', 'g') as url from {ev_urls}")

# F-20: the backslash first
_ESCAPED = "substring(text, 1, 200)"
_CHECKED = "substring(text, 1, 200)"
for _c in "\\`*_[]<>|":
    _ESCAPED = f"replace({_ESCAPED}, r'{_c}', r'\\{_c}')" if _c != "\\" else f"replace({_ESCAPED}, char(92), char(92) || char(92))"
    _CHECKED = f"replace({_CHECKED}, '{_c}', '\\{_c}')" if _c != "\\" else f"replace({_CHECKED}, chr(92), chr(92) || chr(92))"
relation("markdown_escape", f"select doc_id, {_ESCAPED.replace('substring(text, 1, 200)', 'text')} as escaped from {{documents}}", "documents", check=f"select doc_id, {_CHECKED.replace('substring(text, 1, 200)', 'text')} as escaped from {{documents}}")

# F-35
relation("tool_version", r"""
select p_partkey, regexp_extract(said, r'([0-9]+(?:[.][0-9]+)+(?:[-+][A-Za-z0-9.]+)?)', 1) as version
from (select p_partkey, p_name || ' v' || cast(p_size as string) || case when p_partkey % 3 = 0 then '' else '.' || cast(p_partkey % 10 as string) end || case when p_partkey % 4 = 0 then '-rc.1' else '' end as said from {part}) t
""", "part")

# F-16, F-17, W-6, E-4. The context crosses lines, so characters are indexed over the whole text.
_CONTROLLED = """
select doc_id, case when doc_id % 10 = 0 then text || char(10) || 'x' || {rlo} || 'y' when doc_id % 7 = 0 then substring(text, 1, 50) || {zwj} || substring(text, 51) when doc_id % 13 = 0 then 'a' || {shy} || text else text end as t from {{documents}}
"""
_spark = _CONTROLLED.format(rlo="'\u202e'", zwj="'\u200d'", shy="'\u00ad'")
relation("ev_text_controls", _spark, "documents")
_EVERY = r"""
select doc_id, rule, case rule when 'unicode.bidi-control' then case when code in (8237, 8238) then 'high' else 'medium' end when 'unicode.soft-hyphen' then 'info' else 'low' end as severity,
  line, col, 'U+' || case when code < 65536 then lpad(upper(to_hex(code)), 4, '0') else upper(to_hex(code)) end as symbol
from (
  select doc_id, line, col, code, case
    when code = 1564 or code in (8206, 8207) or code between 8234 and 8238 or code between 8294 and 8297 then 'unicode.bidi-control'
    when code = 173 then 'unicode.soft-hyphen'
    when code = 6158 or code = 8203 or code between 8288 and 8292 then 'unicode.invisible-control'
    when code between 917505 and 917631 then case when not after_emoji then 'unicode.unexpected-tag' end
    when code in (8204, 8205) then case when coalesce((left_emoji and right_emoji) or (left_letter and right_letter), false) then null else 'unicode.unexpected-joiner' end
    when code = 65279 then case when pos > 1 then 'unicode.misplaced-bom' end
    when code between 65024 and 65039 or code between 917760 and 917999 then case when coalesce(left_code, 0) < 128 then 'unicode.unexpected-variation-selector' end end as rule
  from (
    select doc_id, pos, code, left_code, line, pos - last_break as col, after_emoji,
      left_code >= 126976 or left_code in (65039, 10084) as left_emoji, right_code >= 126976 or right_code in (65039, 10084) as right_emoji,
      left_code > 127 and regexp_matches(chr(left_code), '^[\p{{L}}\p{{M}}]$') as left_letter, right_code > 127 and regexp_matches(chr(right_code), '^[\p{{L}}\p{{M}}]$') as right_letter
    from (
      select doc_id, pos, code, lag(code) over w as left_code, lead(code) over w as right_code,
        coalesce(bool_or(code between 126976 and 917503) over (partition by doc_id order by pos rows between 12 preceding and 1 preceding), false) as after_emoji,
        cast(1 + coalesce(sum(case when code = 10 then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as line,
        coalesce(max(case when code = 10 then pos end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as last_break
      from (select doc_id, pos, unicode(c) as code from (
        select doc_id, unnest(range(1, len(string_split(t, '')) + 1)) as pos, unnest(string_split(t, '')) as c from {ev_text_controls}
        where t <> '' and regexp_matches(t, '[\x{{AD}}\x{{61C}}\x{{180E}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{2066}}-\x{{2069}}\x{{FEFF}}\x{{FE00}}-\x{{FE0F}}\x{{E0001}}-\x{{E007F}}\x{{E0100}}-\x{{E01EF}}]')) e) p
      window w as (partition by doc_id order by pos)) x
    where code = 173 or code >= 1564) y) z
where rule is not null
"""
# the check statement: every position of every text; the query itself is unicode_controls() below
relation("unicode_controls", _EVERY, "ev_text_controls")

# E-12, built-in patterns: a rule, the form of its values, and the word or mark that a line must have. Published without
# the match. An assignment counts if its value isn't a placeholder.
SECRET_PATTERNS = {
    "secret.aws-access-key": "AKIA[0-9A-Z]{16}",
    "secret.github-token": "gh[pousr]_[A-Za-z0-9]{36}",
    "secret.gitlab-token": "glpat-[A-Za-z0-9_-]{20}",
    "secret.google-api-key": "AIza[0-9A-Za-z_-]{35}",
    "secret.npm-token": "npm_[A-Za-z0-9]{36}",
    "secret.stripe-key": "sk_live_[0-9A-Za-z]{24}",
    "secret.private-key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
_NAME = "(?i)(?:password|passwd|token|secret(?:_access_key)?|api_?key)"
ASSIGNMENT = _NAME + r"[\x22\x27]?[ \t]*[=:][ \t]*[\x22\x27]?([A-Za-z0-9+/_=-]{12,})"
# at the edges of a word: a value that merely contains such letters is none
PLACEHOLDER = "(?i)(?:^|[^A-Za-z0-9])(?:example|change_?me|placeholder|your|dummy|xxxx+|redacted)(?:[^A-Za-z0-9]|$)"
ANY_SECRET = "|".join([*SECRET_PATTERNS.values(), _NAME])
_RULES = " union all ".join(f"select '{k}' as rule, r'{v.replace('{', '{{').replace('}', '}}')}' as pattern, {len(v)} as width" for k, v in (*SECRET_PATTERNS.items(), ("secret.credential-assignment", ASSIGNMENT)))
relation("secret_rules", f"select r.rule, r.pattern, r.width, coalesce(s.lines, 0) as lines from ({_RULES}) r left join (select rule, count(*) as lines from {{secret_scan}} group by rule) s on s.rule = r.rule", "secret_scan")


def secret_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with the column rule, once for each built-in rule that the line meets. One pass: lines without any key word
    or prefix go first, then all rules are tried as an array. The first assignment that isn't a placeholder counts."""
    values = F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(1))
    assigned = F.exists(values, lambda v: ~v.rlike(PLACEHOLDER))
    rules = F.array(*(F.when(F.col(text).rlike(p), F.lit(r)) for r, p in SECRET_PATTERNS.items()), F.when(assigned, F.lit("secret.credential-assignment")))
    return lines.where(F.col(text).rlike(ANY_SECRET)).withColumn("rule", F.explode(F.filter(rules, lambda r: r.isNotNull())))


def secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, line, rule and severity of every line of documents that meets a rule."""
    some = documents.where(F.col("text").rlike(ANY_SECRET)).select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("at", "text"))
    return secret_lines(some).select("doc_id", (F.col("at") + 1).cast("bigint").alias("line"), "rule", F.lit("high").alias("severity"))


_quoted = lambda x: x.replace("'", "''").replace("{", "{{").replace("}", "}}")
relation("secret_scan", f"""
select doc_id, line, unnest(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{_quoted(p)}') THEN '{r}' END" for r, p in SECRET_PATTERNS.items())},
    CASE WHEN len(list_filter(regexp_extract_all(text, '{_quoted(ASSIGNMENT)}', 1), lambda v: not regexp_matches(v, '{_quoted(PLACEHOLDER)}'))) > 0 THEN 'secret.credential-assignment' END], lambda r: r is not null)) as rule, 'high' as severity
from (select doc_id, unnest(range(1, len(l) + 1)) as line, unnest(l) as text from (select doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as l from {{documents}}) d) t
""", "documents")  # the check statement; the query is secret_scan() above

# E-19, a measure of its own: windows of three lines that occur in two places or more
relation("line_windows", r"""
select doc_id, pos, sha2(trim(line) || char(10) || trim(lead1) || char(10) || trim(lead2), 256) as w from (
  select doc_id, pos, line, lead(line, 1) over (partition by doc_id order by pos) as lead1, lead(line, 2) over (partition by doc_id order by pos) as lead2 from (
    select doc_id, posexplode(split(text, r'\n')) as (pos, line) from {documents}) l) t
where lead2 is not null and length(line) + length(lead1) + length(lead2) >= 60
""", "documents", check=r"""
select doc_id, pos, sha256(trim(line) || chr(10) || trim(lead1) || chr(10) || trim(lead2)) as w from (
  select doc_id, pos, line, lead(line, 1) over (partition by doc_id order by pos) as lead1, lead(line, 2) over (partition by doc_id order by pos) as lead2 from (
    select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from {documents}) l) t
where lead2 is not null and length(line) + length(lead1) + length(lead2) >= 60
""")
relation("line_window_clones", "select w, count(*) as places, count(distinct doc_id) as documents, min(doc_id) as first_doc from {line_windows} group by w having count(*) > 1", "line_windows")

# A-18, F-39: half up by definition, and counters must be safe integers
relation("clone_ratio", """
select doc_id % 50 as source, sum(lines) as lines, sum(cloned) as duplicated, case when sum(lines) > 0 and sum(lines) <= 9007199254740991 then floor(cast(10000 as double) * sum(cloned) / sum(lines) + cast(0.5 as double)) / 100 end as percentage
from (select w.doc_id, count(*) as lines, count_if(c.w is not null) as cloned from {line_windows} w left join {line_window_clones} c on w.w = c.w group by w.doc_id) t group by 1
""", "line_windows", "line_window_clones")
# J-15
relation("clone_reconcile", """
select (select sum(lines) from {clone_ratio}) as by_source, (select count(*) from {line_windows}) as by_window, (select sum(duplicated) from {clone_ratio}) as duplicated_by_source, (select sum(places) from {line_window_clones}) as duplicated_by_clone
""", "clone_ratio", "line_windows", "line_window_clones")
# J-16, A-19: clones as pairs of a window's first place with each other place; a second endpoint must lie in its source
relation("source_lengths", r"select doc_id, pos, length(line) as characters from (select doc_id, posexplode(split(text, r'\n')) as (pos, line) from {documents}) l", "documents",
         check="select doc_id, pos, length(line) as characters from (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from {documents}) l")
relation("clone_endpoints", """
select b.w, b.doc_id, b.pos as first_line, b.pos + 2 + case when b.doc_id % 11 = 0 then 100000 else 0 end as last_line, case when b.doc_id % 7 = 0 then 100000 else 0 end as last_column, case when b.doc_id % 5 = 0 then b.pos + 3 else b.pos end as start_line
from {line_windows} b join (select w, min(doc_id) as doc_id from {line_windows} group by w having count(*) > 1) a on a.w = b.w and a.doc_id <> b.doc_id
""", "line_windows")
relation("clone_validate", """
select reason, count(*) as clones from (
  select case when e.last_line >= n.lines then 'clone range outside source lines' when e.last_column > l.characters + 1 then 'clone column outside source line' when e.start_line > e.last_line then 'reversed clone endpoints' else 'valid' end as reason
  from {clone_endpoints} e join (select doc_id, count(*) as lines from {source_lengths} group by doc_id) n on n.doc_id = e.doc_id left join {source_lengths} l on l.doc_id = e.doc_id and l.pos = e.last_line) t group by reason
""", "clone_endpoints", "source_lengths")

# The code points of each rule, as character classes.
CLASSES = {
    "bidi": r"[؜‎‏‪-‮⁦-⁩]", "override": r"[‭‮]", "soft": r"­", "hidden": r"[᠎​⁠-⁤]", "tag": r"[\x{E0001}-\x{E007F}]",
    "joiner": r"[‌‍]", "mark": r"﻿", "variation": r"[︀-️\x{E0100}-\x{E01EF}]", "emoji": r"[\x{1F000}-\x{10FFFF}️❤]", "picture": r"[\x{1F000}-\x{DFFFF}]",
    "letter": r"[[\p{L}\p{M}]&&[^\x00-\x7F]]", "plain": r"[\x00-\x7F]",
}
SUSPICIOUS = "[" + "".join(CLASSES[c].strip("[]") for c in ("bidi", "soft", "hidden", "tag", "joiner", "mark", "variation")) + "]"
_is = lambda what, name: f"{what} rlike r'^{CLASSES[name]}$'"
_both = lambda name: f"({_is('x.left', name)} and {_is('x.right', name)})"
_CONTROL = f"""case when {_is("x.c", "bidi")} then 'bidi-control' when {_is("x.c", "soft")} then 'soft-hyphen' when {_is("x.c", "hidden")} then 'invisible-control'
  when {_is("x.c", "tag")} then if(x.near rlike r'{CLASSES["picture"]}', null, 'unexpected-tag') when {_is("x.c", "joiner")} then if({_both("emoji")} or {_both("letter")}, null, 'unexpected-joiner')
  when {_is("x.c", "mark")} then if(x.at = 0, null, 'misplaced-bom') else if(x.left = '' or {_is("x.left", "plain")}, 'unexpected-variation-selector', null) end"""


def unicode_controls(texts: DataFrame, key: str = "long") -> DataFrame:
    """Every suspicious control of texts (doc_id of type key, text) with rule, severity, line and column.

    A text is cut at its candidates once, so the work follows its length. What goes on of a part between two candidates is
    its length, its lines and its last characters; running sums over a text's parts, in order, give places and the twelve
    characters before each candidate, so that the context crosses lines."""
    some = texts.select(F.col("doc_id").cast(key), "text").where((F.octet_length("text") > F.length("text")) & F.col("text").rlike(SUSPICIOUS)).withColumn("row", F.monotonically_increasing_id())
    cut = some.select("doc_id", "row", F.split("text", SUSPICIOUS, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(SUSPICIOUS), F.lit(0)).alias("found"))
    part = r"""transform(found, (c, i) -> named_struct('c', c, 'n', length(gaps[i]), 'lines', length(gaps[i]) - length(replace(gaps[i], '\n', '')), 'after', length(substring_index(gaps[i], '\n', -1)), 'tail', right(gaps[i], 12),
      'left', case when gaps[i] <> '' then right(gaps[i], 1) when i > 0 then found[i - 1] else '' end, 'right', case when gaps[i + 1] <> '' then left(gaps[i + 1], 1) else coalesce(get(found, i + 1), '') end))"""
    rows = cut.selectExpr("doc_id", "row", f"posexplode({part}) as (i, p)")
    upto, near = "partition by row order by i rows between unbounded preceding and current row", "partition by row order by i rows between 12 preceding and 1 preceding"
    rows = rows.selectExpr("doc_id", "row", "i", "p", f"sum(p.n + 1) over ({upto}) - 1 as at", f"sum(p.lines) over ({upto}) as lines", f"array_join(collect_list(concat(p.tail, p.c)) over ({near}), '') as earlier")
    rows = rows.selectExpr("doc_id", "lines", f"max(case when p.lines > 0 then at - p.after end) over ({upto}) as line_start", "named_struct('c', p.c, 'left', p.left, 'right', p.right, 'at', at, 'near', right(concat(earlier, p.tail), 12)) as x")
    rows = rows.selectExpr("*", f"{_CONTROL} as rule").where("rule is not null")
    code = "hex(ascii(x.c))"
    return rows.selectExpr(
        "doc_id", "'unicode.' || rule as rule", f"case rule when 'bidi-control' then if({_is('x.c', 'override')}, 'high', 'medium') when 'soft-hyphen' then 'info' else 'low' end as severity",
        "cast(1 + lines as bigint) as line", "cast(x.at - coalesce(line_start, 0) + 1 as bigint) as col", f"'U+' || lpad({code}, greatest(4, length({code})), '0') as symbol",
    )
