"""E-23: rules over a language's tokens, which are given as rows (path, seq, kind, text, line); no source is tokenised.

Tokens are dealt by file once, and all that follows are windows and groups of one file. Brackets get a level by a running
sum, so that a bracket's partner is the next one of its level, and a call's arguments lie between its brackets and the commas
of that level. What an argument, a statement or a pair of ticks holds is a difference of running counts at its two ends, so
nested calls cost no more than their brackets. Calls of escapeshellarg are counted apart, by how many of them are open, and
taken off. Which variables hold request data is folded over a file's assignments in order. A file's tokens are one window: a
file has at most 8 MiB. Tokens of a null path are one file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..plans.relation import RELATIONS, relation

# Kinds that carry no meaning, names that stand for request data, what makes a command dynamic, the functions.
IGNORED = ("T_WHITESPACE", "T_COMMENT", "T_DOC_COMMENT", "T_OPEN_TAG", "T_CLOSE_TAG", "T_INLINE_HTML")
REQUEST = ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES", "$_SERVER")
REQUEST_CALLS = ("request", "input", "filter_input")
DYNAMIC = ("T_VARIABLE", "T_STRING_VARNAME", "T_DOLLAR_OPEN_CURLY_BRACES", "T_CURLY_OPEN", "T_STRING", "T_NAME_FULLY_QUALIFIED", "T_NAME_QUALIFIED")
INCLUDES = ("T_INCLUDE", "T_INCLUDE_ONCE", "T_REQUIRE", "T_REQUIRE_ONCE")
SHELL = ("exec", "system", "passthru", "shell_exec", "popen", "proc_open")
SQL = ("query", "exec", "raw", "unprepared")
_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"

_REQUESTS = f"(text in {_in(REQUEST)} or (kind = 'T_STRING' and lower(text) in {_in(REQUEST_CALLS)}))"
# Texts and names as numbers, so that the rows that are sorted stay short
_TEXTS = ("(", "[", "{", ")", "]", "}", ",", ";", "`", ".", ":", "=", "=>", "->", "?->", "::", "function", "new", "array", "false")
_CALLED = tuple(dict.fromkeys(("escapeshellarg", "unserialize", "extract", *SHELL, *SQL)))
_LABELS = ("data", "array", "command", "options")
_text = lambda *texts: "(" + ", ".join(str(_TEXTS.index(t) + 1) for t in texts) + ")"
_called = lambda *names: "(" + ", ".join(str(_CALLED.index(n) + 1) for n in names) + ")"
_number = lambda x, values, default: f"case {x} " + " ".join(f"when '{v.replace('{', '{{').replace('}', '}}')}' then {i + 1}" for i, v in enumerate(values)) + f" else {default} end"
_OPEN, _CLOSE = f"code in {_text('(', '[', '{')}", f"code in {_text(')', ']', '}')}"
_BOUNDARY, _END = f"code between 1 and {_TEXTS.index(',') + 1}", f"code in {_text(';')}"
_P = "partition by file order by seq, line"
_UPTO = "rows between unbounded preceding and current row"
_count = lambda condition: f"sum(case when {condition} then 1 else 0 end) over ({_P} {_UPTO})"
_found = lambda rule, severity="'high'": f"named_struct('rule', '{rule}', 'severity', {severity})"
relation("token_findings", f"""
with dealt as (
  select /*+ repartition({{parts}}, file) */ * from (select coalesce('/' || path, '') as file, seq, line, kind, text from {{ev_tokens}} where kind not in {_in(IGNORED)}) t),
coded as (
  select file, seq, line, kind, text, {_number("text", _TEXTS[:-2], "case lower(text) when 'array' then 19 when 'false' then 20 else 0 end")} as code, kind = 'T_VARIABLE' as variable, kind in {_in(DYNAMIC)} as dynamic, {_REQUESTS} as request from dealt),
assigned as (
  select *, sum(case when assigns then 1 else 0 end) over ({_P} {_UPTO}) as n_assigned
  from (select file, seq, line, text, code, variable, request, variable and lead(code) over ({_P}) in {_text("=")} as assigns from coded) t),
of_statement as (
  select file, seq, text, code, variable, request, assigns, n_assigned - coalesce(max(case when {_END} then n_assigned end) over ({_P} rows between unbounded preceding and 1 preceding), 0) as nth from assigned),
aliases as (
  select file, aggregate(array_sort(collect_list(struct(seq, first, request, text))), named_struct('target', '', 'known', cast(array() as array<string>)), (s, x) -> case when x.first then named_struct('target', x.text, 'known', s.known)
    when x.request or array_contains(s.known, x.text) then named_struct('target', s.target, 'known', array_union(s.known, array(s.target))) else s end, s -> s.known) as known
  from (select *, coalesce(assigns and nth = 1, false) as first from of_statement where nth > 0 and code not in {_text(";", "=")} and (variable or request)) t group by file having bool_or(first) and bool_or(request)),
placed as (
  select file, seq, line, text, code, dynamic, request, kind = 'T_EVAL' as eval, kind in {_in(INCLUDES)} as include, row_number() over ({_P}) as pos, lead(code) over ({_P}) is null as last,
    {_count(_OPEN)} - {_count(_CLOSE)} + case when {_CLOSE} then 1 else 0 end as level, {_count(f"code in {_text('`')}")} as ticks, {_count("dynamic")} as n_dynamic, {_count("variable")} as n_variable, {_count(f"code in {_text('.')}")} as n_dot,
    {_count(f"code not in {_text(';', '(', ')')}")} as n_part, {_count(f"not (code in {_text(';', '(', ')', '.')} or kind in ('T_CONSTANT_ENCAPSED_STRING', 'T_DIR', 'T_FILE'))")} as n_loose,
    lag(called) over ({_P}) as called, lag(seq) over ({_P}) as called_seq, lag(line) over ({_P}) as called_line, coalesce(lag(code, 2) over ({_P}), 0) as before_called,
    case when lead(code, 2) over ({_P}) in {_text(":")} then lead(label) over ({_P}) else 0 end as label, lead(dynamic) over ({_P}) as dynamic_1, lead(dynamic, 2) over ({_P}) as dynamic_2,
    case when kind = 'T_CONSTANT_ENCAPSED_STRING' and substring(text, 2, length(text) - 2) = 'allowed_classes' and lead(code) over ({_P}) in {_text("=>")} and lead(code, 2) over ({_P}) in {_text("false")} then
      case when lag(code) over ({_P}) in {_text("[")} and lead(code, 3) over ({_P}) in {_text("]")} then 5 when lag(code) over ({_P}) in {_text("[")} and lead(code, 3) over ({_P}) in {_text(",")} and lead(code, 4) over ({_P}) in {_text("]")} then 6
        when lag(code) over ({_P}) in {_text("(")} and lag(code, 2) over ({_P}) in {_text("array")} and lead(code, 3) over ({_P}) in {_text(")")} then 16
        when lag(code) over ({_P}) in {_text("(")} and lag(code, 2) over ({_P}) in {_text("array")} and lead(code, 3) over ({_P}) in {_text(",")} and lead(code, 4) over ({_P}) in {_text(")")} then 17 end end as form
  from (
    select *, case when kind in ('T_STRING', 'T_NAME_FULLY_QUALIFIED') then {_number(r"regexp_replace(lower(text), r'^\\+', '')", _CALLED, 0)} else 0 end as called,
      case when kind <> 'T_STRING' or {_BOUNDARY} then 0 else {_number("text", _LABELS, 9)} end as label from coded) t),
tainted as (select /*+ shuffle_hash(a) */ p.*, p.request or coalesce(array_contains(a.known, p.text), false) as tainted from placed p left join aliases a on a.file = p.file),
summed as (
  select file, seq, line, code, eval, include, pos, last, level, ticks, n_dynamic, n_variable, n_dot, n_part, n_loose, called, called_seq, called_line, before_called, label, {_count("tainted")} as n_tainted,
    case when label > 0 then cast(dynamic_1 as int) + cast(dynamic_2 as int) else 0 end as label_dynamic, case when label > 0 then cast(lead(tainted) over ({_P}) as int) + cast(lead(tainted, 2) over ({_P}) as int) else 0 end as label_tainted,
    case when label > 0 then lead(form, 4) over ({_P}) else lead(form, 2) over ({_P}) end as list_form, case when label > 0 then lead(form, 5) over ({_P}) else lead(form, 3) over ({_P}) end as call_form from tainted),
events as (
  select *, lead(case when {_END} or last then named_struct('n_part', n_part, 'n_loose', n_loose, 'n_tainted', n_tainted) end) ignore nulls over ({_P}) as ended, case when {_BOUNDARY} then level end as bracket
  from summed where {_BOUNDARY} or {_END} or last or eval or include or code in {_text("`")}),
opened as (
  select * except (bracket), last_value(case when {_OPEN} then named_struct('pos', pos, 'ticks', ticks, 'n_dynamic', n_dynamic, 'called', case when code in {_text("(")} then called else 0 end) end) ignore nulls over (partition by file, bracket order by pos {_UPTO}) as opening
  from events where {_BOUNDARY} or eval or include or code in {_text("`")}),
shields as (
  select *, {_BOUNDARY} and coalesce(opening.called > 1, false) as argues, coalesce(opening.called in {_called("escapeshellarg")} and {_OPEN}, false) as shield_begins, coalesce(opening.called in {_called("escapeshellarg")} and {_CLOSE}, false) as shield_ends,
    n_dynamic - opening.n_dynamic + 1 as n_shielded from opened),
covered as (
  select *, sum(case when shield_begins then 1 when shield_ends then -1 else 0 end) over (partition by file order by pos {_UPTO}) - case when shield_begins then 1 else 0 end as cover from shields),
escaped as (
  select *, sum(case when shield_ends then n_shielded else 0 end) over (partition by file, cover order by pos {_UPTO}) as n_escaped from covered where argues or shield_ends or eval or include or code in {_text("`")}),
units as (
  select *, case when argues then 'call' when eval or include then 'word' else 'ticks' end as role, case when argues then opening.pos when eval or include then pos else floor((ticks - 1) / 2) end as unit
  from escaped where argues or eval or include or code in {_text("`")} or (ticks % 2 = 1 and opening.ticks = ticks)),
parts as (
  select *, row_number() over (u) - 1 as argument, sum(case when label > 0 then 1 else 0 end) over (u) as n_labels, lead(pos) over (u) - pos - 1 as n_all, lead(n_dot) over (u) > n_dot and lead(n_variable) over (u) > n_variable as joined,
    lead(n_tainted) over (u) - n_tainted - label_tainted > 0 as tainted, lead(n_dynamic) over (u) - n_dynamic - (lead(n_escaped) over (u) - n_escaped) - label_dynamic > 0 as dynamic
  from units window u as (partition by file, role, unit order by pos)),
arguments as (
  select *, case when label = 0 then argument - n_labels end as nth, case when called in {_called("unserialize")} then 1 when called in {_called("extract")} then 2 else 3 end as first_label,
    coalesce((list_form in (5, 6) and list_form = n_all - skipped) or (call_form in (16, 17) and call_form = n_all - skipped + 10), false) as safe
  from (select * except (called), case when argues then opening.called else 0 end as called, case when label > 0 then 2 else 0 end as skipped from parts) t),
found as (
  select file, role, max(called) as called, min_by(struct(case when role = 'call' then called_seq else seq end as seq, case when role = 'call' then called_line else line end as line, before_called, eval, n_part, n_loose, n_tainted, coalesce(ended, struct(n_part, n_loose, n_tainted)) as ended, n_dynamic), pos) as top,
    min(case when n_all > 0 and (label = first_label or nth = 0) then struct(label = 0 as plain, argument, tainted, dynamic) end) as first, min(case when n_all > 0 and (label = 4 or nth = 1) then struct(label = 0 as plain, argument, safe) end) as second, bool_or(argument = 0 and n_all > 0 and joined) as joined,
    count_if({_CLOSE}) as n_closed, count_if(code in {_text("`")}) as n_ticks, max(n_dynamic) filter (where code in {_text("`")}) as upto_dynamic,
    array_sort(collect_list(case when role = 'ticks' and shield_ends then struct(opening.pos as begins, pos as ends, n_shielded) end)) as shields
  from arguments group by file, role, unit),
judged as (
  select *, case when role = 'word' and top.eval then {_found('eval')}
    when role = 'word' then case when top.ended.n_part = top.n_part or top.ended.n_loose > top.n_loose then {_found('variable-include', "case when top.ended.n_tainted > top.n_tainted then 'high' else 'medium' end")} end
    when role = 'ticks' then case when n_ticks = 2 and upto_dynamic - top.n_dynamic > aggregate(shields, named_struct('upto', cast(0 as int), 'n', cast(0 as bigint)), (s, x) -> case when x.begins > s.upto then named_struct('upto', x.ends, 'n', s.n + x.n_shielded) else s end, s -> s.n) then {_found('dynamic-shell')} end
    when n_closed = 0 then null
    when called in {_called("unserialize")} and not not_global and first.tainted and not coalesce(second.safe, false) then {_found('request-unserialize')}
    when called in {_called("extract")} and not not_global then {_found('extract', "case when first.tainted then 'high' else 'medium' end")}
    when called in {_called(*SHELL)} and not not_global then case when first.dynamic then {_found('dynamic-shell')} end
    when called in {_called(*SQL)} and member and joined then {_found('concatenated-sql', "'medium'")} end as f
  from (select *, top.before_called in {_text("->", "?->", "::")} as member, top.before_called in {_text("->", "?->", "::", "function", "new")} as not_global from found) t)
select case when file <> '' then substring(file, 2) end as path, top.seq as seq, top.line as line, 'security.php.' || f.rule as rule, f.severity as severity from judged where f is not null
""", "ev_tokens", check="", rows_each=500_000)

_KINDS = {"eval": "T_EVAL", "include": "T_INCLUDE", "include_once": "T_INCLUDE_ONCE", "require": "T_REQUIRE", "require_once": "T_REQUIRE_ONCE", "array": "T_ARRAY", "new": "T_NEW", "function": "T_FUNCTION", "__DIR__": "T_DIR"}


def sample_tokens(code: str) -> list[tuple[str, str]]:
    """Kinds and texts of a sample line. Backticks, and double quotes around a variable, are given as their parts."""
    out = []
    for text in re.findall(r"`[^`]*`|\$\w+|\\?[A-Za-z_]\w*|'[^']*'|\"[^\"]*\"|\?->|->|::|=>|[^\s\w]", code):
        if text[0] == '"' and "$" in text or len(text) > 1 and text[0] == "`":
            out += [("", text[0]), *(("T_VARIABLE" if p[0] == "$" else "T_ENCAPSED_AND_WHITESPACE", p) for p in re.findall(r"\$\w+|[^$]+", text[1:-1])), ("", text[0])]
            continue
        kind = "T_VARIABLE" if text[0] == "$" else "T_CONSTANT_ENCAPSED_STRING" if text[0] in "'\"" else "T_NAME_FULLY_QUALIFIED" if text[0] == "\\" and len(text) > 1 else _KINDS.get(text, "T_STRING" if re.match(r"\w", text) else "")
        out.append((kind, text))
    return out


#: Sample lines with the place of the token that is named, the rule and its severity; none: nothing is named.
SAMPLES = (
    ("eval($_GET['code']);", 0, "eval", "high"), ("unserialize($_POST['data']);", 0, "request-unserialize", "high"), ("$data=$_GET['data']; unserialize($data);", 7, "request-unserialize", "high"), ("$a=input('x'); $b=$a; $c='l'; unserialize($b);", 15, "request-unserialize", "high"),
    ("system(\"echo $value\");", 0, "dynamic-shell", "high"), ("exec(\"echo \".$value);", 0, "dynamic-shell", "high"), ("`echo $value`;", 0, "dynamic-shell", "high"), ("$db->query(\"SELECT 1 WHERE id=\".$id);", 2, "concatenated-sql", "medium"),
    ("DB::raw(\"SELECT \".$column);", 2, "concatenated-sql", "medium"), ("extract($_GET);", 0, "extract", "high"), ("extract($rows);", 0, "extract", "medium"), ("extract();", 0, "extract", "medium"), ("require $_GET['path'];", 0, "variable-include", "high"), ("include($file);", 0, "variable-include", "medium"),
    ("unserialize($_POST['d'], ['allowed_classes'=>false, 'allowed_classes'=>true]);", 0, "request-unserialize", "high"), ("exec('echo ' . escapeshellarg($safe) . $unsafe);", 0, "dynamic-shell", "high"), ("\\unserialize($_POST['data']);", 0, "request-unserialize", "high"),
    ("unserialize(data: $_POST['payload']);", 0, "request-unserialize", "high"), ("unserialize(options: ['allowed_classes'=>true], data: $_POST['payload']);", 0, "request-unserialize", "high"), ("exec(result_code: $code, command: 'echo ' . $unsafe);", 0, "dynamic-shell", "high"),
    ("unserialize('a:0');", 0, None, None), ("unserialize($_POST['x'], ['allowed_classes'=>false]);", 0, None, None), ("unserialize($_POST['x'], array('allowed_classes'=>false,));", 0, None, None), ("system('echo ' . escapeshellarg($_GET['x']));", 0, None, None), ("exec('printf hello');", 0, None, None),
    ("unserialize(options: ['allowed_classes'=>false], data: $_POST['payload']);", 0, None, None), ("exec(result_code: $code, command: 'echo ' . \\escapeshellarg(arg: $_GET['x']));", 0, None, None), ("$db->prepare('SELECT 1')->execute([$id]);", 0, None, None), ("$db->query('SELECT 1', [$id . 'x']);", 0, None, None),
    ("include 'literal.php';", 0, None, None), ("require_once('other.php');", 0, None, None), ("include __DIR__ . '/literal.php';", 0, None, None), ("function unserialize($_POST) { return 1; };", 0, None, None), ("new system($x);", 0, None, None), ("$o->extract($_GET);", 0, None, None), ("`echo hello`;", 0, None, None), ("$x = [exec, (1), {2}];", 0, None, None),
)
_sql = lambda t: "'" + t.replace("'", "''").replace("{", "{{").replace("}", "}}").replace("\\", "\\\\") + "'"
_plain = lambda t: "'" + t.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"
_EV = """select 'f' || cast(cast(floor(o_orderkey / 40) as bigint) as string) || '.php' as path, o_orderkey * 100 + i as seq, kind, case when kind = 'T_VARIABLE' and not startswith(text, '$_') then text || cast(o_orderkey as string) else text end as text, o_orderkey % 40 + 1 as line
from {{orders}} join (values {0}) as s(sample, i, kind, text) on s.sample = o_orderkey % {1}"""
_rows = lambda quote: ", ".join(f"({k}, {i}, '{kind}', {quote(text)})" for k, (code, *_) in enumerate(SAMPLES) for i, (kind, text) in enumerate(sample_tokens(code)))
relation("ev_tokens", _EV.format(_rows(_sql), len(SAMPLES)), "orders", check=_EV.format(_rows(_plain), len(SAMPLES)))
CHECK = (), f"""SELECT 'f' || (o_orderkey // 40) || '.php' AS path, o_orderkey * 100 + i AS seq, o_orderkey % 40 + 1 AS line, 'security.php.' || rule AS rule, severity
FROM orders JOIN (VALUES {', '.join(f"({k}, {i}, '{rule}', '{severity}')" for k, (_, i, rule, severity) in enumerate(SAMPLES) if rule)}) AS s(sample, i, rule, severity) ON s.sample = o_orderkey % {len(SAMPLES)}"""


def token_findings(tokens: DataFrame) -> DataFrame:
    """path, seq, line, rule and severity of what the seven rules find in tokens (path, seq, kind, text, line)."""
    return RELATIONS["token_findings"].over(ev_tokens=tokens)
