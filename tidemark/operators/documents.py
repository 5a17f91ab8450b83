"""Tools' JSON documents as VARIANT: shape guards and counts across components (F-38, A-23), and decisions of nested syntax
documents (F-27). A bad document is one failed row with its reason, never a failed job.

A document is parsed inside a wrapper, so that text after its end is noticed. An integer is what is written without point
or exponent and fits 64 bits; a truth value is none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.relation import RELATIONS, relation

#: Levels of a syntax document that are walked; deeper ones are said to be limited.
MAX_LEVELS = 90


def parsed(text: str) -> str:
    """The document as VARIANT; null if it isn't one whole JSON document."""
    wrapper = f"""try_parse_json(concat('{{{{"v":', {text}, ',"end":0}}}}'))"""
    return f"case when map_size(try_variant_get({wrapper}, '$', 'map<string, variant>')) = 2 then try_variant_get({wrapper}, '$.v', 'variant') end".replace("map_size(", "cardinality(")


def is_object(v: str) -> str:
    return f"coalesce(startswith(schema_of_variant({v}), 'OBJECT<'), false)"


def is_list(v: str) -> str:
    return f"coalesce(startswith(schema_of_variant({v}), 'ARRAY<'), false)"


def count(v: str) -> str:
    """A nonnegative integer, else null."""
    return f"case when schema_of_variant({v}) = 'BIGINT' and try_variant_get({v}, '$', 'bigint') >= 0 then try_variant_get({v}, '$', 'bigint') end"


def at(v: str, key: str) -> str:
    return f"try_variant_get({v}, '$.{key}', 'variant')"


# Orders as reports on o_orderkey % 5 + 1 files, of which many are wrong in one way each.
_N = "(o_orderkey % 5 + 1)"
_BAD = "o_orderkey % 29"
_PART = {
    "schema": f"case {_BAD} when 3 then '2' when 4 then 'true' when 5 then '1.0' else '1' end",
    "total": f"case {_BAD} when 7 then '\"3\"' when 12 then cast(o_orderkey % 5 + 2 as string) else cast(o_orderkey % 5 + 1 as string) end",
    "analyzed": f"case {_BAD} when 8 then '-1' when 11 then '0' when 12 then cast(o_orderkey % 5 + 2 as string) when 23 then cast(o_orderkey % 5 as string) else cast(o_orderkey % 5 + 1 as string) end",
    "skipped": f"case {_BAD} when 9 then 'true' when 10 then '1' when 11 then cast(o_orderkey % 5 + 1 as string) when 23 then '1' else '0' end",
}
_FILES = f"""case when {_BAD} = 23 or {_BAD} = 17 then '' else '{{{{"file_path":"f0.py"}}}}' end
  || case when o_orderkey % 5 >= 1 then case when {_BAD} in (17, 23) then '' else ',' end || '{{{{"file_path":"f1.py","n":1}}}}' else '' end
  || case when o_orderkey % 5 >= 2 then ',{{{{"file_path":"f2.py"}}}}' else '' end || case when o_orderkey % 5 >= 3 then ',{{{{"file_path":"f3.py"}}}}' else '' end || case when o_orderkey % 5 >= 4 then ',{{{{"file_path":"f4.py"}}}}' else '' end
  || case {_BAD} when 15 then ',5' when 16 then ',{{{{"file_path":"f0.py"}}}}' when 22 then ',{{{{"file_path":7}}}}' else '' end""".replace("{{{{", "{{").replace("}}}}", "}}")
_TEXT = f"""'{{{{"schema_version":' || {_PART["schema"]} || ',"summary":' || case when {_BAD} = 6 then '[1]' else '{{{{"total_files":' || {_PART["total"]} || ',"analyzed_files":' || {_PART["analyzed"]} || ',"skipped_files":' || {_PART["skipped"]} || '}}}}' end
  || ',"complexity":' || case when {_BAD} = 13 then 'null' else '{{{{"raw_metrics":' || case when {_BAD} = 14 then '{{{{}}}}' else '[' || {_FILES} || ']' end || case {_BAD} when 18 then ',"errors":["x"]' when 19 then '' else ',"errors":[]' end || '}}}}' end || '}}}}'"""
relation("ev_summaries", f"""
select o_orderkey as doc_id, eligible, case when bad = 1 then substring(text, 1, length(text) - 1) when bad = 2 then '[' || text || ']' when bad = 20 then text || ']' when bad = 21 then null else text end as text
from (select o_orderkey, {_N} as eligible, {_BAD} as bad, {_TEXT} as text from {{orders}}) t
""", "orders")

relation("summary_guard", f"""
with d as (select doc_id, eligible, {parsed("text")} as v from {{ev_summaries}}),
s as (select *, {at("v", "summary")} as summary, {at("v", "complexity")} as complexity, {at("v", "schema_version")} as version from d),
c as (
  select *, {count(at("summary", "total_files"))} as total, {count(at("summary", "analyzed_files"))} as analyzed, {count(at("summary", "skipped_files"))} as skipped,
    {at("complexity", "raw_metrics")} as raw, {at("complexity", "errors")} as errors from s),
p as (select *, try_variant_get(raw, '$', 'array<variant>') as items from c),
r as (
  select *, transform(items, i -> {at("i", "file_path")}) as paths, case
    when v is null then 'invalid JSON output' when not {is_object("v")} then 'expected JSON object' when schema_of_variant(version) is distinct from 'BIGINT' or try_variant_get(version, '$', 'bigint') <> 1 then 'unsupported schema version'
    when not {is_object("summary")} then 'expected JSON object' when total is null or analyzed is null or skipped is null then 'expected nonnegative integer'
    when total <> eligible or analyzed + skipped <> total or analyzed = 0 then 'invalid file coverage counts' when not {is_object("complexity")} then 'expected JSON object' when not {is_list("raw")} then 'expected JSON list'
    when exists(items, i -> not {is_object("i")}) then 'expected JSON object' when not {is_list("errors")} then 'expected JSON list' end as shape from p)
select doc_id, case when reason <> '' then 'failed' when analyzed < eligible then 'limited' else 'ok' end as status, reason, case when reason = '' then analyzed end as analyzed_files, eligible as eligible_files
from (
  select *, coalesce(shape, case when exists(paths, x -> schema_of_variant(x) is distinct from 'STRING') then 'invalid source location'
    when size(paths) <> analyzed or size(array_distinct(transform(paths, x -> cast(x as string)))) <> analyzed then 'analyzed file locations disagree with summary'
    when cardinality(try_variant_get(errors, '$', 'array<variant>')) > 0 then 'component reports errors' else '' end) as reason from r) t
""", "ev_summaries", check="")

#: The reason that each way of being wrong must give.
SUMMARY_CHECK = (), """SELECT o_orderkey AS doc_id, CASE WHEN reason <> '' THEN 'failed' WHEN bad = 23 THEN 'limited' ELSE 'ok' END AS status, reason, CASE WHEN reason = '' THEN eligible - (bad = 23)::INT END::BIGINT AS analyzed_files, eligible AS eligible_files
FROM (SELECT o_orderkey, o_orderkey % 29 AS bad, o_orderkey % 5 + 1 AS eligible, CASE WHEN bad IN (1, 20, 21) THEN 'invalid JSON output' WHEN bad IN (2, 6, 13, 15) THEN 'expected JSON object' WHEN bad IN (3, 4, 5) THEN 'unsupported schema version'
  WHEN bad IN (7, 8, 9) THEN 'expected nonnegative integer' WHEN bad IN (10, 11, 12) OR bad = 23 AND eligible = 1 THEN 'invalid file coverage counts' WHEN bad IN (14, 19) THEN 'expected JSON list'
  WHEN bad IN (16, 17) THEN 'analyzed file locations disagree with summary' WHEN bad = 18 THEN 'component reports errors' WHEN bad = 22 THEN 'invalid source location' ELSE '' END AS reason FROM orders)"""

# Orders as syntax documents: one function with a number of decisions of each kind, a nested one in every second.
_IF = '\',{{"_kind":"IfClause","Cond":[{{"_kind":"Stmt"}}]}}\''
_SYNTAX = f"""'{{{{"_kind":"File","Stmts":[{{{{"_kind":"IfClause","Cond":[1]}}}},{{{{"_kind":"FuncDecl","Pos":{{{{"Line":' || cast(o_orderkey % 100 + 1 as string) || '}}}},"Name":{{{{"Value":"' || case when o_orderkey % 6 = 0 then 'a.b' else 'f' end || cast(o_orderkey as string)
  || '"}}}},"Body":{{{{"_kind":"Block","Pos":{{{{"Line":1}}}},"Stmts":[{{{{"_kind":"Lit"}}}}' || repeat({_IF}, cast(o_orderkey % 4 as int)) || repeat(',{{{{"_kind":"IfClause","Cond":[]}}}}', cast(o_orderkey % 2 as int)) || repeat(',{{{{"_kind":"ForClause"}}}}', cast(o_orderkey % 3 as int))
  || ',{{{{"_kind":"CaseClause","Items":[' || case when o_orderkey % 5 > 0 then '{{{{"_kind":"CaseItem"}}}}' || repeat(',{{{{"_kind":"CaseItem"}}}}', cast(o_orderkey % 5 - 1 as int)) else '' end || ']}}}},{{{{"_kind":"BinaryCmd","Op":"'
  || case o_orderkey % 3 when 0 then '&&' when 1 then '||' else '|' end || '","X":{{{{"_kind":"BinaryTest","Op":"&&"}}}}}}}},' || repeat('{{{{"_kind":"WhileClause","Do":[', cast(o_orderkey % 7 * 3 as int)) || '{{{{"_kind":"Lit"}}}}' || repeat(']}}}}', cast(o_orderkey % 7 * 3 as int))
  || case when o_orderkey % 2 = 1 then ',{{{{"_kind":"FuncDecl","Pos":{{{{"Line":7}}}},"Name":{{{{"Value":"g"}}}},"Body":{{{{"_kind":"Block","Stmts":[{{{{"_kind":"IfClause","Cond":[1]}}}}]}}}}}}}}' else '' end || ']}}}}}}}}]}}}}'"""
relation("ev_syntax", f"select o_orderkey as doc_id, case when o_orderkey % 31 = 0 then substring(text, 1, 50) else text end as text from (select o_orderkey, {_SYNTAX} as text from {{orders}}) t", "orders")

_NAME = "replace(replace(try_variant_get(parse_json(x), '$', 'string'), '\\\\', '\\\\\\\\'), '.', '\\\\.')"
# a document's functions come as one array, so no row of it is dealt; names and lines are read as VARIANT again
relation("shell_decisions", f"""
select doc_id, case when walk is null then 'failed' when walk.deepest < {MAX_LEVELS} then 'ok' else 'limited' end as status, case when element_at(f.names, -1) is not null then array_join(transform(f.names, x -> {_NAME}), '.') end as function,
  try_variant_get(parse_json(f.line), '$', 'bigint') as line, f.cc as cc
from (select doc_id, walk, explode(case when walk is null then array(null) else walk.functions end) as f from {{walked_syntax}}) t
""", "walked_syntax", check="")

SYNTAX_CHECK = (), """SELECT o_orderkey AS doc_id, CASE WHEN k % 31 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN k % 31 <> 0 THEN (CASE WHEN k % 6 = 0 THEN 'a\\.b' ELSE 'f' END) || k || CASE WHEN inner_one THEN '.g' ELSE '' END END AS function,
  CASE WHEN k % 31 <> 0 THEN CASE WHEN inner_one THEN 7 ELSE k % 100 + 1 END END::BIGINT AS line,
  CASE WHEN k % 31 <> 0 THEN CASE WHEN inner_one THEN 2 ELSE 1 + k % 4 + k % 3 + greatest(0, k % 5 - 1) + (k % 3 < 2)::INT + 1 + 3 * (k % 7) END END::BIGINT AS cc
FROM (SELECT o_orderkey, o_orderkey AS k, unnest([false, true]) AS inner_one FROM orders) WHERE NOT inner_one OR k % 2 = 1 AND k % 31 <> 0"""


def _decisions(node: dict) -> int:
    kind = node["_kind"]
    if kind == "IfClause":
        cond = node.get("Cond")
        return int(not (cond is None or cond is False or cond in ("", [], {}) or type(cond) is int and cond == 0))
    if kind == "CaseClause":
        return max(0, len(node["Items"]) - 1) if isinstance(node.get("Items"), list) else 0
    return int(kind in ("ForClause", "WhileClause") or kind in ("BinaryCmd", "BinaryTest") and node.get("Op") in ("&&", "||"))


def _walk(text: str | None) -> dict | None:
    """The functions of a syntax document, each with the decisions below it and outside other functions: names from the
    outermost that is named inwards and line, both as JSON, and complexity; and its deepest level. None: no node."""
    top = json.loads(text) if text else None
    if not isinstance(top, dict) or top.get("_kind") is None:
        return None
    functions, deepest, left = [], 0, [(top, None, 0)]
    while left:
        node, owner, level = left.pop()
        deepest = max(deepest, level)
        if node["_kind"] == "FuncDecl":
            name, pos = node.get("Name"), node.get("Pos")
            name, line = name.get("Value") if isinstance(name, dict) else None, pos.get("Line") if isinstance(pos, dict) else None
            above = owner["names"] if owner and owner["names"][-1] is not None else []
            owner = {"names": [*above, None if name is None else json.dumps(name)], "line": None if line is None else json.dumps(line), "cc": 1}
            functions.append(owner)
        elif owner:
            owner["cc"] += _decisions(node)
        if level < MAX_LEVELS:
            children = (c for v in node.values() for c in (v if isinstance(v, list) else (v,)))
            left.extend((c, owner, level + 1) for c in children if isinstance(c, dict) and c.get("_kind") is not None)
    return {"deepest": deepest, "functions": functions}


def summary_guard(documents: DataFrame) -> DataFrame:
    """Of documents (doc_id, eligible, text): status, reason, analyzed and eligible files."""
    return RELATIONS["summary_guard"].over(ev_summaries=documents)


def shell_decisions(documents: DataFrame) -> DataFrame:
    """Of syntax documents (doc_id, text): each named function with its decisions, or one failed row."""
    walk = F.udf(_walk, "deepest int, functions array<struct<names array<string>, line string, cc bigint>>", useArrow=True)
    whole = F.expr(f"to_json({parsed('text').replace('{{', '{').replace('}}', '}')})")
    return RELATIONS["shell_decisions"].over(walked_syntax=documents.select("doc_id", walk(whole).alias("walk")))
