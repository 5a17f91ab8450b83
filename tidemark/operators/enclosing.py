"""J-11: qualified names by place, and the innermost declaration around a line.

Declarations of one file nest. The join takes no product of lines and declarations, and no file is one group: lines are
dealt into buckets of BUCKET lines, and a bucket is swept in order of lines with a running number of open declarations. The
declaration that made the current number is the innermost one if it began in this bucket; else it is the one that was open
at this level when the bucket began. Only declarations that reach from one bucket into others are listed there, once for
each bucket and level, so these rows follow lines and depth. A declaration that begins on a line is met in the same sweep.
The first parts are as many as the rows ask for; a task's peak memory still grew with the input when measured (README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.relation import RELATIONS, relation

BUCKET = 512

# Orders as declarations: classes over a thousand and over ten orders, a function for each order, a function in every
# fourth. A third of all is one file.
_FILE = "case when floor({0} / 1000) % 3 = 0 then 'hot.py' else 'f' || cast(cast(floor({0} / 1000) as bigint) as string) || '.py' end"
_DECLARED = """select {path} as path, {name} as name, cast(o_orderkey * 10 + {first} as bigint) as start_line, cast(o_orderkey * 10 + {last} as bigint) as end_line from {{orders}} where {rule}"""
_CLASSES = "'K' || cast(cast(floor(o_orderkey / 1000) as bigint) as string)"
_OWNERS = f"{_CLASSES} || '.C' || cast(cast(floor(o_orderkey / 10) as bigint) as string)"
_OWNER = f"{_OWNERS} || '.f' || cast(o_orderkey as string)"
relation("ev_declarations", " union all ".join(
    _DECLARED.format(path=_FILE.format("o_orderkey"), name=name, first=first, last=last, rule=rule) for name, first, last, rule in (
        (_CLASSES, 0, 9999, "o_orderkey % 1000 = 0"), (_OWNERS, 1, 98, "o_orderkey % 10 = 0"), (_OWNER, 2, 8, "o_orderkey % 7 <> 3"),
        (_OWNER + " || '.g' || cast(o_orderkey as string)", 4, 6, "o_orderkey % 4 = 0 and o_orderkey % 7 <> 3"),
    )
), "orders")
relation("ev_observations", f"""
select {_FILE.format("l_orderkey")} as path, cast(l_orderkey * 10 + l_partkey % 10 as bigint) as line, 'C.' || case l_partkey % 10 when 4 then 'g' when 2 then 'f' else 's' end || cast(l_orderkey as string) as function
from {{lineitem}}
""", "lineitem")

relation("enclosing_names", f"""
with d as (select path, name, start_line, end_line, cast(floor(start_line / {BUCKET}) as bigint) as first, cast(floor(end_line / {BUCKET}) as bigint) as last from {{ev_declarations}}),
reaching as (select path, explode(sequence(first + 1, last)) as bucket from d where last > first),
already as (select path, bucket, count(*) as open from reaching group by path, bucket),
step as (
  select /*+ repartition({{parts}}, path, bucket) */ * from (select path, first as bucket, start_line as line, 0 as kind, - end_line as outer_first, 1 as opens, name, last, cast(null as string) as function from d
  union all select path, cast(floor(line / {BUCKET}) as bigint), line, 1, 0, 0, null, null, function from {{ev_observations}}
  union all select path, last, end_line, 2, 0, -1, null, null, null from d) u),
depth as (
  select s.*, last_value(case when s.kind = 0 then named_struct('line', s.line, 'name', s.name) end) ignore nulls over (partition by s.path, s.bucket order by s.line, s.kind, s.outer_first rows between unbounded preceding and current row) as begun,
    coalesce(a.open, 0) + sum(s.opens) over (partition by s.path, s.bucket order by s.line, s.kind, s.outer_first rows between unbounded preceding and current row) as level
  from step s left join already a on a.path = s.path and a.bucket = s.bucket),
held as (select path, level, name, explode(sequence(bucket + 1, last)) as bucket from depth where kind = 0 and last > bucket),
here as (
  select *, last_value(name) ignore nulls over (partition by path, bucket, level order by line, kind, outer_first rows between unbounded preceding and current row) as own
  from (select /*+ repartition({{parts}}, path, bucket, level) */ * from depth) p)
select h.path, h.line, h.function, coalesce(h.own, b.name) as enclosing,
  case when h.path is not null and h.begun.line = h.line and regexp_replace(h.function, '^.*[.]', '') = regexp_replace(h.begun.name, '^.*[.]', '') then h.begun.name else h.function end as qualified
from here h left join held b on b.path = h.path and b.bucket = h.bucket and b.level = h.level where h.kind = 1
""", "ev_declarations", "ev_observations", check="", rows_each=500_000)

CHECK = (), """SELECT o.path, o.line, o.function, n.enclosing, CASE WHEN split_part(d.name, '.', -1) = split_part(o.function, '.', -1) THEN d.name ELSE o.function END AS qualified
FROM ev_observations o
LEFT JOIN (SELECT p.path, p.line, arg_max(d.name, d.start_line * 1000000 - d.end_line) AS enclosing
  FROM (SELECT DISTINCT path, line FROM ev_observations) p JOIN ev_declarations d ON d.path = p.path AND d.start_line <= p.line AND p.line <= d.end_line GROUP BY ALL) n ON n.path = o.path AND n.line = o.line
LEFT JOIN ev_declarations d ON d.path = o.path AND d.start_line = o.line"""


def enclosing(observations: DataFrame, declarations: DataFrame) -> DataFrame:
    """observations (path, line, function) with the innermost of the nested declarations (path, name, start_line, end_line)
    around each, null outside all, and the qualified name: that of a declaration which begins on the line, if its last
    part is the function's, else the function as it was."""
    return RELATIONS["enclosing_names"].over(ev_declarations=declarations, ev_observations=observations)
