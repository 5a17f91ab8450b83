"""J-2: is a working folder dirty? What was captured, what the commit expects and what the index holds, as whole maps.

The three maps meet in one grouping by snapshot and path; each is null where it lacks the path. A difference of captured or
index from expected is a change, and so is an index entry of another stage than 0, which leaves the index unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.paths import in_scope
from ..plans.relation import RELATIONS, relation

_SNAPSHOT = "cast(floor(doc_id / 10) as bigint) as snapshot, relative_path as path"
relation("ev_expected", f"select {_SNAPSHOT}, case when doc_id % 3 = 0 then '100755' else '100644' end as mode, oid from {{blob_hash}} where doc_id % 97 <> 8", "blob_hash")
relation("ev_captured", f"""
select {_SNAPSHOT}, case when doc_id % 3 = 0 and doc_id % 43 <> 12 then '100755' else '100644' end as mode, case when doc_id % 61 = 7 then 'x' || oid else oid end as oid
from {{blob_hash}} where doc_id % 97 <> 8 and doc_id % 53 <> 9 and {in_scope('relative_path')}
""", "blob_hash")
relation("ev_index", f"""
select {_SNAPSHOT}, case when doc_id % 3 = 0 then '100755' else '100644' end as mode, case when doc_id % 67 = 11 then 'i' || oid else oid end as oid, case when doc_id % 83 = 5 then 2 else 0 end as stage
from {{blob_hash}} where doc_id % 97 <> 8 and doc_id % 71 <> 10
union all select {_SNAPSHOT}, '100644', oid, 3 from {{blob_hash}} where doc_id % 83 = 5
union all select {_SNAPSHOT}, '100644', oid, 0 from {{blob_hash}} where doc_id % 389 = 20 and doc_id % 97 = 8
""", "blob_hash")

relation("working_status", f"""
with rows as (
  select snapshot, path, 'captured' as side, named_struct('mode', mode, 'oid', oid) as entry, 0 as stage from {{ev_captured}}
  union all select snapshot, path, 'expected', named_struct('mode', mode, 'oid', oid), 0 from {{ev_expected}} where {in_scope('path')}
  union all select snapshot, path, 'index', named_struct('mode', mode, 'oid', oid), stage from {{ev_index}} where {in_scope('path')} or stage <> 0),
paths as (
  select snapshot, path, max(case when side = 'captured' then entry end) as captured, max(case when side = 'expected' then entry end) as expected, max(case when side = 'index' then entry end) as staged,
    max(stage) as stage from rows group by snapshot, path)
select snapshot, bool_or(captured is distinct from expected or staged is distinct from expected or stage <> 0) as dirty, not bool_or(stage <> 0) as index_known,
  count_if(captured is distinct from expected) as changed_paths, count_if(stage = 0 and staged is distinct from expected) as staged_paths, count_if(stage <> 0) as unmerged_paths
from paths group by snapshot
""", "ev_captured", "ev_expected", "ev_index", check="")

_IN_SCOPE = in_scope("path").replace("regexp_like(", "regexp_matches(").replace("r'", "'")
CHECK = (
    f"e AS (SELECT * FROM ev_expected WHERE {_IN_SCOPE}), c AS (SELECT * FROM ev_captured)",
    "u AS (SELECT DISTINCT snapshot, path FROM ev_index WHERE stage <> 0)",
    f"i AS (SELECT snapshot, path, mode, oid FROM ev_index ANTI JOIN u USING (snapshot, path) WHERE {_IN_SCOPE})",
    "x AS (SELECT snapshot, count(DISTINCT path) AS n FROM ((FROM c EXCEPT FROM e) UNION ALL (FROM e EXCEPT FROM c)) GROUP BY snapshot)",
    "y AS (SELECT snapshot, count(DISTINCT path) AS n FROM ((FROM i EXCEPT FROM e) UNION ALL (FROM e EXCEPT FROM i)) d ANTI JOIN u USING (snapshot, path) GROUP BY snapshot)",
    "z AS (SELECT snapshot, count(*) AS n FROM u GROUP BY snapshot)",
), """SELECT snapshot, coalesce(x.n, 0) + coalesce(y.n, 0) + coalesce(z.n, 0) > 0 AS dirty, z.n IS NULL AS index_known, coalesce(x.n, 0) AS changed_paths, coalesce(y.n, 0) AS staged_paths, coalesce(z.n, 0) AS unmerged_paths
FROM (SELECT snapshot FROM c UNION SELECT snapshot FROM e UNION SELECT snapshot FROM i UNION SELECT snapshot FROM u) LEFT JOIN x USING (snapshot) LEFT JOIN y USING (snapshot) LEFT JOIN z USING (snapshot)"""


def working_status(captured: DataFrame, expected: DataFrame, index: DataFrame) -> DataFrame:
    """For each snapshot whether it is dirty, whether its index is known, and the numbers of changed, staged and unmerged
    paths. Inputs have snapshot, path, mode, oid; the index also stage. A snapshot without any path has no row."""
    return RELATIONS["working_status"].over(ev_captured=captured, ev_expected=expected, ev_index=index)
