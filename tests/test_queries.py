"""Every driver query with a check statement equals DuckDB's answer on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(round(float(v), 9)) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_engines_agree(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(registry.ORACLE_SQL[name])
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == columns
    assert ours == sorted(tuple(plain(r[theirs.index(c)]) for c in columns) for r in answer.fetchall())
