"""The conversation trie against a plain one, on planted shapes, and against SQL on the whole table."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import prefixes
from tidemark.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")
NAME = "op11_conversation_prefix_trie"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, pos long, n long, cls long, top string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    built = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + v[h[c] :]) for c, v in own.items()}
    members, out = defaultdict(list), []
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    under = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            under[p[:d]].append(p)
    children = Counter(p[:-1] for p in members if p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == p)
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in under[p]),
            sum((len(members[q]) - 1) * words(q) for q in under[p]), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return Counter(out)


def ours(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def shape(seed):
    """Random conversations of few different turns, so that prefixes meet, with copies, prefixes and odd rows."""
    r, rows = random.Random(seed), []
    for c in range(0, 70, r.choice([1, 1, 3])):
        n = r.randint(0, 5)
        turns = [(t, r.choice(["user", "bot", None]), r.choice(["a b", "a  c d", "x", None, ""])) for t in range(n)]
        if r.random() < 0.4:
            turns = [(t, "user", f"long {t}") for t in range(r.choice([3, 9, 12]))]
        rows += [(c, *t) for t in turns]
    rows += [(100, None, "user", "x"), (100, None, "bot", "y"), (100, 0, None, None), (101, 5, "a", "b"), (101, 5, "a", "b"), (None, 1, "a", "b"), (None, None, None, None), (-3, 1, "a", "b"), (-20, 1, "z", "b")]
    return r.sample(rows, len(rows))


@pytest.mark.parametrize("seed", range(3))
def test_planted_shapes(spark, seed):
    rows = shape(seed)
    df = spark.createDataFrame([(*r, 9, 9, 9, "x") for r in rows], SCHEMA)
    assert ours(prefixes.conversation_prefixes(df)) == brute(rows)


def test_one_conversation_copies_and_none(spark):
    one = [(7, t, "user", f"turn {t}") for t in range(6)]
    copies = [(c, t, "user", f"turn {t} of it") for c in range(0, 12_000, 20) for t in range(5)]
    for rows in (one, copies, []):
        df = spark.createDataFrame([(*r, 9, 9, 9, "x") for r in rows], SCHEMA)
        assert ours(prefixes.conversation_prefixes(df)) == brute(rows)


def test_rounds_follow_branches_and_not_turns(spark, monkeypatch):
    """Snapshots of one long conversation, and copies of another, have no branches but at the root."""
    rows = [(20 * k, t, "user", f"turn {t}") for k in range(1, 30) for t in range(2 * k)] + [(20 * k, t, "bot", f"turn {t}") for k in range(40, 44) for t in range(80)]
    cuts, real = [], prefixes.written
    monkeypatch.setattr(prefixes, "written", lambda df, label: (cuts.append(label) if label == "runs" else None, real(df, label))[1])
    df = spark.createDataFrame([(*r, 9, 9, 9, "x") for r in rows], SCHEMA)
    assert ours(prefixes.conversation_prefixes(df)) == brute(rows)
    assert len(cuts) == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_the_whole_table_equals_sql_and_the_plain_trie(spark):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    answer = c.execute(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL[NAME]})").fetchall()
    found = ours(QUERIES[NAME](spark, DATA))
    assert found == Counter(answer)
    assert found == brute(c.execute("select conv_id, turn, role, text from conversations").fetchall())
