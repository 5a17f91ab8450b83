"""Which shingles count as frequent decides an order only: with none or any of them last, the same documents link."""

import random

import numpy as np
import pytest

from tidemark.llm import jaccard
from tidemark.llm.textvec import shingle_sets


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(30, 120))]
        out.append(" ".join(base))
        for changed in (1, 1, 2, 4):
            copy = list(base)
            for _ in range(changed):
                copy[r.randrange(len(copy))] = "new"
            out.append(" ".join(copy))
    return out


def expected(sets):
    least = list(range(len(sets)))
    for _ in sets:  # as often as a path can be long
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if 100 * len(x & y) >= 80 * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
    return least


@pytest.mark.parametrize("last", ["none", "some"])
def test_the_order_of_shingles_changes_no_link(spark, monkeypatch, last):
    import pyarrow as pa

    given = texts()
    sets = list(shingle_sets(pa.array(given), jaccard.WORDS))
    known = np.unique(np.concatenate(sets))
    chosen = {"none": known[:0], "some": known[np.random.default_rng(1).random(len(known)) < 0.3]}[last]
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda docs: chosen)
    rows = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect()
    found = expected([frozenset(s.tolist()) for s in sets])
    assert len(set(found)) < len(found)
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(found))
