"""Pairs that only share a hash are ruled out by their counts before any set is made; those that link stay."""

import random

from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.common import written


def test_sets_are_made_for_pairs_within_the_bound_only(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(30)]
    near = texts[0].split()
    near[150] = "other"
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(100, " ".join(near)), (101, texts[3] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, shared = jaccard.with_names(docs)
    side = lambda k: made.select(F.col("node").alias(k))
    pairs = side("a").crossJoin(side("b")).where("a < b")
    sizes = {}

    def kept(df, label):
        out = written(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", kept)
    links = {(r["a"], r["b"]) for r in jaccard.verified(docs, made, pairs, shared).collect()}
    name = {r["doc_id"]: r["node"] for r in made.collect()}
    assert links == {tuple(sorted((name[x], name[y]))) for x, y in ((0, 100), (None, 101))}
    assert sizes["pairs"] == 32 * 31 // 2 and sizes["sets"] <= 8
