"""Alignment of two tokenizers against a plain model of it, with the libraries themselves."""

import hashlib
import os
from collections import Counter, defaultdict

import pandas as pd
import pytest

from tidemark.llm import alignment, packing, pieces
from tidemark.llm.queries import QUERIES

DATA = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "one"), (5, "  two  spaces \n\n and\ttabs "), (6, "<|endoftext|> <s> </s> <0x41> it's"), (7, "a▁b"), (8, "éü中文\U0001f600 ①　x y ​﻿ z"),
    (None, "one"), (4, "one"), (9, "x" * 3000 + " \n" + "中" * 500), (10, "naïve café \x00\x1c \x85 end"), (11, "word other third " * 2000), (12, "\nfirst second"), (13, "second \nfirst"),
]


def brute(rows):
    """Everything by its definition, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    alphabet = packing.byte_alphabet()
    docs, held = [], Counter()
    for _, text in rows:
        raw, groups = (" " + (text or "")).encode(), []
        if text:
            a = [(i, bytes(alphabet[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                i = j = at_a = at_b = 0
                while i < len(a):
                    own_a, own_b = [], []
                    while not own_a or at_a != at_b:
                        if at_a <= at_b:
                            own_a.append(a[i][0])
                            at_a, i = at_a + len(a[i][1]), i + 1
                        else:
                            own_b.append(b[j][0])
                            at_b, j = at_b + len(b[j][1]), j + 1
                    groups.append((own_a, own_b))
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        docs.append((groups, links))
        held.update(links.keys())
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (doc_id, _), (groups, links) in zip(rows, docs):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == top[k[0]]),
            sum(n * held[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return Counter(out)


def results(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_the_query_equals_the_plain_model_on_the_whole_table(spark):
    d = pd.read_parquet(f"{DATA}/documents.parquet")
    assert results(QUERIES["op13_cross_tokenizer_alignment"](spark, DATA)) == brute(list(zip(d.doc_id.tolist(), d.text.tolist())))


@pytest.mark.parametrize("most", [alignment.PAIRS, 200, 0])
def test_odd_texts_with_all_some_and_no_counts_broadcast(spark, most):
    docs = spark.createDataFrame([(i, t, "x", "x", 1) for i, t in ODD], "doc_id long, text string, n string, code string, uid int")
    assert results(alignment.align(docs, digest=True, most=most)) == brute(ODD)


def test_groups_are_given_as_text(spark):
    (row,) = alignment.align(spark.createDataFrame([(1, "naïve")], "doc_id long, text string")).collect()
    assert row.groups.count(";") == row.n_groups - 1 and row.groups.count("|") == row.n_groups


def test_a_forgetful_worker_gives_the_same(spark, monkeypatch):
    import json
    from pathlib import Path

    import public_tokenizers

    shipped = (json.loads(Path(packing.tokenizer_file()).read_text()), public_tokenizers.PATTERN, Path(pieces.model_file()).read_bytes())
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    monkeypatch.setattr(alignment, "AT_ONCE", 2)
    aligner = alignment.Aligner(*shipped)
    texts = [t for _, t in ODD]
    links = []
    for _, _, at, starts in aligner.placed(texts):
        total = [0, *aligner.facts[3].all()[at].cumsum().tolist()]
        links += [total[e] - total[s] for s, e in zip(starts[:-1], starts[1:])]
    expected = Counter(x[4] for x in brute(ODD).elements())
    assert Counter(links) == expected


def test_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
