"""The training-data queries over a whole small table, against brute force, exact round trips and held-out accuracy."""

import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import packing
from tidemark.llm.queries import QUERIES

DATA = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
WORD = re.compile(r"[^ \t-\r]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{DATA}/documents.parquet")
    return {i: t or "" for i, t in zip(d.doc_id, d.text)}


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: {r.doc_id: r for r in QUERIES[name](spark, DATA).collect()}


def words(t, lower=True):
    return WORD.findall(t.translate(LOWER) if lower else t)


def test_op1_and_op9_on_held_out_labels(run):
    labels = pd.read_parquet(f"{DATA}/labels.parquet").set_index("doc_id")
    for name, label, least in (("op1_toxicity", "toxic", 0.9), ("op9_quality_classifier", "quality", 0.93)):
        rows = [r for i, r in run(name).items() if r.held_out and i in labels.index]
        assert np.mean([r.predicted == labels[label][r.doc_id] for r in rows]) >= least


def test_op2_components(run, texts):
    sets, groups = {}, {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    where = {}
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in where.get(x, ())).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                of[max(root(i), root(j))] = min(root(i), root(j))
        for x in s:
            where.setdefault(x, []).append(i)
    for i in sets:
        groups.setdefault(root(i), []).append(i)
    least = {i: min(g) for g in groups.values() for i in g}
    assert {i: (r.n_shingles, r.component_id) for i, r in run("op2_ngram_jaccard_join").items()} == {i: (len(s), least[i]) for i, s in sets.items()}


def test_op3_payloads(run, texts):
    for i, r in run("op3_media_columns").items():
        raw = texts[i].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op4_base_spans(run, texts):
    def luhn(d):
        return sum(v * 2 - 9 * (v > 4) if k % 2 else v for k, v in enumerate(map(int, reversed(d)))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    for i, r in run("op4_pii").items():
        found = sorted((m.start(), k, name, m.end()) for k, (name, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, texts[i]) if ok(m.group()))
        assert hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in found).encode()).hexdigest() == r.base_sha256
        assert [r[f"n_{k}"] for k in kinds] == [sum(n == k for _, _, n, _ in found) for k in kinds]


def test_op5_base_scores(run, texts):
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = c.total(), len(c)
    base = model = 0.0
    for i, r in run("op5_lm_scoring").items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]), rel=1e-9)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def test_op6_shards(run, texts):
    assert {i: r.n_bytes for i, r in run("op6_extendible_sharding").items()} == {i: len(t.encode()) for i, t in texts.items()}


def test_op7_equals_the_library(run, texts):
    import sentencepiece

    from tidemark.llm.pieces import model_file

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file())
    for i, r in run("op7_sentencepiece").items():
        ids = np.array(sp.encode(texts[i]), "<u4")
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_op8_statistics(run, texts):
    for i, r in run("op8_quality_rules").items():
        t = texts[i]
        w = words(t, lower=False)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(windows)
        inside = {k + x for k, g in enumerate(windows) if n[g] > 1 for x in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_op10_covers_each_id_once_with_little_padding(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    rows = QUERIES["op10_packing"](spark, DATA).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, mine in by_doc.items():
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 0], "<u4").tobytes()
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    assert sum(r.length for r in rows) / (packing.SEQUENCE * len(by_sequence)) > 0.97


def test_vocabulary_is_the_file_s_own():
    with open(packing.tokenizer_file()) as f:
        assert len(json.load(f)["model"]["vocab"]) in (50_256, 50_257)  # with or without the special token


def test_pipeline_keeps_one_of_each_group_and_no_personal_data(spark, run):
    import corpus_pipeline
    from tidemark.llm.common import documents

    docs = documents(spark, DATA)
    toxic = {i for i, r in run("op1_toxicity").items() if r.predicted}
    rows = {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}
    assert rows and not rows & toxic
    kept = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    groups = {r.component_id for r in run("op2_ngram_jaccard_join").values()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == groups
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "PII", "packing"]
