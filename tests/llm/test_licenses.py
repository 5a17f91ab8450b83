"""License scans against regular expressions made of the same markup, over the whole table and planted licence texts."""

import os
import random
import re
from collections import Counter

import pandas as pd
import pytest

from tidemark.llm import licenses
from tidemark.llm.licenses import TEMPLATES, Automaton
from tidemark.llm.queries import QUERIES

DATA = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def pattern(markup):
    """The template as a backtracking expression over words that each end with a space."""
    out = []
    for part in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if part == "<<optional>>":
            out.append("(?:")
        elif part == "<<end>>":
            out.append(")?")
        elif part.startswith("<<var"):
            low, high, *word = re.match(r"<<var (\d+)-(\d+)(?: (.*))?>>", part).groups()
            out.append(f"(?:(?:{word[0] or '[^ ]+'}) ){{{low},{high}}}")
        else:
            out += [re.escape(w) + " " for w in WORD.findall(part.translate(LOWER))]
    return re.compile("(?<![^ ])" + "".join(out))


MODELS = {label: pattern(t) for label, t in TEMPLATES.items()}


def brute(text, named=MODELS):
    words = WORD.findall((text or "").translate(LOWER))
    joined = "".join(w + " " for w in words)
    base = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    inside = {k + x for k, label in base for p, y in PHRASES.items() if y == label for x in range(len(p.split()))}
    labels = {label for _, label in base}
    for label, p in named.items():
        for m in p.finditer(joined):
            labels.add(label)
            inside |= set(range(joined.count(" ", 0, m.start()), joined.count(" ", 0, m.end())))
    at = [k for k, _ in base]
    return (
        len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)),
        round(len(inside) / len(words), 12) if words else 0.0,
    )


def result(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 12)


def written_out(markup, seed):
    """A text that follows the template: some regions left out, others filled."""
    r, out, held = random.Random(seed), [], [True]
    for part in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if part == "<<optional>>":
            held.append(held[-1] and r.random() < 0.5)
        elif part == "<<end>>":
            held.pop()
        elif held[-1] and part.startswith("<<var"):
            low, high, word = re.match(r"<<var (\d+)-(\d+)(?: (.*))?>>", part).groups()
            out += [{"https?": "https", "[1-4]": "4", "[05]": "0", "lesser|library": "Lesser"}[word] if word else f"Name{k}" for k in range(r.randint(int(low), int(high)))]
        elif held[-1]:
            out += part.split()
    return " * ".join(out) if seed % 2 else "\n// ".join(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_the_query_equals_the_model_on_the_whole_table(spark):
    d = pd.read_parquet(f"{DATA}/documents.parquet")
    texts = dict(zip(d.doc_id, d.text))
    rows = QUERIES["op12_license_scans"](spark, DATA).collect()
    assert {r.doc_id: result(r) for r in rows} == {i: brute(t) for i, t in texts.items()} and len(rows) == len(d)
    assert any(r.labels != r.base_labels for r in rows)


def test_each_template_is_found_in_any_form_and_not_with_other_wording(spark):
    rows, expected = [], {}
    for label, markup in TEMPLATES.items():
        for seed in range(6):
            text = written_out(markup, seed)
            words = [m.span() for m in WORD.finditer(text.translate(LOWER))]
            mandatory = Automaton(label, markup).anchor.split()[0].decode()
            at = next(s for s, e in words if text[s:e].lower() == mandatory)
            for kind, t in (("whole", "Before. " + text + " After it."), ("twice", text + " filler" * 60 + "\n" + text), ("changed", text[:at] + "x" + text[at:])):
                rows.append((len(rows), t))
                expected[len(rows) - 1] = (kind, label)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licenses.license_scan(docs).collect():
        assert result(r) == brute(rows[r.doc_id][1]), expected[r.doc_id]
        kind, label = expected[r.doc_id]
        if kind != "changed":
            assert label in r.labels.split(",")
    places = {r.doc_id: r.places for r in licenses.license_places(docs).collect()}
    for i, (kind, label) in expected.items():
        own = [p for p in places[i] if p.label == label and not p.base]
        assert kind == "changed" or len(own) >= (2 if kind == "twice" else 1)


def test_edges(spark):
    texts = [None, "", " \t", "mit", "MIT License", "mit  license mit-license", "cc by cc by cc", "İMIT license É", "gnu general public", "GNU General Public License v3 apache license", "x " * 50_000 + "Apache\nLicense"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "cc by", "x", 1), (4, "MIT License", "x", 1)], "doc_id long, text string, places string, n_words int")
    rows = licenses.license_scan(docs).collect()
    assert Counter(map(result, rows)) == Counter([*map(brute, texts), brute("cc by"), brute("MIT License")])
    assert licenses.license_scan(docs.where("false")).collect() == []


def test_regions_nest_and_ends_are_the_farthest():
    a = Automaton("x", "one <<optional>>two <<optional>>three<<end>><<end>> <<var 1-3 [a-c]>> four")
    for text, end in (("one a four", 3), ("one two b c four", 5), ("one two three a b c four", 7), ("one three a four", 0), ("one a b c a four", 0), ("one a x four", 0), ("one four", 0)):
        assert a.end(text.encode().split(), 0) == end
    assert a.anchor in (b" one ", b" four ")
    with pytest.raises(ValueError):
        Automaton("y", "<<optional>>only<<end>>")
    with pytest.raises(ValueError):
        Automaton("y", "one <<optional>> two")


def test_many_anchors_are_linear():
    a, text = Automaton("x", "a b <<var 0-40>> z"), b"a b ".split() * 30_000
    assert a.places(text, b" " + b" ".join(text) + b" ") == []
