"""Personal data in forms that the base patterns don't know."""

import hashlib
import math

import pytest

from tidemark.llm import pii

NAMES = "ann bob carla dan eve finn gina hugo ina jan".split()


def card(i):
    d = f"4{i * 7919 % 10**14:014d}"
    d += next(str(c) for c in range(10) if pii.luhn(d + str(c)))
    return " ".join(d[k : k + 4] for k in range(0, 16, 4))


@pytest.fixture(scope="module")
def spans(spark):
    known = [f"write to {NAMES[i % 10]}{i}@site{i % 7}.example.com or call +1 (555) {100 + i}-{4000 + i}, card {card(i)}, host 10.{i}.3.{i + 1} end" for i in range(160)]
    other = {
        "told": "mail john [at] example [dot] com today", "card": f"paid with {card(999).replace(' ', '.')} today", "hex": "host 2001:db8:a:0:0:ff:ffff:a00 is up",
        "phone": "please call 1 (555) 321-9876 today", "wrong": f"paid with {card(999).replace(' ', '.')[:-1]}{(int(card(999)[-1]) + 5) % 10} today",
        "mac": "card 0a:1b:2c:3d:4e:5f is up", "plain": "order 15553219876 came",
    }
    rows = list(enumerate([*known, *other.values()]))
    out = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return {name: out[len(known) + i] for i, name in enumerate(other)}


@pytest.mark.parametrize("name, span", [("told", "other_email:5:32"), ("card", "other_card:10:29"), ("hex", "other_ip:5:31"), ("phone", "other_phone:12:28")])
def test_other_forms_are_found(spans, name, span):
    assert span in spans[name].split(",")


@pytest.mark.parametrize("name", ["wrong", "mac", "plain"])
def test_look_alikes_are_left(spans, name):
    assert spans[name] == ""


def test_the_model_learns_from_every_candidate(spark, monkeypatch):
    monkeypatch.setattr(pii, "PER_GROUP", 5, raising=False)
    monkeypatch.setattr(pii, "TREES", 2)
    texts = [f"write to {NAMES[i % 10]}{i}@site{i % 7}.example.com or call +1 (555) {100 + i}-{4000 + i}, card {card(i)}, host 10.{i}.3.{i + 1} end" for i in range(60)]
    model = pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    own = [e for t in texts if hashlib.blake2b(t.encode(), digest_size=1).digest()[0] % 2 == 0 for e in pii.examples(t)]
    yes, no = (sum(w for _, label, w, _ in own if label == y) for y in (1, 0))
    assert math.isclose(model.trees.start, math.log((yes + 0.5) / (no + 0.5)), rel_tol=1e-9)
