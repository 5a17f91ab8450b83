"""Every operator on null, empty, very long, tied and repeated rows, clashing column names, and empty tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, lm, media, packing, pieces, pii, quality, rules, sharding, toxicity
from tidemark.llm.common import small_batches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score string, key string, component string, shard string, n string, label string, _row string"
LONG = "word other third " * 40_000
TEXTS = [
    (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "One two three four five six"), (6, "one two three four five six"), (7, "one two three four five six"), (7, "one two three four five six"),
    (None, "one two three four five six"), (None, None), (8, LONG), (9, "é ü ñ     中文 😀 ▁ <|endoftext|> " * 5), (10, "x" * 20_000), (11, "mail a.b@c.de now +1 (555) 123-4567, then 4111 1111 1111 1111, or 10.0.0.255"),
]


@pytest.fixture(scope="module")
def docs(spark):
    small_batches(spark)
    rows = [(i, t, None if (i or 0) % 2 else "en", None if i == 5 else "s", len(t or ""), *["x"] * 8) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(3, None, None), (None, 1, 1), (4, 1, 1), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda d, y: toxicity.toxicity(d, y), "jaccard": lambda d, y: jaccard.jaccard_components(d), "media": lambda d, y: media.media_columns(d), "pii": lambda d, y: pii.personal_data(d),
    "lm": lambda d, y: lm.scores(d), "sharding": lambda d, y: sharding.shard(d), "pieces": lambda d, y: pieces.round_trip(d), "rules": lambda d, y: rules.quality_rules(d), "quality": lambda d, y: quality.quality(d, y),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, name):
    out = OPERATORS[name](docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in TEXTS)
    if name in ("toxicity", "quality"):
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        scores = {r.doc_id: r.score for r in out}
        assert scores[6] == scores[7]


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_has_no_rows(empty, no_labels, name):
    assert OPERATORS[name](empty, no_labels).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_without_labels_the_score_is_constant(docs, no_labels, name):
    assert len({r.score for r in OPERATORS[name](docs, no_labels).collect()}) == 1


def test_packing_covers_every_row(docs, empty):
    rows = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(i for i, _ in TEXTS)
    assert packing.pack(empty).collect() == []


def test_packing_doesn_t_read_other_columns(docs):
    facts = lambda d: Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packing.pack(d).collect())
    other = {"length": F.lit(7), "class": F.lit("x"), "uid": F.lit("x"), "part": F.lit("x"), "rank": F.lit("x"), "sequence_id": F.lit("x")}
    assert facts(docs.withColumns(other)) == facts(docs.select("doc_id", "text"))


def test_stages_keep_the_columns(docs, empty, labels):
    for d in (docs, empty):
        for stage in (
            lambda x: toxicity.filtered(x, toxicity.fit(x, labels)), lambda x: quality.filtered(x, quality.fit(x, labels)), jaccard.representatives, pii.redact,
        ):
            assert stage(d).columns == docs.columns
            stage(d).collect()


def test_one_of_each_group_stays(docs):
    kept = jaccard.representatives(docs).collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids[5] == 1 and ids[6] == ids[7] == 0 and ids[1] == ids[2] == ids[3] == 1


def test_a_kept_id_that_repeats_stays_once(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "z"), (3, "other text here", "w")]
    kept = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string, _row string")).collect()
    assert Counter(r.doc_id for r in kept) == {1: 1, 3: 1}


def test_redaction_replaces_every_base_span(docs):
    text = {r.doc_id: r for r in pii.redact(docs).collect()}[11]
    assert text.text == "mail [EMAIL] now [PHONE], then [CARD], or [IP]" and text.n_chars == len(text.text)


def test_a_damaged_member_is_found_and_a_whole_one_read(docs, tmp_path):
    payload = media.payload_of("abc" * 100)[1]
    png = media.image(payload)
    assert media.pixels(png) == payload
    with pytest.raises(Exception):
        media.pixels(png[:-20] + b"x" + png[-19:])


def test_ranges_cover_each_byte_once_in_few_partitions():
    archives = [("a", 2500), ("b", 10), ("c", 0), ("d", 990), ("e", 5000)]
    for split, most in ((1000, 100), (1, 3), (10**9, 100)):
        plan = media.planned(archives, split, most)
        assert len(plan) <= max(most, 1) and sorted((x, i) for p in plan for x, s, e in p for i in range(s, e)) == sorted((x, i) for x, n in archives for i in range(n))


def test_members_are_read_by_range(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/media"
    media.store(docs, folder)
    spark.dataSource.register(media.MediaArchives)
    rows = spark.read.format("tidemark_archives").option("split", "1000").load(folder).collect()
    assert sorted(hashlib.sha256(media.pixels(bytes(r.media))).hexdigest() for r in rows) == sorted(hashlib.sha256(media.payload_of(t)[1]).hexdigest() for _, t in TEXTS)


@pytest.mark.parametrize("limit", [1, 300, 200_000])
def test_shards_fit_their_limit(spark, limit):
    rows = [(i % 50 if i % 3 else 7, "t" * (i % 90)) for i in range(900)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert len(out) == 900
    size, number = Counter(), Counter()
    for r in out:
        size[r.shard] += r.n_bytes
        number[r.shard] += 1
    assert all(size[s] <= limit or number[s] == 1 for s in size)
    assert all((r.shard_bytes, r.shard_rows, r.shard_bits) == (size[r.shard], number[r.shard], len(r.shard)) for r in out)
    shards = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))
    for s in shards:  # only what is too large was split
        if s:
            parent = [x for x in shards if x.startswith(s[:-1])]
            assert sum(size[x] for x in parent) > limit and sum(number[x] for x in parent) > 1


def test_quality_rules_reject_an_outlier(spark):
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n))
    rows = [(i, prose(int(rng.integers(80, 200))), "en", f"s{i % 2}") for i in range(500)] + [(1000, " ".join("##$$%%&&" for _ in range(100)), "en", "s0")]
    out = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[1000].kept and np.mean([out[i].kept for i in range(500)]) > 0.99


def test_toxicity_gives_evidence(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(600):
        w = list(rng.choice(words, 40))
        if i % 6 == 0:
            w[3:5] = ["badword", "vile"]
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 6 == 0)))
    out = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert all(r.predicted == (r.doc_id % 6 == 0) for r in out)
    assert all(r.evidence and all(e % 6 == 0 for e in r.evidence) for r in out if r.predicted)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_nearest_examples_are_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.random((400, 30)) * (rng.random((400, 30)) < 0.2)
    v = v[v.any(1)]
    v /= np.sqrt((v * v).sum(1))[:, None]
    row, term = np.nonzero(v)
    index = toxicity.BlockMaxIndex(row, term, v[row, term], len(v), v.shape[1])
    for q in v[:50]:
        at = np.flatnonzero(q)
        rows, cosine = index.nearest(at, q[at], k=10)
        brute = np.sort(v @ q)[::-1]
        assert np.allclose(cosine, brute[brute > 0][:10])
        assert np.allclose(v[rows] @ q, cosine)


def test_cutting_stock_holds_the_demand_near_the_bound():
    rng = np.random.default_rng(4)
    sizes = np.arange(1, 129)
    demand = (400 * np.exp(-(((sizes - 40) / 30.0) ** 2)) + rng.integers(1, 40, 128)).astype(int)
    patterns = packing.cutting_stock(sizes, demand, 128)
    assert (sum(n * c for n, c in patterns) == demand).all() and all((c * sizes).sum() <= 128 for _, c in patterns)
    assert sum(n for n, _ in patterns) <= 1.02 * (sizes * demand).sum() / 128 + 3


def test_r_tree_finds_every_pair_within_the_bound():
    rng = np.random.default_rng(5)
    base = rng.poisson(3.0, (20, jaccard.GROUPS))
    points = np.concatenate([base, *(np.maximum(0, base + rng.integers(-1, 2, base.shape)) for _ in range(9))]).astype(np.uint32)
    n = points.sum(1).astype(np.int64)
    tree = jaccard.RTree(points, n)
    i, j = tree.pairs(tree)
    brute = {(a, b) for a in range(200) for b in range(200) if 9 * int(np.minimum(points[a], points[b]).sum()) >= 4 * (n[a] + n[b])}
    assert set(zip(i.tolist(), j.tolist())) == brute


def test_filter_gives_counts_to_a_factor(spark):
    text = " ".join(f"a{k}" for k in range(64) for _ in range(k + 1))
    d = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    assert d.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 1).count() > 0
    r = lm.scores(d).collect()
    assert len({x.score for x in r}) == 1 and r[0].score > r[0].base_score


def brute_scores(texts: dict[int, str]) -> dict[int, float]:
    """The model's scores from exact counts, by its definition."""
    import math

    tokens = {i: [*t.lower().split(), None] for i, t in texts.items()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    words, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<", *t], t))
    about = lambda c: max(1, 0.75 * 2 ** (int(math.log2(c)) + 1)) if c else 0.0
    n, v = words.total(), len(words)

    def one(before, w):
        of = len(train) if before == "<" else about(words[before])
        share = min(1.0, about(pairs[before, w]) / max(of, 1.0)) if of else 0.0
        return math.log10(lm.MIX * share + (1 - lm.MIX) * min(1.0, (about(words[w]) + 0.5) / (n + 0.5 * (v + 1))))

    return {i: sum(one(b, w) for b, w in zip(["<", *t], t)) for i, t in tokens.items()}


@pytest.mark.parametrize("most_bytes", [24 << 20, 1 << 12, 0])
def test_scores_are_those_of_the_counts_whatever_the_bound(spark, most_bytes):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(3000)]
    texts = {i: " ".join(words[int(k)] for k in np.minimum(2999, rng.zipf(1.3, 200) - 1)) for i in range(300)}
    out = lm.scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), most_bytes).collect()
    expected = brute_scores(texts)
    # the filter takes a few absent n-grams, and a few counts, for more
    assert np.mean([abs(r.score - expected[r.doc_id]) / r.n_tokens for r in out]) < 0.01


def test_search_finds_the_least_determinant():
    from itertools import combinations

    rng = np.random.default_rng(8)
    for _ in range(3):
        x = rng.normal(size=(13, len(rules.DIMS))) * np.array(list(rules.FLOOR.values())) * 4
        near = int(np.searchsorted(np.arange(1, 14), rules.SHARE * 13)) + 1
        brute = min(rules.moments(x[list(rows)], np.ones(near))[2] for rows in combinations(range(13), near))
        assert rules.search(x, np.ones(13))[0][2] == pytest.approx(brute, abs=1e-9)


def test_toxicity_scores_by_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(list(rng.choice(words, 12)) + ["vile"] * (i % 4 == 0)) for i in range(160)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    examples = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    known = {t for i in examples for t in texts[i].split()}
    have = {t: [sum(t in texts[i].split() for i in examples if (i % 4 == 0) == y) for y in (False, True)] for t in known}
    n = [sum((i % 4 == 0) == y for i in examples) for y in (False, True)]
    df = {t: sum(t in x.split() for x in texts.values()) for t in known}
    weight = {t: (np.log(161 / (1 + df[t])) + 1e-3) * (np.log2(2 + have[t][1] / max(1, have[t][0] * n[1] / n[0])) - 0.99) for t in known}

    def vector(text):
        v = {t: (1 + np.log(c)) * weight[t] for t, c in Counter(text.split()).items() if t in known}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    held = {i: vector(texts[i]) for i in examples}
    for r in toxicity.score(docs, model).collect():
        q = vector(texts[r.doc_id])
        best = sorted((-round(sum(x * v.get(t, 0.0) for t, x in q.items()), 6), i) for i, v in held.items())[: toxicity.K]
        vote = sum(c * c * (i % 4 == 0) for c, i in best) / sum(c * c for c, _ in best)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * vote))), abs=0.02)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace as Of

    from tidemark.llm.common import shared_dir

    for master, allowed in (("local[8]", True), ("local", True), ("local-cluster[3,2,3000]", False), ("yarn", False), ("spark://host:7077", False)):
        session = Of(conf=Of(get=lambda k, d: None), sparkContext=Of(master=master), _tidemark_shared=None)
        if allowed:
            assert shared_dir(session).startswith("file://")
        else:
            with pytest.raises(ValueError):
                shared_dir(session)
