"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

A bounded sample of labelled rows (PER_CLASS of each class, and EXAMPLE_BYTES of their text) gives the examples. Every
term of the examples is indexed. A term's weight is its logarithmic frequency in the text, its inverse document
frequency over all documents, and a relevance factor (tf.rf: how much more often it occurs in toxic than in clean
examples), so that ordinary words, which most of a text consists of, hardly move the cosine; none is left out.

The index keeps the examples in blocks of BLOCK and, for each term and block, the largest weight. A query adds these up
to a bound for each block. The FIRST blocks with the largest bounds are scored; what they give for the K-th best cosine
rules out every block whose bound is lower, and the others are scored. So the neighbours are exact. Their votes,
weighted by squared cosine, are calibrated by a logistic curve on votes for examples that are left out themselves.

The index is bounded by these parameters, so it is sent to all workers. Everything else is one pass over the documents;
document frequencies are summed by a shuffle of one count for each run of terms and task.

Defined results: null and empty texts, and texts without a term of the examples, get the share of toxic rows among the
labelled texts without terms, or among all labelled ones, and no evidence. Very long texts are read whole; their cost
is linear in their length. Equal texts get equal scores, and rows with one id are scored each by its own text. If a
labelled id has several rows, the largest text is its example. Equal example vectors form one example that votes with
its share of toxic rows; ties in cosine go to the earlier example. Without labels of both classes the score is the
share of toxic labels, 0 if there are no labels. Extra columns are not read, whatever their names; filtered() keeps
them. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, label_sample, sampled_texts

PER_CLASS = 3000
#: Text of all examples together; beyond it, examples are taken in the order of their ids' hash as long as they fit.
EXAMPLE_BYTES = 48 << 20
BLOCK, FIRST = 64, 4
K = 15
#: Relevance of a term that no toxic example has.
LEAST_RELEVANCE = 0.01
#: Terms in one count array that a task sends.
RUN = 4096
FOLDS, HELD_OUT = 5, 0
EVIDENCE = 3
_PLAIN = bytes(ord(" ") if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or b < 33 or b == 127 else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges start:end, one range after another, and the lengths of the ranges."""
    n = (end - start).astype(np.int64)
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class BlockMaxIndex:
    """Postings of the examples by term, in blocks of rows, with the largest weight of each term in each block."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, terms_: int):
        """Of size examples: weight of a term in a row. Rows are in the order in which blocks are cut."""
        order = np.lexsort((row, term))
        self.size, self.row, self.weight = size, row[order].astype(np.int32), weight[order].astype(np.float32)
        term, block = term[order], row[order] // BLOCK
        self.of_term = np.searchsorted(term, np.arange(terms_ + 1)).astype(np.int32)
        #: segments: the postings of one term in one block
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.start = np.append(new, len(term)).astype(np.int32)
        self.block = block[new].astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0, np.float32)
        self.segments_of_term = np.searchsorted(term[new], np.arange(terms_ + 1)).astype(np.int32)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a positive cosine."""
        if not len(at) or not self.size:
            return np.zeros(0, np.int64), np.zeros(0)
        segment, n = spread(self.segments_of_term[at], self.segments_of_term[at + 1])
        block, weight = self.block[segment], np.repeat(w, n)
        bound = np.bincount(block, weight * self.most[segment], -(-self.size // BLOCK))
        first = np.zeros(len(bound), bool)
        first[np.argsort(-bound, kind="stable")[:FIRST]] = True
        score = self.scored(segment, weight, first[block], skip)
        some = score[np.repeat(first, BLOCK)[: self.size]]
        best = np.partition(some, -k)[-k] if len(some) > k else 0.0
        others = ~first & (bound > 0) & (bound >= best - 1e-9)
        if 2 * others.sum() > len(bound):  # most blocks are left: whole postings cost less than picked segments
            score = self.added(*spread(self.of_term[at], self.of_term[at + 1]), w, skip)
        elif others.any():
            score = score + self.scored(segment, weight, others[block], skip)
        best = np.partition(score, -k)[-k] if self.size > k else 0.0
        rows = np.flatnonzero((score > 0) & (score >= best - 1e-12))
        rows = rows[np.lexsort((rows, -np.round(score[rows], 12)))[:k]]
        return rows, score[rows]

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and weights of each row."""
        order = np.argsort(self.row, kind="stable")
        term = np.repeat(np.arange(len(self.of_term) - 1), np.diff(self.of_term))[order]
        cuts = np.searchsorted(self.row[order], np.arange(1, self.size))
        return list(zip(np.split(term, cuts), np.split(self.weight[order].astype(float), cuts)))

    def scored(self, segment: np.ndarray, weight: np.ndarray, here: np.ndarray, skip: int) -> np.ndarray:
        """Cosines from the segments here."""
        s = segment[here]
        return self.added(*spread(self.start[s], self.start[s + 1]), weight[here], skip)

    def added(self, posting: np.ndarray, n: np.ndarray, weight: np.ndarray, skip: int) -> np.ndarray:
        out = np.bincount(self.row[posting], np.repeat(weight, n) * self.weight[posting], self.size)
        if skip >= 0:
            out[skip] = 0
        return out


class Model:
    """Vocabulary, index and calibration; bounded by the sample's parameters. It goes to the workers once."""

    def __init__(self, vocabulary: dict[bytes, int], weight: np.ndarray, index: BlockMaxIndex | None, toxic: np.ndarray, ids: np.ndarray, empty: float):
        self.vocabulary, self.weight, self.index, self.toxic, self.ids = vocabulary, weight, index, toxic, ids
        self.curve, self.empty, self.shipped = (0.0, 0.0), empty, None

    def __getstate__(self):
        return self.__dict__ | {"shipped": None}

    def ship(self, spark: SparkSession) -> Broadcast:
        if self.shipped is None:
            self.shipped = spark.sparkContext.broadcast(self)
        return self.shipped

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text, with length 1 over the indexed terms."""
        known = self.vocabulary
        tf = Counter(terms(text))
        found = [t for t in tf if t in known]
        at, n = (np.fromiter(map(of.__getitem__, found), np.int64, len(found)) for of in (known, tf))
        order = np.argsort(at)
        at, n = at[order], n[order]
        return at, unit((1 + np.log(n)) * self.weight[at])

    def vote(self, rows: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine * cosine
        return float((w * self.toxic[rows]).sum() / w.sum()) if len(rows) else -1.0

    def score(self, text: str | None, curve: tuple[float, float] | None = None) -> tuple[float, list[int]]:
        a, b = curve or self.curve
        if self.index is None:
            return self.empty, []
        rows, cosine = self.index.nearest(*self.vector(text))
        if not len(rows):
            return self.empty, []
        return float(1 / (1 + np.exp(-(a + b * self.vote(rows, cosine))))), self.ids[rows[:EVIDENCE]].tolist()


def unit(w: np.ndarray) -> np.ndarray:
    return w / (np.sqrt((w * w).sum()) or 1.0)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps; x has a column of ones."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * w.sum() * np.eye(x.shape[1]) / len(y)
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * w.sum() / len(y) * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def document_frequency(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Documents, and for each term the documents that have it, over all documents. A task sends its counts in runs of
    RUN terms, and each run is summed in one group."""
    shipped, size = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)
    schema = pa.schema([("run", pa.int32()), ("counts", pa.binary())])

    def count(batches):
        known, n, df = shipped.value, 0, np.zeros(size, "<i8")
        for b in batches:
            for text in b.column("text").to_pylist():
                n += 1
                found = set(filter(known.__contains__, terms(text)))
                df[np.fromiter(map(known.__getitem__, found), np.int64, len(found))] += 1
        runs = [r for r in range(-(-size // RUN)) if df[r * RUN : (r + 1) * RUN].any()]
        counts = [np.array([n], "<i8").tobytes(), *(df[r * RUN : (r + 1) * RUN].tobytes() for r in runs)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *runs], pa.int32()), pa.array(counts, pa.binary())], schema=schema)

    def add(key: tuple, frame: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x, "<i8") for x in frame.column("counts").to_pylist())
        return pa.table({"run": [key[0].as_py()], "counts": [counts.tobytes()]}, schema)

    sent = docs.select("text").mapInArrow(count, "run int, counts binary")
    df, n = np.zeros(size, np.int64), 0
    for r in sent.groupBy("run").applyInArrow(add, "run int, counts binary").collect():  # one number for each term
        counts = np.frombuffer(r["counts"], "<i8")
        if r["run"] < 0:
            n = int(counts[0])
        else:
            df[r["run"] * RUN : r["run"] * RUN + len(counts)] = counts
    shipped.destroy()
    return n, df


def example_counts(texts: DataFrame) -> tuple[dict[bytes, int], list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The terms of all examples, numbered, and (doc_id, label, terms, counts) of each example, by id; as bounded as
    EXAMPLE_BYTES of text are."""

    def count(batches):
        for b in batches:
            found = [Counter(terms(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([b" ".join(f) for f in found], pa.binary()), pa.array([np.fromiter(f.values(), "<i4", len(f)).tobytes() for f in found], pa.binary())],
                ["doc_id", "label", "terms", "counts"],
            )

    table = texts.select("doc_id", "label", "text").mapInArrow(count, "doc_id long, label int, terms binary, counts binary").toArrow().sort_by("doc_id")
    vocabulary: dict[bytes, int] = {}
    out = []
    for doc_id, label, found, counts in zip(*(table.column(c) for c in ("doc_id", "label", "terms", "counts"))):
        at = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in found.as_py().split()], np.int64)
        order = np.argsort(at)
        out.append((doc_id.as_py(), label.as_py(), at[order].astype(np.int32), np.frombuffer(counts.as_py(), "<i4")[order]))
    return vocabulary, out


def relevance(found: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """tf.rf over (label, terms) of the examples: least for a term without toxic examples, growing with the ratio of
    toxic and clean examples that have it."""
    have = [np.bincount(np.concatenate([at for y, at in found if y == label] or [np.zeros(0, np.int64)]), minlength=size) for label in (0, 1)]
    n = [sum(y == label for y, _ in found) for label in (0, 1)]
    return np.log2(2 + have[1] / np.maximum(1, have[0] * (n[1] / max(1, n[0])))) - 1 + LEAST_RELEVANCE


def fit(docs: DataFrame, labels: DataFrame, modulus: int = FOLDS, left_out: int = HELD_OUT, per_class: int = PER_CLASS) -> Model:
    sample, stands_for = label_sample(labels, "toxic", modulus, left_out, per_class)
    vocabulary, rows = example_counts(sampled_texts(docs, sample, EXAMPLE_BYTES))
    n = Counter(y for _, y, _, _ in rows)
    share = n[1] * stands_for[1] / max(1e-9, n[0] * stands_for[0] + n[1] * stands_for[1])
    if not n[0] or not n[1] or not vocabulary:
        return Model({}, np.zeros(0), None, np.zeros(0), np.zeros(0, np.int64), share)
    documents, df = document_frequency(docs, vocabulary)
    weight = np.log((1 + documents) / (1 + np.minimum(df, documents))) + 1e-3
    weight *= relevance([(y, at) for _, y, at, _ in rows], len(vocabulary))
    groups: dict[bytes, list[int]] = {}  # rows of equal terms and counts
    for i, (_, _, at, counts) in enumerate(rows):
        groups.setdefault(blake2b(at.tobytes() + counts.tobytes(), digest_size=16).digest(), []).append(i)
    weigh = lambda g: sum(stands_for[rows[i][1]] for i in g)
    toxic_of = lambda g: sum(stands_for[1] for i in g if rows[i][1]) / weigh(g)
    bare = [i for i, r in enumerate(rows) if not len(r[2])]
    every = []
    for members in groups.values():
        at, counts = rows[members[0]][2:]
        if len(at):
            w = unit((1 + np.log(counts)) * weight[at])
            every.append((int(at[w.argmax()]), rows[members[0]][0], at, w.astype(np.float32), members))
    every.sort(key=lambda v: v[:2])  # examples with the same foremost term stand in one block
    index = BlockMaxIndex(np.repeat(np.arange(len(every), dtype=np.int32), [len(v[2]) for v in every]), np.concatenate([v[2] for v in every]), np.concatenate([v[3] for v in every]), len(every), len(vocabulary))
    toxic, stands = np.array([toxic_of(v[4]) for v in every]), np.array([weigh(v[4]) for v in every])
    model = Model(vocabulary, weight, index, toxic, np.array([v[1] for v in every], np.int64), toxic_of(bare) if bare else share)
    del rows, groups, every
    votes = left_out_votes(docs, model)
    known = votes >= 0
    if known.any():
        x, w = np.stack([np.ones(known.sum()), votes[known]], 1), stands[known]
        a, b = logistic(np.concatenate([x, x]), np.repeat([1.0, 0.0], known.sum()), np.concatenate([w * toxic[known], w * (1 - toxic[known])]) + 1e-9)
        model.curve = (float(a), float(b))
    return model


def left_out_votes(docs: DataFrame, model: Model) -> np.ndarray:
    """The vote for each example without itself; tasks share the examples."""
    spark, size = docs.sparkSession, model.index.size
    shipped = model.ship(spark)

    def run(batches):
        m = shipped.value
        v = m.index.vectors()
        for b in batches:
            i = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([m.vote(*m.index.nearest(*v[k], skip=k)) for k in i], pa.float64())], ["id", "vote"])

    out = np.zeros(size)
    for r in spark.range(size).mapInArrow(run, "id long, vote double").collect():  # one for each example
        out[r["id"]] = r["vote"]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (ids of the nearest examples) of every document."""
    shipped, curve = model.ship(docs.sparkSession), model.curve

    def run(frames):
        m = shipped.value
        for f in frames:
            out = [m.score(t, curve) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": [s for s, _ in out], "evidence": [e for _, e in out]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, evidence array<long>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return score(docs, model).select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is under 0.5, with all their columns."""
    shipped, curve = model.ship(docs.sparkSession), model.curve

    def run(batches):
        m = shipped.value
        for b in batches:
            yield b.filter(pa.array([m.score(t, curve)[0] < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
