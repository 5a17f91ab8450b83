"""Quality classifier: zstandard dictionaries of good and of bad labelled text, compared by compressed size.

A bounded sample of labelled rows (PER_CLASS of each class, SAMPLE_BYTES of text) is cut into pieces of PIECE bytes; half
of the documents train one dictionary for each class, the other half calibrates. Each text is compressed piece by piece
with both dictionaries, over its whole length, so that the dictionaries count throughout. Three forms of the normalised
size difference (bad - good) go through a logistic curve: divided by the sum of both sizes, divided by the size of the
text, and the first one of the worst piece. All weigh by size / (size + SHORT), since a few bytes say little. PIECE and
the forms were chosen by accuracy on one training fold, learning from the other two.

The dictionaries are bounded (DICTIONARY bytes each) and are sent to all workers; scoring is one pass without shuffle.

Defined results: a null or empty text has difference 0 and gets the curve's value there. A very long text is compressed
whole, piece by piece, at a cost linear in its length. Equal texts get equal scores, and rows with one id are scored each
by its own text. If a labelled id has several rows, the largest text counts. Where the labels lack a class, the score is
the share of good labels, 1 without labels. Extra columns are not read, whatever their names; filtered() keeps them. An
empty table gives no rows. A score of just THRESHOLD is good.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, label_sample, sampled_texts
from .toxicity import logistic

PER_CLASS = 2000
#: Text of all sampled rows together.
SAMPLE_BYTES = 32 << 20
PIECE = 256
DICTIONARY = 32768
#: Bytes of training text for each dictionary, spread evenly over the documents.
TRAINING = 6 << 20
LEVEL = 1
SHORT = 400
FEATURES = 4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class Model:
    def __init__(self, good: bytes, bad: bytes, beta: np.ndarray):
        self.good, self.bad, self.beta, self.ready = good, bad, beta, None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def features(self, text: str | None) -> list[float]:
        if self.ready is None:
            plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.ready = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (self.good, self.bad)]
        cut = pieces(text)
        size = sum(map(len, cut))
        if not size:
            return [1.0] + [0.0] * (FEATURES - 1)
        good, bad = (np.array([len(c.compress(x)) for x in cut], float) for c in self.ready)
        each = (bad - good) / (bad + good)
        whole = [len(x) >= PIECE // 2 for x in cut]  # a short last piece counts only if there is no other
        g, b, known = good.sum(), bad.sum(), size / (size + SHORT)
        return [1.0, *(20 * known * x for x in ((b - g) / (b + g), (b - g) / size, each[whole].min() if any(whole) else each.min()))]

    def score(self, text: str | None) -> float:
        if not self.good:
            return float(self.beta[0])
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.beta), -30, 30))))


def dictionary(texts: list[str]) -> bytes:
    """A dictionary of pieces taken evenly from all texts."""
    cut = [p for t in texts for p in pieces(t)]
    step = max(1.0, sum(map(len, cut)) / TRAINING)
    cut = [cut[int(i * step)] for i in range(int(len(cut) / step))]
    try:
        return zstandard.train_dictionary(DICTIONARY, cut, level=3, threads=0).as_bytes()
    except zstandard.ZstdError:  # too little text to train: the text itself serves
        return b"".join(cut)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, modulus: int = FOLDS, left_out: int = HELD_OUT, per_class: int = PER_CLASS) -> Model:
    sample, stands_for = label_sample(labels, "quality", modulus, left_out, per_class)
    rows = sorted(sampled_texts(docs, sample, SAMPLE_BYTES).collect(), key=lambda r: r["doc_id"])  # at most 2 * per_class
    of = {y: [r["text"] for r in rows if r["label"] == y] for y in (0, 1)}
    if len(of[0]) < 2 or len(of[1]) < 2:
        n = sum(stands_for[y] * len(of[y]) for y in (0, 1))
        return Model(b"", b"", np.array([stands_for[1] * len(of[1]) / n if n else 1.0]))
    model = Model(dictionary(of[1][::2]), dictionary(of[0][::2]), np.zeros(FEATURES))
    held = [(model.features(t), y) for y in (0, 1) for t in of[y][1::2]]
    x, y = np.array([f for f, _ in held]), np.array([float(y) for _, y in held])
    model.beta = logistic(x, y, np.array([stands_for[int(v)] for v in y]), ridge=1e-2)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": [model.score(t) for t in f["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return score(docs, model).select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.score(t) >= THRESHOLD for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
