"""Quality rules: exact text statistics, and robust multivariate outliers by minimum covariance determinant.

One pass over the texts gives exact counts. Documents that pass the base rules become vectors of DIMS transformed
statistics. Each language and source is a group of its own if it has LEAST rows that pass; else its language's rows
and, if they are few as well, all rows stand for it.

Each group's location and scatter are those of the SHARE of its rows whose covariance has the least determinant, searched
as FAST-MCD does: STARTS random subsets of one more row than there are dimensions take two concentration steps on about
SUBSET of the group's vectors (chosen by hash; they only say where to begin); the KEEP best are concentrated to the end
there and then on all rows of the group, until the determinant falls no further; the lesser determinant wins. In a
concentration step the rows with the smallest distances give the next mean and covariance. A document is rejected if its
squared Mahalanobis distance, divided by how much the group's median exceeds the chi-square median, exceeds CUT.

Every step over all rows is an aggregation with partial sums, so that a group with a third of all rows costs no more than
others; only the table of group parameters goes between steps, and it is broadcast only while it is small.

Defined results: a null text has no words. base_failed texts are not kept. FLOOR bounds the scatter from below where most
texts agree (no symbols, no repeats), so that texts are not rejected for a trifle. A null language or source is a group
value like others. Very long texts are counted whole. Repeated rows count each; equal texts of a group are equally far.
A text at a distance of just CUT is kept. Extra columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textvec import SPACE, ngrams, text_chunks, words

WINDOW = 8
MIN_WORDS = 20
LEAST = 200
SHARE = 0.75
STARTS, KEEP, SUBSET = 200, 2, 1500
#: A determinant has settled if its logarithm falls by no more.
SETTLED = 1e-4
#: Rows of group parameters up to which they are broadcast.
SMALL = 20_000
#: The dimensions, each with the least standard deviation it may have.
FLOOR = {"size": 0.7, "letters": 0.35, "symbols": 0.35, "lines": 0.15, "repeats": 0.06}
DIMS = list(FLOOR)
#: Of a chi-square with 5 degrees of freedom: the median, and the value that one row in ten thousand exceeds.
MEDIAN, CUT = 4.351, 25.74
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(grams: np.ndarray) -> int:
    """Words that lie in a window found twice or more; grams has a hash for each window of a text."""
    s = np.sort(grams)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(grams, twice))
    return int(np.minimum(np.diff(at), WINDOW).sum()) + WINDOW


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and the exact statistics of every text."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in STATISTICS}
            for _, data, offsets in text_chunks(b.column("text")):
                h, _, _, at = words(data, offsets, lower=False)
                grams = ngrams(h, WINDOW)
                # characters: bytes that don't continue one
                chars = np.concatenate([[0], np.cumsum(~SPACE[data] & ((data & 0xC0) != 0x80))])[offsets]
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])[offsets]
                out["n_words"].extend(np.diff(at).tolist())
                out["word_chars"].extend(np.diff(chars).tolist())
                out["n_symbols"].extend(np.diff(symbols).tolist())
                raw = data.tobytes()
                for x, y, s, e in zip(at[:-1].tolist(), at[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    out["n_dup_lines"].append(duplicate_lines(raw[s:e]))
                    out["n_repeat_words"].append(repeated_words(grams[x : y - WINDOW + 1]) if y - x >= WINDOW else 0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(v, pa.int64()) for v in out.values()], keep + STATISTICS)

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{k} long" for k in STATISTICS])
    return docs.select("text", *keep).mapInArrow(run, schema)


def vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "size": F.log(n),
        "letters": F.col("word_chars") / n,
        "symbols": F.log1p(20 * F.col("n_symbols") / n),
        "lines": F.sqrt(F.col("n_dup_lines") / (n / 10 + 1)),
        "repeats": F.col("n_repeat_words") / n,
    }


def distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of the row's vector from the parameters in the same row."""
    d = [F.col(c) - F.col(mean)[i] for i, c in enumerate(DIMS)]
    return sum((d[i] * d[j] * F.col(inverse)[i * len(DIMS) + j] for i in range(len(DIMS)) for j in range(len(DIMS))), F.lit(0.0))


_UNITS = np.array(list(FLOOR.values()))


def bounded(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """A covariance with no direction, in units of the floors, under one unit; and the logarithm of its determinant."""
    value, way = np.linalg.eigh(cov / np.outer(_UNITS, _UNITS))
    value = np.maximum(value, 1.0)
    return (way * value) @ way.T * np.outer(_UNITS, _UNITS), float(np.log(value).sum())


def moments(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    mean = w @ x / w.sum()
    cov, size = bounded((x - mean).T @ ((x - mean) * w[:, None]) / w.sum())
    return mean, cov, size


def concentrated(x: np.ndarray, w: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The moments of the SHARE of weight that is nearest."""
    far = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
    order = np.argsort(far, kind="stable")
    near = order[: int(np.searchsorted(np.cumsum(w[order]), SHARE * w.sum())) + 1]
    return moments(x[near], w[near])


def search(x: np.ndarray, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The KEEP best of STARTS random starts, concentrated until their determinants settle."""
    rng, found = np.random.default_rng(len(x)), []
    for _ in range(STARTS):
        few = rng.choice(len(x), min(len(x), len(DIMS) + 1), replace=False)
        mean, cov, size = moments(x[few], np.ones(len(few)))
        for _ in range(2):
            mean, cov, size = concentrated(x, w, mean, cov)
        found.append((size, mean, cov))
    out = []
    for size, mean, cov in sorted(found, key=lambda f: f[0])[:KEEP]:
        while True:
            step = concentrated(x, w, mean, cov)
            if step[2] > size - SETTLED:
                break
            mean, cov, size = step
        out.append((mean, cov, size))
    return out


def small(df: DataFrame) -> DataFrame:
    """df, a written table of group parameters, with a broadcast hint while it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def beginnings(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, start, mean, inverse, logdet) of each group's best starts. Equal vectors have one hash and stand together, so
    a group's vectors here are about SUBSET however often one of them is repeated."""
    chosen = rows.join(small(sizes), "grp").where(F.pmod(F.xxhash64(*DIMS), F.col("n")) < SUBSET)
    weighted = chosen.groupBy("grp", *DIMS).agg(F.count("*").alias("w"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(DIMS)
        found = search(frame[DIMS].to_numpy(float), frame["w"].to_numpy(float))
        return pd.DataFrame([(key[0], i, m.tolist(), np.linalg.inv(c).ravel().tolist(), float("inf")) for i, (m, c, _) in enumerate(found)], columns=["grp", "start", "mean", "inverse", "logdet"])

    return weighted.groupBy("grp").applyInPandas(run, "grp string, start int, mean array<double>, inverse array<double>, logdet double")


def inverted(sums: DataFrame) -> DataFrame:
    """Of each group's mean and covariance: mean, inverse of the bounded covariance and its determinant's logarithm."""

    def run(frames):
        for f in frames:
            found = [bounded(np.reshape(c, (len(DIMS), len(DIMS)))) for c in f["cov"]]
            f["inverse"], f["logdet"] = [np.linalg.inv(c).ravel().tolist() for c, _ in found], [s for _, s in found]
            yield f[["grp", "start", "mean", "inverse", "logdet", "before"]]

    return sums.select("grp", "start", "mean", "cov", "before").mapInPandas(run, "grp string, start int, mean array<double>, inverse array<double>, logdet double, before double")


def step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step of every start over all rows of its group; before: the determinant's logarithm before."""
    n = range(len(DIMS))
    far = rows.join(small(now), "grp").withColumn("d2", distance())
    limit = written(far.groupBy("grp", "start").agg(F.percentile_approx("d2", SHARE, 2000).alias("limit")), "limit")
    near = far.join(small(limit), ["grp", "start"]).where(F.col("d2") <= F.col("limit"))
    # products about the last centre, so that little is cancelled
    c = [F.col(x) - F.col("mean")[i] for i, x in enumerate(DIMS)]
    sums = near.groupBy("grp", "start", "mean", "logdet").agg(
        F.array(*(F.avg(x) for x in c)).alias("m"), F.array(*(F.avg(c[i] * c[j]) for i in n for j in n)).alias("p")
    )
    cov = F.array(*(F.col("p")[i * len(DIMS) + j] - F.col("m")[i] * F.col("m")[j] for i in n for j in n))
    mean = F.array(*(F.col("mean")[i] + F.col("m")[i] for i in n))
    return written(inverted(sums.select("grp", "start", mean.alias("mean"), cov.alias("cov"), F.col("logdet").alias("before"))), "step")


def parameters(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """mean, inverse and scale of each group in rows (grp and DIMS); sizes: grp and its number of rows n."""
    open_, done = written(beginnings(rows, sizes), "start"), None
    while True:
        now = step(rows, open_)
        # a start whose determinant falls on goes on; each such step lowers it by SETTLED, so that this comes to an end
        falling = F.col("logdet") < F.col("before") - SETTLED
        settled = now.where(~falling).drop("before")
        done = settled if done is None else done.union(settled)
        open_ = written(now.where(falling).drop("before"), "open")
        if open_.isEmpty():
            break
    best = written(done.groupBy("grp").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("best")).select("grp", "best.*"), "best")
    scale = rows.join(small(best), "grp").groupBy("grp").agg((F.percentile_approx(distance(), 0.5, 2000) / MEDIAN).alias("scale"))
    return written(best.join(scale, "grp"), "scatter")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and distance of every document."""
    stats = written(statistics(docs, ["doc_id", "lang", "source"]), "statistics").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    stats = stats.withColumn("by_lang", F.concat(F.lit("lang "), text("lang"))).withColumn("by_source", F.concat(F.lit("source "), text("lang"), F.lit(" "), text("source"))).drop("lang", "source")
    passed = stats.where(~F.col("base_failed")).select(*(v.alias(k) for k, v in vector().items()), "by_lang", "by_source")
    levels = passed.select(*DIMS, F.explode(F.array("by_source", "by_lang", F.lit("all"))).alias("grp"))
    sizes = written(levels.groupBy("grp").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST) | (F.col("grp") == "all")), "groups")
    found = parameters(levels.join(small(sizes.select("grp")), "grp"), sizes)
    pick = lambda how: small(found).select(F.col("grp").alias(f"by_{how}"), F.struct("mean", "inverse", "scale").alias(how))
    rows = stats.withColumns(vector()).withColumn("by_all", F.lit("all"))
    for how in ("source", "lang", "all"):
        rows = rows.join(pick(how), f"by_{how}", "left")
    rows = (
        rows.withColumn("by", F.coalesce("source", "lang", "all")).withColumn("mean", F.col("by.mean")).withColumn("inverse", F.col("by.inverse"))
        .withColumn("distance", distance() / F.greatest(F.col("by.scale"), F.lit(1.0)))
    )
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)
    return rows.select("doc_id", *STATISTICS, "base_failed", kept.alias("kept"), "distance")
