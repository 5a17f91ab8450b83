"""Language-model scores from a log-frequency Bloom filter.

Words and word pairs (with a begin and an end token) of the training documents are counted exactly: tasks send sorted
runs of hashes with counts, and one group for each range of hashes sums them. A count c has level 1 + floor(log2 c), and
the filter holds a key once for each level up to its own, so that probing levels in turn until one is missing gives the
count to a factor. A token's probability mixes the pair's share (weight MIX) with the smoothed share of the word.

The filter holds every word and pair, at BITS bits for each entry (a probe errs in about 1 of 150 cases), and grows with
the corpus. It is made of segments, one for each hash range, in the shared folder. Of these, the entries of the n-grams
with the largest counts are broadcast, as many as fit FILTER_BYTES; if that is all of them, all tokens are scored on the
spot. The other tokens go to the ranges that hold the rest of the filter: those with a word that wasn't found to the
word's range, then to the pair's, and each document gets the sum of its logarithms back. So the score is the same
whatever the bound, and no range, whose number follows the text, grows with the table.

The base score needs exact counts of all words. The at most COMMON commonest are broadcast; the other words of each
document meet their counts in their hash range, and documents get sums back. Nothing is dropped at any size.

Defined results: a null or empty text is one end token. A table without training documents has N = V = 0. A null id's
fold is that of empty text. Repeated rows count each; equal texts get equal scores. Very long texts are read whole.
Extra columns are not read, whatever their names. Words are compared by a 64-bit hash. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, written
from .textvec import U, mix, text_chunks, words

FOLDS, HELD_OUT = 5, 1
#: Bound of what is broadcast of the filter; a worker holds it once.
FILTER_BYTES = 160 << 20
BITS, PROBES = 12, 4
COMMON = 400_000
MIX = 0.4
LEVELS = 48
#: Bytes of text for each range of word hashes and of pair hashes, and tokens in one run that a task sends.
WORD_RANGE, PAIR_RANGE, RUN = 96 << 20, 12 << 20, 1_000_000
BEGIN, END = U(0x1D8E4E27C47D124F), U(0xEB44ACCAB455D165)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: token hashes with each document's end, pair hashes, and each token's document."""
    h, _, _, at = words(data, offsets)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.full(len(h) + len(n), END)
    out[np.arange(len(h)) + doc] = h
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1] + np.arange(len(n))] = BEGIN
    return out, mix(before * U(0xD6E8FEB86659FD93) + out * U(0xA0761D6478BD642F)), np.repeat(np.arange(len(n)), n + 1)


def level(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, LEVELS)


def value(level_: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range; 0 for level 0."""
    return np.where(level_ > 0, np.maximum(1, 0.75 * 2.0**level_), 0.0)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_ngrams(docs: DataFrame, ranges: tuple[int, int]) -> DataFrame:
    """(kind, part, keys, counts, level, n, total, levels): for each range of hashes the sorted n-grams of the training
    documents. kind 0: words, 64-bit keys and counts; kind 1: pairs, 32 bits of the hash beside the range, without
    counts. level: of each n-gram; levels: the filter entries that n-grams from each level up need."""

    def send(batches):
        held: tuple[list, list] = ([], [])
        size = 0

        def flush():
            rows = {"kind": [], "part": [], "keys": [], "counts": []}
            for kind in (0, 1):
                keys, counts = np.unique(np.concatenate(held[kind]), return_counts=True)
                part = (keys >> U(32)) % U(ranges[kind])
                order = np.argsort(part, kind="stable")
                keys, counts, part = keys[order], counts[order], part[order]
                at = np.searchsorted(part, np.arange(ranges[kind] + 1))
                for p in np.flatnonzero(np.diff(at)).tolist():
                    k = keys[at[p] : at[p + 1]]
                    rows["kind"].append(kind)
                    rows["part"].append(p)
                    rows["keys"].append((k if kind == 0 else (k & U(0xFFFFFFFF)).astype("<u4")).tobytes())
                    rows["counts"].append(counts[at[p] : at[p + 1]].astype("<u4").tobytes())
                held[kind].clear()
            return pa.RecordBatch.from_pydict(rows, pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

        for b in batches:
            for _, data, offsets in text_chunks(b.column("text")):
                word, pair, _ = tokens(data, offsets)
                held[0].append(word)
                held[1].append(pair)
                size += len(word)
                if size > RUN:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merge(key: tuple, frame: pa.Table) -> pa.Table:
        kind = int(key[0].as_py())
        keys, counts = summed(
            np.concatenate([np.frombuffer(x, "<u4" if kind else "<u8") for x in frame.column("keys").to_pylist()]),
            np.concatenate([np.frombuffer(x, "<u4") for x in frame.column("counts").to_pylist()]).astype(np.int64),
        )
        at = level(counts)
        entries = [int(at[at >= k].sum()) for k in range(1, LEVELS + 1)]
        columns = {
            "kind": pa.array([kind], pa.int32()), "part": pa.array([int(key[1].as_py())], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()),
            "counts": pa.array([b"" if kind else counts.astype("<i8").tobytes()], pa.binary()), "level": pa.array([at.astype(np.uint8).tobytes()], pa.binary()),
            "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()), "levels": pa.array([entries], pa.list_(pa.int64())),
        }
        return pa.table(columns)

    train = docs.where(fold(FOLDS) != HELD_OUT).select("text")
    sent = train.mapInArrow(send, "kind int, part int, keys binary, counts binary")
    return written(
        sent.groupBy("kind", "part").applyInArrow(merge, "kind int, part int, keys binary, counts binary, level binary, n long, total long, levels array<long>"), "ngrams"
    )


def probes(keys: np.ndarray, at: int, bits: np.ndarray) -> list[np.ndarray]:
    """The PROBES bits of each key at a level, in segments of so many bits."""
    h = mix(keys ^ U((at * 0x9E3779B97F4A7C15) % 2**64))
    step = mix(h) | U(1)
    return [(h + U(i) * step) % bits for i in range(PROBES)]


def probed(key: np.ndarray, data: np.ndarray, first, bits) -> np.ndarray:
    """Repeated membership probes: the last level that is present, for each key, in segments of so many bits from first."""
    first, bits = np.broadcast_to(np.asarray(first, np.uint64), len(key)), np.broadcast_to(np.asarray(bits, np.uint64), len(key))
    out, open_ = np.zeros(len(key), np.int64), np.flatnonzero(bits)
    for at in range(1, LEVELS + 1):
        present = np.ones(len(open_), bool)
        for p in probes(key[open_], at, bits[open_]):
            where = first[open_] + p
            present &= (data[(where >> U(3)).astype(np.int64)] >> (where & U(7)).astype(np.uint8)) & 1 == 1
        open_ = open_[present]
        if not len(open_):
            break
        out[open_] = at
    return out


def place(kind: int, h: np.ndarray, ranges: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Range and key of an n-gram's hash."""
    return ((h >> U(32)) % U(ranges[kind])).astype(np.int64), h if kind == 0 else h & U(0xFFFFFFFF)


class Filter:
    """The broadcast part: segments of bits, one for each kind and range, with the n-grams from level least[kind] on."""

    def __init__(self, segments, ranges: tuple[int, int], least: tuple[int, int], tokens_: int, distinct: int, documents: int):
        self.ranges, self.least, self.tokens, self.distinct, self.documents = ranges, least, tokens_, distinct, documents
        self.first, self.bits = ([np.zeros(n, np.uint64) for n in ranges] for _ in range(2))
        at, raw = 0, []
        for kind, part, x in segments:  # Arrow scalars: kind, range, bits
            x = np.frombuffer(x.as_buffer(), np.uint8)
            self.first[kind.as_py()][part.as_py()], self.bits[kind.as_py()][part.as_py()] = at, 8 * len(x)
            at += 8 * len(x)
            raw.append(x)
        self.data = np.concatenate([np.zeros(0, np.uint8), *raw])

    def level(self, kind: int, h: np.ndarray) -> np.ndarray:
        part, key = place(kind, h, self.ranges)
        return probed(key, self.data, self.first[kind][part], self.bits[kind][part])

    def logarithm(self, before: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 of tokens' probabilities from the levels of the word before (BEGINS: none), the word and the pair."""
        one = (value(word) + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))
        of = np.where(before == BEGINS, float(self.documents), value(np.where(before == BEGINS, 0, before)))
        share = np.where(of > 0, np.minimum(1.0, value(pair) / np.maximum(of, 1.0)), 0.0)
        return np.log10(MIX * share + (1 - MIX) * np.minimum(one, 1.0))


def filled(grams: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(kind, part, bits): the filter's segments with the n-grams from level least[kind] on."""

    def fill(batches):
        for b in batches:
            out = []
            for kind, keys, at in zip(b.column("kind").to_pylist(), b.column("keys").to_pylist(), b.column("level").to_pylist()):
                keys, at = np.frombuffer(keys, "<u4" if kind else "<u8").astype(np.uint64), np.frombuffer(at, np.uint8).astype(np.int64)
                keys, at = keys[at >= least[kind]], at[at >= least[kind]]
                bits = -(-int(at.sum()) * BITS // 8) * 8
                held = np.zeros(bits, bool)
                for k in range(1, int(at.max()) + 1 if len(at) else 1):
                    for p in probes(keys[at >= k], k, U(bits)):
                        held[p] = True
                out.append(np.packbits(held, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("part"), pa.array(out, pa.binary())], ["kind", "part", "bits"])

    return grams.select("kind", "part", "keys", "level").mapInArrow(fill, "kind int, part int, bits binary")


def build(grams: DataFrame, ranges: tuple[int, int], documents: int, most_bytes: int) -> Filter:
    """The broadcast part of the filter: all n-grams from the least levels on that fit the bound, for pairs raised first."""
    need = {r["kind"]: r for r in grams.groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.array(*(F.sum(F.col("levels")[k]) for k in range(LEVELS))).alias("levels")).collect()}
    least = [1, 1]
    room = most_bytes * 8 // BITS
    entries = lambda k: need[k]["levels"][least[k] - 1] if k in need else 0
    while entries(0) + entries(1) > room and min(least) < LEVELS:
        least[1 if entries(1) > room // 2 and least[1] < LEVELS or least[0] >= LEVELS else 0] += 1
    segments = filled(grams, tuple(least)).where("length(bits) > 0").toArrow()  # most_bytes together
    words_ = need.get(0)
    return Filter(zip(*(segments.column(c) for c in ("kind", "part", "bits"))), ranges, tuple(least), words_["total"] if words_ else 0, words_["n"] if words_ else 0, documents)


#: What a request says of one pair in one document: hashes of the word before, of the word and of the pair (32 bits beside
#: the range), the document's place after the base, how often, and the levels that are known.
FIELDS = {"v": "<u8", "w": "<u8", "p": "<u8", "doc": "<u4", "tf": "<u4", "lv": "u1", "lw": "u1", "lp": "u1"}
#: Levels that aren't known yet, and that of the begin.
OPEN, BEGINS = 254, 255


def packed(r: dict[str, np.ndarray], fields=tuple(FIELDS)) -> bytes:
    return np.array([len(r["doc"])], "<i8").tobytes() + b"".join(r[f].astype(FIELDS[f]).tobytes() for f in fields)


def unpacked(raw: bytes, fields=tuple(FIELDS)) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, {}
    for f in fields:
        out[f] = np.frombuffer(raw, FIELDS[f], n, at)
        at += out[f].nbytes
    return out


#: Requests that only ask for the pair are by far the most; they leave out what the others need.
_SHORT = ("p", "doc", "tf", "lv", "lw")


def requests(r: dict[str, np.ndarray], base: int, ranges: tuple[int, int], rows: dict[str, list]) -> None:
    """Adds records to rows (kind, part, base, rows): to the word's range (kind 1), to that of the word before (kind 2), or
    to the pair's (kind 3)."""
    kind = np.where(r["lw"] == OPEN, 1, np.where(r["lv"] == OPEN, 2, 3))
    part = np.where(kind == 1, place(0, r["w"], ranges)[0], np.where(kind == 2, place(0, r["v"], ranges)[0], place(1, r["p"], ranges)[0]))
    order = np.lexsort((r["p"], part, kind))
    kind, part, r = kind[order], part[order], {k: x[order] for k, x in r.items()}
    starts = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])))) if len(kind) else []
    for s, e in zip(starts, [*starts[1:], len(kind)]):
        one = {k: x[s:e] for k, x in r.items()}
        rows["kind"].append(int(kind[s]))
        rows["part"].append(int(part[s]))
        rows["base"].append(base)
        rows["rows"].append(packed({**one, "p": one["p"] & U(0xFFFFFFFF)}, _SHORT) if kind[s] == 3 else packed(one))


def common_words(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the commonest words: all of at least the least level that leaves COMMON of them."""
    some = grams.where("kind = 0")

    def sizes(batches):
        for b in batches:
            found = [np.bincount(level(np.frombuffer(c, "<i8")), minlength=LEVELS + 1)[1:].tolist() for c in b.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["n"])

    held = some.select("counts").mapInArrow(sizes, "n array<long>").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(LEVELS))).first()
    up = np.cumsum([held[k] or 0 for k in range(LEVELS)][::-1])[::-1]
    least = int((up > COMMON).sum()) + 1

    def pick(batches):
        for b in batches:
            out = []
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                counts = np.frombuffer(counts, "<i8")
                keep = level(counts) >= least
                out.append((np.frombuffer(keys, "<u8")[keep].tobytes(), counts[keep].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([c for _, c in out], pa.binary())], ["keys", "counts"])

    rows = some.select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").collect()  # at most COMMON words
    keys = np.frombuffer(b"".join(r["keys"] for r in rows), "<u8")
    order = np.argsort(keys)
    return keys[order], np.frombuffer(b"".join(r["counts"] for r in rows), "<i8")[order]


def scores(docs: DataFrame, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    size = slices(docs, 1, 1)
    ranges = (max(4, -(-size // WORD_RANGE)), max(8, -(-size // PAIR_RANGE)))
    grams = count_ngrams(docs, ranges)
    documents = docs.where(fold(FOLDS) != HELD_OUT).count()
    model = build(grams, ranges, documents, most_bytes)
    context = docs.sparkSession.sparkContext
    shipped, common = context.broadcast(model), context.broadcast(common_words(grams))
    total, distinct = model.tokens, model.distinct
    bottom = float(np.log10(total + 0.5 * (distinct + 1)))
    names = {
        "kind": pa.int32(), "part": pa.int32(), "hashes": pa.binary(), "docs": pa.binary(), "times": pa.binary(), "base": pa.int64(), "rows": pa.binary(),
        "uid": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "exact": pa.float64(), "score": pa.float64(),
    }
    schema = "kind int, part int, hashes binary, docs binary, times binary, base long, rows binary, uid long, doc_id long, n_tokens long, n_known long, exact double, score double"

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in names.items()], list(names))

    def run(batches):
        f, (keys, counts) = shipped.value, common.value
        base = uid = TaskContext.get().partitionId() << 33
        rare: tuple[list, list, list] = ([], [], [])
        open_: list[dict[str, np.ndarray]] = []
        held = 0

        def flush():
            if rare[0]:
                h, doc, tf = (np.concatenate(x) for x in rare)
                part = place(0, h, f.ranges)[0]
                order = np.argsort(part, kind="stable")
                h, doc, tf, part = h[order], doc[order], tf[order], part[order]
                at = np.searchsorted(part, np.arange(ranges[0] + 1))
                parts = np.flatnonzero(np.diff(at)).tolist()
                cut = lambda x: pa.array([x[at[p] : at[p + 1]].tobytes() for p in parts], pa.binary())
                for x in rare:
                    x.clear()
                yield batch(len(parts), kind=pa.array([0] * len(parts), pa.int32()), part=pa.array(parts, pa.int32()), hashes=cut(h), docs=cut(doc), times=cut(tf.astype("<i4")))
            if open_:
                rows: dict[str, list] = {"kind": [], "part": [], "base": [], "rows": []}
                requests({k: np.concatenate([r[k] for r in open_]) for k in FIELDS}, base, f.ranges, rows)
                open_.clear()
                yield batch(len(rows["kind"]), **{k: pa.array(v, names[k]) for k, v in rows.items()})

        for b in batches:
            n_tokens, n_known, exact_, score = [], [], [], []
            for row, data, offsets in text_chunks(b.column("text")):
                word, pair, doc = tokens(data, offsets)
                n = len(offsets) - 1
                unique, back = np.unique(word, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, unique), max(0, len(keys) - 1))
                found = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
                exact = np.where(found, counts[at] if len(keys) else 0, 0)
                known = found[back]
                n_tokens.append(np.bincount(doc, minlength=n))
                n_known.append(np.bincount(doc, known, n).astype(np.int64))
                exact_.append(np.bincount(doc, np.where(found, np.log10(exact + 0.5), 0.0)[back], n))
                # the model: levels of the chunk's distinct words and pairs; what isn't broadcast stays open
                starts = np.concatenate(([0], np.cumsum(n_tokens[-1])[:-1]))
                lw = f.level(0, unique)
                lw[(lw == 0) & (f.least[0] > 1)] = OPEN
                lw = lw[back]
                lv = np.concatenate(([0], lw[:-1]))
                lv[starts] = BEGINS
                pairs, pair_back = np.unique(pair, return_inverse=True)
                lp = f.level(1, pairs)[pair_back]
                # a pair of a word that no training text has is in none either
                asks = (lv == OPEN) | (lw == OPEN) | ((lp == 0) & (f.least[1] > 1) & (lv != 0) & (lw != 0))
                here = ~asks
                score.append(np.bincount(doc[here], f.logarithm(lv[here], lw[here], lp[here]), n))
                asked = np.flatnonzero(asks)
                _, one, times = np.unique(pair_back[asked] * np.int64(n) + doc[asked], return_index=True, return_counts=True)
                one = asked[one]
                before = np.concatenate(([BEGIN], word[:-1]))
                open_.append({"v": before[one], "w": word[one], "p": pair[one], "doc": doc[one] + (uid - base + row), "tf": times, "lv": lv[one], "lw": lw[one], "lp": lp[one]})
                # rare words go to their range for the base score: one record for each document and word
                rest = np.flatnonzero(~known)
                code, times = np.unique(back[rest] * np.int64(n) + doc[rest], return_counts=True)
                rare[0].append(unique[code // n])
                rare[1].append(code % n + (uid + row))
                rare[2].append(times)
                held += len(code) + len(one)
            join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
            m = b.num_rows
            yield batch(
                m, uid=pa.array(np.arange(uid, uid + m)), doc_id=b.column("doc_id"), n_tokens=join(n_tokens, pa.int64()),
                n_known=join(n_known, pa.int64()), exact=join(exact_, pa.float64()), score=join(score, pa.float64()),
            )
            uid += m
            if held > RUN:
                yield from flush()
                held = 0
        yield from flush()

    first = written(docs.select("doc_id", "text").mapInArrow(run, schema), "scored")

    def look_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one range: each document's sum of logarithms and number of known words."""
        part_keys, part_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if right.num_rows:
            part_keys, part_counts = np.frombuffer(right.column("keys")[0].as_py(), "<u8"), np.frombuffer(right.column("counts")[0].as_py(), "<i8")
        if not left.num_rows:
            return pa.table({"uid": pa.array([], pa.int64()), "add": pa.array([], pa.float64()), "known": pa.array([], pa.int64())})
        h, doc, tf = (np.concatenate([np.frombuffer(x, t) for x in left.column(c).to_pylist()]) for c, t in (("hashes", "<u8"), ("docs", "<i8"), ("times", "<i4")))
        at = np.minimum(np.searchsorted(part_keys, h), max(0, len(part_keys) - 1))
        found = part_keys[at] == h if len(part_keys) else np.zeros(len(h), bool)
        c = np.where(found, part_counts[at] if len(part_keys) else 0, 0)
        uids, back = np.unique(doc, return_inverse=True)
        return pa.table({"uid": uids, "add": np.bincount(back, tf * np.log10(c + 0.5), len(uids)), "known": np.bincount(back, tf * found, len(uids)).astype(np.int64)})

    rare = first.where("kind = 0").select("part", "hashes", "docs", "times")
    exact = grams.where("kind = 0").select("part", "keys", "counts")
    added = rare.groupBy("part").cogroup(exact.groupBy("part")).applyInArrow(look_up, "uid long, add double, known long")
    added = added.groupBy("uid").agg(F.sum("add").alias("add"), F.sum("known").alias("known"))
    rows = first.where("uid is not null").select("uid", "doc_id", "n_tokens", "n_known", "exact", "score").join(added, "uid", "left")
    if max(model.least) > 1:
        rows = rows.join(asked_sums(first.where("kind > 0").select("kind", "part", "base", "rows"), written(filled(grams, (1, 1)), "filter"), shipped), "uid", "left")
        rows = rows.withColumn("score", F.col("score") + F.coalesce("asked", F.lit(0.0)))
    return rows.select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("exact") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * bottom).alias("base_score"), "score",
    )


def asked_sums(asked: DataFrame, segments: DataFrame, shipped) -> DataFrame:
    """(uid, asked): each document's sum of logarithms over its open tokens. Requests meet the segment of the range that
    they ask; those that still lack a level go on to the next range."""

    def bits_of(right: pa.Table) -> np.ndarray:
        return np.frombuffer(right.column("bits")[0].as_py(), np.uint8) if right.num_rows else np.zeros(0, np.uint8)

    def words_(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Kinds 1 and 2: the level of the word, or of the word before."""
        data, rows = bits_of(right), {"kind": [], "part": [], "base": [], "rows": []}
        for kind, base, raw in zip(left.column("kind").to_pylist(), left.column("base").to_pylist(), left.column("rows").to_pylist()):
            r, (hashed, known) = unpacked(raw), ("w", "lw") if kind == 1 else ("v", "lv")
            r[known] = probed(r[hashed].astype(np.uint64), data, 0, 8 * len(data)).astype(np.uint8)
            requests(r, base, shipped.value.ranges, rows)
        return pa.table({"kind": pa.array(rows["kind"], pa.int32()), "part": pa.array(rows["part"], pa.int32()), "base": pa.array(rows["base"], pa.int64()), "rows": pa.array(rows["rows"], pa.binary())})

    def pairs_(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Kind 3: the level of the pair, and with it the logarithm."""
        data, uids, adds = bits_of(right), [np.zeros(0, np.int64)], [np.zeros(0)]
        for base, raw in zip(left.column("base").to_pylist(), left.column("rows").to_pylist()):
            r = unpacked(raw, _SHORT)
            lp = probed(r["p"].astype(np.uint64), data, 0, 8 * len(data))
            uid, back = np.unique(r["doc"], return_inverse=True)
            uids.append(uid.astype(np.int64) + base)
            adds.append(np.bincount(back, r["tf"] * shipped.value.logarithm(r["lv"].astype(np.int64), r["lw"].astype(np.int64), lp), len(uid)))
        return pa.table({"uid": np.concatenate(uids), "add": np.concatenate(adds)})

    of = lambda kind: segments.where(F.col("kind") == kind).select("part", "bits").groupBy("part")
    to = "kind int, part int, base long, rows binary"
    one = written(asked.where("kind = 1").groupBy("part").cogroup(of(0)).applyInArrow(words_, to), "asked-words")
    two = asked.where("kind = 2").union(one.where("kind = 2")).groupBy("part").cogroup(of(0)).applyInArrow(words_, to)
    three = asked.where("kind = 3").union(one.where("kind = 3")).union(two)
    found = three.select("part", "base", "rows").groupBy("part").cogroup(of(1)).applyInArrow(pairs_, "uid long, add double")
    return found.groupBy("uid").agg(F.sum("add").alias("asked"))
