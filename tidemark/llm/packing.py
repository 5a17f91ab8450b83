"""Packing: documents become pieces of at most 1024 tokens, and a cutting-stock plan puts the pieces into sequences.

Each document's ids (and one id 0) are cut every SEQUENCE ids; full pieces are sequences of their own. The shorter
tails are counted by length class (UNIT tokens) over all documents. The driver solves the cutting-stock linear program
over this histogram (at most SEQUENCE / UNIT rows) by column generation: the simplex method's dual prices go into a
knapsack dynamic program, whose best pattern enters the basis until none improves. Patterns are rounded down, the
remaining demand is filled largest first, and every tail finds its sequence from its rank within its class.

Ranks are a running count: within the written partition a row stands in, plus the counts of that class in earlier
partitions. So no class, however large, meets in one task, and the driver sees only the histogram.

Defined results: a null or empty text has the single id 0. Every row is packed; repeated rows count each, and rows with
one id have pieces each. Very long texts are cut into as many pieces as they need. Ties: tails of one class are equal to
the plan, and go by their place in the table. Extra columns are not read, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

import json
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SEQUENCE = 1024
UNIT = 2
#: Distinct words whose ids a worker remembers.
REMEMBERED = 300_000


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class NotAlone(Exception):
    """A part between two spaces that is empty or has white space at its edge."""


class Ids(dict):
    """The ids of a text as little-endian unsigned 32-bit integers.

    A single space between two other characters always begins a new piece of the tokenizer's pattern, so the words
    between such spaces are encoded once and remembered. Parts for which this doesn't hold are kept together. The
    vocabulary file's added tokens cut a text before all else, and each is one id, as in `tokenizers` by default.
    """

    def __init__(self, model: dict, pattern: str):
        super().__init__()
        added = model.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        alphabet, special = byte_alphabet(), set(self.added)
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def pack(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise NotAlone
        if len(self) >= REMEMBERED:
            self.clear()
        self[part] = found = self.pack(" " + part)
        return found

    def of(self, text: str | None) -> bytes:
        text = text or ""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out, done = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[done : m.start()]), self.added[m.group()]]
            done = m.end()
        return b"".join([*out, self.plain(text[done:])])

    def plain(self, text: str) -> bytes:
        parts = text.split(" ")
        try:
            if len(parts) == 1 or not parts[0] or parts[0][-1].isspace():
                raise NotAlone
            return self.pack(parts[0]) + b"".join(map(self.__getitem__, parts[1:]))
        except NotAlone:
            return self.joined(parts)

    def joined(self, parts: list[str]) -> bytes:
        """As plain(), with the parts between unsafe spaces put together again."""
        out, held = [], [parts[0]]
        alone = lambda left, right: left and right and not left[-1].isspace() and not right[0].isspace()
        first = True
        for left, right in zip(parts, parts[1:]):
            if alone(left, right):
                out.append(self.pack(("" if first else " ") + " ".join(held)))
                first, held = False, [right]
            else:
                held.append(right)
        out.append(self.pack(("" if first else " ") + " ".join(held)))
        return b"".join(out)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Every document's pieces with their checksums. The vocabulary file is read once, on the driver."""
    import public_tokenizers

    model, pattern = json.loads(Path(vocabulary or tokenizer_file()).read_text()), public_tokenizers.PATTERN
    shipped = docs.sparkSession.sparkContext.broadcast((model, pattern))

    def cut(batches):
        ids = Ids(*shipped.value)
        for b in batches:
            rows = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = ids.of(text) + b"\0\0\0\0"
                n = len(raw) // 4
                for s in range(0, n, SEQUENCE):
                    e = min(n, s + SEQUENCE)
                    for k, v in zip(rows, (doc_id, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), n)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes that fits (sizes ascending), by dynamic programming."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            value = best[c - sizes[:k]] + prices[:k]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], took[c] = value[i], i
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), counts


def exchange(basis: np.ndarray, inverse: np.ndarray, out: int, pattern: np.ndarray, way: np.ndarray) -> None:
    """Puts a pattern into the basis; way is the inverse times the pattern."""
    basis[:, out] = pattern
    pivot = inverse[out] / way[out]
    inverse -= np.outer(way, pivot)
    inverse[out] = pivot


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, steps: int = 4000) -> list[tuple[int, np.ndarray]]:
    """(copies, counts by class) of patterns that together hold the demand exactly. After `steps` columns no more are priced:
    the patterns then hold everything all the same, in as few sequences as the columns so far allow."""
    if not len(sizes):
        return []
    n = len(sizes)
    # first basis: largest-first patterns, each used until it exhausts one class; column i exhausts class i
    basis, x = np.diag(room // sizes).astype(float), np.zeros(n)
    inverse = np.diag(1.0 / np.diag(basis))
    rest, open_ = demand * (1 + 1e-7 * np.arange(1, n + 1) / n), np.ones(n, bool)
    for _ in range(n):
        free, pattern = room, np.zeros(n)
        for i in np.flatnonzero(open_)[::-1]:
            pattern[i] = min(free // sizes[i], np.ceil(rest[i]))
            free -= pattern[i] * sizes[i]
        ratio = np.where(pattern > 0, rest / np.maximum(pattern, 1), np.inf)
        out = int(ratio.argmin())
        x[out] = ratio[out]
        rest = np.maximum(rest - x[out] * pattern, 0)
        open_[out] = False
        exchange(basis, inverse, out, pattern, (inverse * pattern).sum(1))
    for _ in range(steps):
        prices = inverse.sum(0)
        value, pattern = knapsack(sizes, np.maximum(prices, 0), room)
        if value <= 1 + 1e-7:
            break
        way = (inverse * pattern).sum(1)
        ratio = np.where(way > 1e-10, x / np.where(way > 1e-10, way, 1), np.inf)
        out = int(ratio.argmin())
        exchange(basis, inverse, out, pattern, way)
        x = x - ratio[out] * way
        x[out] = ratio[out]
    patterns, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-x, kind="stable"):
        counts = basis[:, k].astype(np.int64)
        held = counts > 0
        copies = min(int(np.floor(x[k] + 1e-6)), int((left[held] // counts[held]).min()))
        if copies > 0:
            patterns.append((copies, counts))
            left -= copies * counts
    while left.any():  # what rounding left, largest first
        counts, free = np.zeros(n, np.int64), room
        for i in np.flatnonzero(left)[::-1]:
            counts[i] = min(left[i], free // sizes[i])
            free -= counts[i] * sizes[i]
        held = counts > 0
        copies = int((left[held] // counts[held]).min())
        patterns.append((copies, counts))
        left -= copies * counts
    return patterns


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    cut = written(pieces(docs, vocabulary).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    # class 0: full pieces; part: the partition that wrote the row
    rows = cut.withColumn("part", F.shiftright("uid", 33)).withColumn(
        "class", F.when(F.col("length") == SEQUENCE, 0).otherwise(F.ceil(F.col("length") / UNIT)).cast("int")
    )
    counts = written(rows.groupBy("part", "class").agg(F.count("*").alias("n")), "histogram")
    total = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    sizes = np.array(sorted(c for c in total if c), np.int64)
    patterns = cutting_stock(sizes, np.array([total[c] for c in sizes.tolist()]), SEQUENCE // UNIT)
    slots: dict[int, list[tuple[int, int, int]]] = {}  # by class: first rank, tails in one copy, first sequence
    filled: dict[int, int] = {}
    sequences = 0
    for copies, held in patterns:
        for i in np.flatnonzero(held).tolist():
            c = int(sizes[i])
            slots.setdefault(c, []).append((filled.get(c, 0), int(held[i]), sequences))
            filled[c] = filled.get(c, 0) + copies * int(held[i])
        sequences += copies
    plan = {c: tuple(np.array(v).T) for c, v in slots.items()}
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("part", "class").orderBy("uid")
    ranked = (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(offsets, ["part", "class"]).withColumn("rank", F.col("at") + F.col("before"))
    )

    @F.pandas_udf("long")
    def sequence(cls: pd.Series, rank: pd.Series) -> pd.Series:
        c, r = cls.to_numpy(), rank.to_numpy()
        out = sequences + r  # full pieces
        for one in np.unique(c[c > 0]):
            first, each, base = plan[int(one)]
            here = c == one
            k = np.searchsorted(first, r[here], "right") - 1
            out[here] = base[k] + (r[here] - first[k]) // each[k]
        return pd.Series(out)

    placed = ranked.withColumn("sequence_id", sequence("class", "rank")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "class", "uid")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).drop("class", "uid")
