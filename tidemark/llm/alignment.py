"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often id pairs meet.

Both tokenizers write the bytes of space and text. Their token ends cut these bytes into elementary intervals (the union
of both end arrays); each interval lies in one token of either side (searchsorted), so it is one overlap, and ends that
both share close a group. A group's A tokens times its B tokens are its links.

Neither tokenizer joins a character with a space after it, if another character follows the space: such spaces cut a
text into segments that are aligned on their own, once for each worker while remembered. A first pass counts, in each
task, how many documents hold an id pair, and Spark adds up these counts. The second pass looks the counts up: pairs from
a count on that leaves at most PAIRS of them are broadcast, the occurrences of the others are joined by a shuffle. That is
exact at every size, and the others, being rare, have no hot key.

Defined results: a null or empty text, and one that a tokenizer doesn't give back byte by byte (U+2581 is a space to B),
has no tokens: zeros and an empty string. Each row is a document, also where an id repeats or is null. Ties for an A
id's highest count all count as best. Very long texts are aligned whole. Other columns are not read, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, pieces
from .common import written

#: Id pairs whose counts are broadcast at most (17 bytes each).
PAIRS = 2_000_000
#: Segments that a worker remembers, and that are aligned or summed at once.
REMEMBERED, AT_ONCE = 400_000, 200_000
#: Distinct pairs that a task gathers before it passes their counts on.
GATHERED = 2_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(self.n, len(values)), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.data[: self.n]


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each span, one span after the other."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - before, count)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Aligner:
    """The remembered segments: numbers of tokens, groups and links, groups as text, and id pairs with their links."""

    def __init__(self, model: dict, pattern: str, proto: bytes):
        encoding = packing.Ids(model, pattern).encoding
        self.encode_a, self.sp = encoding.encode_ordinary, sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes_a = {i: encoding.decode_single_token_bytes(i) for i in encoding._mergeable_ranks.values()}
        self.bytes_b = []
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            hidden = self.sp.is_control(i) or self.sp.is_unknown(i)
            self.bytes_b.append(bytes([int(piece[1:-1], 16)]) if self.sp.is_byte(i) else b"" if hidden else piece.replace(pieces.MARK, " ").encode())
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.size_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.kinds_b, self.kinds = len(self.bytes_b), max(len(self.size_a), len(self.bytes_b))
        self.named = [b"%c%d" % (c, i) for c in b",|;" for i in range(self.kinds)]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}  # a segment with white space at its edge is held with a space before it
        self.text: list[bytes] = []  # groups as text, each with its separator before it
        self.facts = [Grown(np.int64) for _ in range(5)]  # A tokens, B tokens, groups, links, pairs
        self.bad = Grown(np.bool_)
        self.code, self.links = Grown(np.int64), Grown(np.int64)
        self.start = Grown(np.int64)

    def encoded(self, segments: list[str]) -> tuple[list[int], list[int], list[int], list[int], list[bool]]:
        """Ids of A and B, one segment after the other, their numbers, and which segments don't come back (they have none)."""
        out = [], [], [], [], []
        for s in segments:
            raw, a, b = (" " + s).encode(), self.encode_a(" " + s), self.sp.encode(s)
            bad = b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw
            for held, values in zip(out, ([], [], [0], [0], [True]) if bad else (a, b, [len(a)], [len(b)], [False])):
                held += values
        return out

    def encoded_at_once(self, segments: list[str]) -> tuple:
        """As encoded(), for segments without white space at their edges: joined by spaces they are tokenized as alone."""
        joined = " " + " ".join(segments)
        raw, a, each = joined.encode(), self.encode_a(joined), self.sp.encode(segments)
        b = list(chain.from_iterable(each))
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return self.encoded(segments)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments)) if len(raw) == len(joined) else np.fromiter((len(s.encode()) for s in segments), np.int64, len(segments))
        n_a = np.diff(np.searchsorted(self.size_a[np.array(a)].cumsum(), (sizes + 1).cumsum(), "right"), prepend=0)
        return a, b, n_a, list(map(len, each)), [False] * len(segments)

    def add(self, keys: list[str]) -> None:
        """Aligns new segments, all at once."""
        plain = [k for k in keys if k[0] != " "]
        odd = [k for k in keys if k[0] == " "]
        runs = [self.encoded_at_once(plain[i : i + 2000]) for i in range(0, len(plain), 2000)] + [self.encoded([k[1:] for k in odd])]
        keys = plain + odd
        ids_a, ids_b, n_a, n_b = (np.concatenate([np.asarray(r[k], np.int64) for r in runs]) for k in range(4))
        bad = np.concatenate([np.asarray(r[4], bool) for r in runs])
        ends_a, ends_b = self.size_a[ids_a].cumsum(), self.size_b[ids_b].cumsum()
        bounds = np.union1d(ends_a, ends_b)
        owner_a, owner_b = np.searchsorted(ends_a, bounds), np.searchsorted(ends_b, bounds)
        closes = (ends_a[owner_a] == bounds) & (ends_b[owner_b] == bounds)
        group = closes.cumsum() - closes
        groups = int(closes.sum())
        # each interval is one overlap; a token lies in the group of its last interval
        group_a, group_b = group[np.searchsorted(bounds, ends_a)], group[np.searchsorted(bounds, ends_b)]
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        segment = np.repeat(np.arange(len(keys)), n_a)[in_a.cumsum() - 1] if groups else np.zeros(0, np.int64)
        n_groups = np.bincount(segment, minlength=len(keys))
        # products of the ids of each group, equal ids once with their number
        (own_a, many_a), (own_b, many_b) = (np.unique(g * len(self.size_a) + i, return_counts=True) for g, i in ((group_a, ids_a), (group_b, ids_b)))
        of_a, of_b = own_a // len(self.size_a), own_b // len(self.size_a)
        kinds = np.bincount(of_b, minlength=groups)
        left = np.repeat(np.arange(len(own_a)), kinds[of_a])
        right = spans((kinds.cumsum() - kinds)[of_a], kinds[of_a])
        code = (own_a % len(self.size_a))[left] * self.kinds_b + (own_b % len(self.size_a))[right]
        links, where = many_a[left] * many_b[right], segment[of_a[left]]
        order = np.lexsort((code, where))
        code, links, where = code[order], links[order], where[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (where[1:] != where[:-1])])) if len(code) else np.zeros(0, np.int64)
        code, where = code[first], where[first]
        links = np.add.reduceat(links, first) if len(first) else links
        n_pairs = np.bincount(where, minlength=len(keys))
        # groups as text: tokens by group and side, each with the separator before it
        side = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        after = np.concatenate([[1], np.diff(side)]) if len(side) else side
        separator = np.where(after == 0, 0, 1 + (side & 1 == 0))  # of a side's first token the side says which
        names = list(map(self.named.__getitem__, (separator * self.kinds + np.concatenate([ids_a, ids_b])[order]).tolist()))
        i = 0
        for n in (n_a + n_b).tolist():
            self.text.append(b"".join(names[i : i + n]))
            i += n
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys))))
        n_links = np.zeros(len(keys), np.int64)
        np.add.at(n_links, segment, in_a * in_b)
        for held, values in zip(self.facts, (n_a, n_b, n_groups, n_links, n_pairs)):
            held.extend(values)
        self.start.extend(self.code.n + n_pairs.cumsum() - n_pairs)
        self.bad.extend(bad)
        self.code.extend(code)
        self.links.extend(links)

    def placed(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of texts: from, to, the segments of their texts in order, and where each text's segments begin. Texts that
        don't come back byte by byte have none."""
        begin, cut, n = 0, [], 0
        for end, text in enumerate([*texts, None], 1):
            if cut and (n > AT_ONCE or end > len(texts)):
                at, starts = self.found(cut, texts[begin : begin + len(cut)])
                yield begin, begin + len(cut), at, starts
                begin, cut, n = begin + len(cut), [], 0
            if end <= len(texts):
                cut.append(text.split(" ") if text else [])
                n += len(cut[-1])

    def found(self, cut: list[list[str]], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        every = set().union(*cut)
        new = [k for k in every if k not in self.at]
        if odd := {p for p in new if not p or p.strip() != p}:
            for k, parts in enumerate(cut):
                if not odd.isdisjoint(parts):
                    cut[k] = [" " + p if p.strip() != p else p for p in _CUT.split(texts[k])]
            every = set().union(*cut)
            new = [k for k in every if k not in self.at]
        if len(self.at) + len(new) > REMEMBERED:
            self.clear()
            new = list(every)
        if new:
            self.add(sorted(new))
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(count.sum()))
        if (bad := self.bad.all()).any():
            text_of = np.repeat(np.arange(len(cut)), count)
            lost = np.bincount(text_of, bad[at], len(cut)) > 0
            at, count = at[~lost[text_of]], np.where(lost, 0, count)
        return at, np.concatenate([[0], count.cumsum()])

    def pairs_of(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The distinct id pairs of each text, all texts together."""
        n_text = len(starts) - 1
        text = np.repeat(np.arange(n_text), np.diff(starts))
        own = distinct(text * len(self.text) + at)
        text, at = own // max(1, len(self.text)), own % max(1, len(self.text))
        many = self.facts[4].all()[at]
        code = self.code.all()[spans(self.start.all()[at], many)]
        most = len(self.size_a) * self.kinds_b
        return distinct(np.repeat(text, many) * most + code) % most


_LOADED: dict[str, Aligner] = {}


def loaded(key: str, shipped) -> Aligner:
    """This worker's aligner, which later tasks find again."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(*shipped.value)
    return _LOADED[key]


class Shipped:
    """Both tokenizers' files, read on the driver and broadcast (their sizes are fixed)."""

    def __init__(self, spark: SparkSession, vocabulary: str | None = None, model: str | None = None):
        import public_tokenizers

        raw, proto = Path(vocabulary or packing.tokenizer_file()).read_bytes(), Path(model or pieces.model_file()).read_bytes()
        whole = json.loads(raw)
        kept = {"added_tokens": whole.get("added_tokens", []), "model": {"vocab": whole["model"]["vocab"]}}
        self.key = hashlib.sha256(raw + proto).hexdigest()
        self.value = spark.sparkContext.broadcast((kept, public_tokenizers.PATTERN, proto))
        self.kinds_b = sentencepiece.SentencePieceProcessor(model_proto=proto).get_piece_size()


def pair_counts(docs: DataFrame, shipped: Shipped | None = None) -> DataFrame:
    """Id pairs (a, b), n: the documents that hold them linked, and whether n is the highest of a's pairs."""
    shipped = shipped or Shipped(docs.sparkSession)
    key, value, kinds_b = shipped.key, shipped.value, shipped.kinds_b

    def count(batches):
        aligner, gathered, n = loaded(key, value), [], 0
        for b in batches:
            for _, _, at, starts in aligner.placed(b.column(0).to_pylist()):
                gathered.append(np.unique(aligner.pairs_of(at, starts), return_counts=True))
                n += len(gathered[-1][0])
            if n > GATHERED:
                gathered = [added(gathered)]
                if (n := len(gathered[0][0])) > GATHERED // 2:
                    yield counted(*gathered[0])
                    gathered, n = [], 0
        if gathered:
            yield counted(*added(gathered))

    def added(parts):
        code, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        n = np.zeros(len(code), np.int64)
        np.add.at(n, back, np.concatenate([n for _, n in parts]))
        return code, n

    def counted(code, n):
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    n = written(docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    a = F.floor(F.col("code") / kinds_b).cast("long")
    top = n.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # no more rows than A has ids
    return n.withColumn("a", a).join(top, "a").select("a", (F.col("code") % kinds_b).alias("b"), "n", (F.col("n") == F.col("top")).alias("best"), "code")


def frequent(counts: DataFrame, most: int) -> tuple[int, DataFrame]:
    """A count from which on at most `most` pairs are left, 0 if all are; and these pairs."""
    by = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("pairs")).orderBy(F.desc("k")).collect()  # at most 64 rows
    if sum(r["pairs"] for r in by) <= most:
        return 0, counts
    least = 2 ** (by[0]["k"] + 1)
    for r in by:
        if r["pairs"] > most:
            break
        most, least = most - r["pairs"], 2 ** r["k"]
    return least, counts.where(F.col("n") >= least)


FACTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, digest: bool = False, most: int = PAIRS) -> DataFrame:
    """For each document its tokens, groups and links, how many links are their A id's most frequent ones, the sum of the
    links' counts, and the groups as text (`a1,a2|b1;a3|b2,b3`), or with digest the SHA-256 of that text."""
    spark = docs.sparkSession
    shipped = Shipped(spark, vocabulary, model)
    counts = written(pair_counts(docs, shipped), "counts")
    least, chosen = frequent(counts, most)
    found = chosen.select("code", "n", "best").toArrow()  # at most `most` rows
    order = np.argsort(codes := found["code"].to_numpy())
    table = spark.sparkContext.broadcast((codes[order], found["n"].to_numpy()[order], found["best"].to_numpy()[order]))
    key, value, groups = shipped.key, shipped.value, "groups_sha256" if digest else "groups"

    def known(code):
        """Counts and bests of pairs, and which of them the broadcast table has."""
        codes, n, best = table.value
        if not len(codes):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool), np.zeros(len(code), bool)
        i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        here = codes[i] == code
        return np.where(here, n[i], 0), best[i] & here, here

    def run(batches):
        aligner = loaded(key, value)
        for b in batches:
            facts, text, rare = [], [], []
            for begin, end, at, starts in aligner.placed(b.column(1).to_pylist()):
                own, back = np.unique(at, return_inverse=True)
                many, first = aligner.facts[4].all()[own], aligner.start.all()[own]
                where = spans(first, many)
                code, links = aligner.code.all()[where], aligner.links.all()[where]
                n, best, here = known(code)
                ends = np.concatenate([[0], many.cumsum()])
                by_segment = [total[ends[1:]] - total[ends[:-1]] for total in (np.concatenate([[0], np.cumsum(v)]) for v in (links * best, links * n))]
                values = [f.all()[at] for f in aligner.facts[:4]] + [v[back] for v in by_segment]
                totals = [np.concatenate([[0], v.cumsum()]) for v in values]
                facts.append(np.stack([t[starts[1:]] - t[starts[:-1]] for t in totals]))
                names = list(map(aligner.text.__getitem__, at.tolist()))
                joined = [b"".join(names[s:e])[1:] for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
                text += [hashlib.sha256(t).hexdigest() if t else "" for t in joined] if digest else [t.decode() for t in joined]
                if least:
                    lost = [[] for _ in range(len(own))]
                    for s in np.flatnonzero(np.add.reduceat(~here, ends[:-1]) if len(code) else []).tolist():
                        miss = np.flatnonzero(~here[ends[s] : ends[s + 1]]) + ends[s]
                        lost[s] = list(zip(code[miss].tolist(), links[miss].tolist()))
                    back = back.tolist()
                    rare += [[{"code": c, "links": x} for i in back[s:e] for c, x in lost[i]] for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
            columns = list(np.concatenate(facts, axis=1)) if facts else [np.zeros(0, np.int64)] * len(FACTS)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, columns), pa.array(text, pa.string()), pa.array(rare if least else [[]] * len(text), pa.list_(pa.struct([("code", pa.int64()), ("links", pa.int64())])))],
                ["doc_id", *FACTS, groups, "rare"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in FACTS)}, {groups} string, rare array<struct<code: long, links: long>>")
    if not least:
        return rows.drop("rare")
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "aligned")
    late = rows.select("uid", F.inline("rare")).groupBy("uid", "code").agg(F.sum("links").alias("links")).join(counts.where(F.col("n") < least).select("code", "n", "best"), "code")
    late = late.groupBy("uid").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_count"))
    more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return rows.drop("rare").join(late, "uid", "left").select("doc_id", *FACTS[:4], more("n_best", "more_best"), more("count_sum", "more_count"), groups)
