"""Personal data: overlapping candidate spans, boosted trees over format and context, calibrated thresholds.

Base spans follow fixed patterns and validators and always stay. Beside them, high-recall generators propose spans of
looser form (numbers with any separators, addresses spelt with "at" and "dot", dotted or colon-separated numbers).
Boosted trees score each candidate by its format and context. They learn from the candidates of all documents: a
level of a tree is split by sums that Spark makes over all of one half's.

The label doesn't depend on the base pattern. Positive are forms of validated values that the base patterns don't know
(spelt, re-separated, without "+", hexadecimal), put in the value's own place, and candidates of the text whose value
is valid in an unambiguous form. Negative are candidates whose value fails its validator, values spoiled on purpose,
look-alikes (plain digit runs, dates, book numbers, clock times), and ambiguous forms without a cue before them.
Ambiguous forms with a cue and candidates on base spans have no label. All forms of one value weigh as one example.

For each kind the threshold lies midway between the lowest score at which the other half of the texts (halves by their
hash) keeps PRECISION among such candidates and the next lower score; without TRUE positive examples there, the kind
adds nothing. A candidate that overlaps a base span adds nothing.

The trees are a few kilobytes and go to all workers; detection is one pass over whole texts, without a shuffle, and
linear in the length of a text.

Defined results: a null or empty text has no spans. Offsets are code points. Equal texts, equal spans; spans that begin
together stand in the order of their kinds. Repeated rows count each. Very long texts are searched whole. Extra columns
are not read, whatever their names; redact() keeps all columns and changes text and n_chars. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KINDS = ["email", "ip", "card", "phone"]
PRECISION, TRUE = 0.999, 20
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
CONTEXT = 24

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# (?<![0-9]) saves only attempts that can't succeed: a failure at a run's first digit is one at each of its digits
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ()./_-]{0,2}[0-9]){8,22}")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|,|-) ?[0-9]{1,3}){3}")
_HEX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}")
_SPELT = re.compile(r"[\w.+-]{1,64} ?(?:\[at\]|\(at\)|@| at) ?[\w-]{1,63} ?(?:\[dot\]|\(dot\)|dot) ?[A-Za-z]{2,24}")
_PARTS = re.compile(r"[\w.+-]+?(?: ?(?P<mark>\[at\]|\(at\)|@) ?| at )[\w-]+(?: ?(?P<point>\[dot\]|\(dot\)) ?| dot )[A-Za-z]{2,24}")
_CUES = {
    "email": ("mail", "contact", "write", "courriel", "correo"), "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "carte", "karte", "tarjeta", "credit"), "phone": ("call", "phone", "tel", "fax", "mobile", "telefon"),
}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ in turn: the characters of a local part before it, back to the last match, and a domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            out.append((start, end.end()))
        done = end.end() if end else at + 1
        at = text.find("@", done)
    return out


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base spans, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out.extend((m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15)
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the proposed spans; they may overlap, and one span may have several kinds."""
    out = []
    if "@" in text:
        out.extend((s, 0, e) for s, e in emails(text))
    if "dot" in text:
        out.extend((m.start(), 0, m.end()) for m in _SPELT.finditer(text))
    if _DIGIT.search(text):
        out.extend((m.start(), 1, m.end()) for m in _QUAD.finditer(text))
        if ":" in text:
            out.extend((m.start(), 1, m.end()) for m in _HEX.finditer(text))
        out.extend((m.start(), k, m.end()) for m in _NUMBER.finditer(text) for k in (2, 3))
    return sorted(set(out))


def alone(text: str, start: int, end: int) -> bool:
    """No letter or digit touches the span."""
    return not (text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum())


def cued(text: str, start: int, kind: int) -> bool:
    words = re.findall(r"[a-z]+", text[max(0, start - CONTEXT) : start].lower())
    return any(w in _CUES[KINDS[kind]] for w in words[-3:])


def valid(text: str, start: int, kind: int, end: int) -> tuple[bool, bool]:
    """Whether the span's value is valid, whatever its separators, and whether its form allows no other reading."""
    s = text[start:end]
    if not alone(text, start, end):
        return False, True
    if kind == 0:
        m = _PARTS.fullmatch(s)
        return bool(m), bool(m and (m["mark"] or m["point"]))
    if kind == 1 and ":" in s:
        try:
            return bool(ipaddress.IPv6Address(s)), True
        except ValueError:
            return False, True
    if kind == 1:
        return all(int(g) <= 255 for g in re.findall(r"[0-9]+", s)), "[.]" in s
    d = digits_of(s)
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d), True
    return 10 <= len(d) <= 15, False


def forms(kind: int, s: str) -> tuple[list[str], list[str]]:
    """Of a validated base span: forms of its value that no base pattern knows, and look-alikes that are not personal."""
    d, groups = digits_of(s), re.findall(r"[0-9]+", s)
    if kind == 0:
        local, domain = s.rsplit("@", 1)
        first, _, last = domain.rpartition(".")
        host = first.rpartition(".")[2]
        told = [f"{local}{at}{host}{dot}{last}" for at, dot in ((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("@", "[dot]"), (" at ", " dot "))]
        return told, [f"{host} at anec{'dot'}{last}", f"{host} at {host}dot{last}"]
    if kind == 1:
        a, b, c, e = (int(g.lstrip("0") or 0) for g in groups[:4])
        hexed = f"2001:db8:{a:x}:{b:x}:{c:x}:{e:x}:ffff:{(a << 8) + b:x}"
        return ["[.]".join(groups), hexed], ["[.]".join(["999", *groups[1:]]), ":".join(f"{x:02x}" for x in (a, b, c, e, 17, 4)), "12:30:45:10", "-".join(groups), ", ".join(groups)]
    if kind == 2:
        cut = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, len(x), 4))
        wrong = d[:-1] + str((int(d[-1]) + 5) % 10)
        return [cut(d, sep) for sep in "./_"], [cut(wrong, sep) for sep in "./_- "] + [wrong]
    told = [s.lstrip("+"), "00" + s.lstrip("+"), *(sep.join((d[:-10], d[-10:-7], d[-7:-4], d[-4:])).lstrip(sep) for sep in "-./ ")]
    return told, [d, d[:9], "978-3-16-148410-0", "2024-01-15 2024", "12/05/2024 1305", "2024.01.15 12.30"]


def examples(text: str) -> list[tuple[int, int, float, list[float]]]:
    """(kind, label, weight, features) of the labelled candidates of a text."""
    out, known = [], base(text)
    for c in candidates(text):
        if all(c[2] <= s or e <= c[0] for s, _, e in known):
            right, clear = valid(text, *c)
            if not right or clear or not cued(text, c[0], c[1]):
                out.append((c[1], int(right and clear), 1.0, describe(text, *c)))
    for s, k, e in known:
        before, after = text[max(0, s - 4 * CONTEXT) : s], text[e : e + CONTEXT]
        for y, told in zip((1, 0), forms(k, text[s:e])):
            for form in told:
                at, end, whole = len(before), len(before) + len(form), before + form + after
                fixed = base(whole)
                for c in candidates(whole):
                    # a base span needs no label; a part of a form, or a form under another kind, is negative
                    if at <= c[0] and c[2] <= end and c not in fixed:
                        label = y if c == (at, k, end) else 0
                        out.append((c[1], label, 1.0 / len(told), describe(whole, *c)))
    return out


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a span."""
    s = text[start:end]
    d = digits_of(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    octets = [int(g) for g in re.findall(r"[0-9]{1,3}", s)[:8]] or [0]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    words = re.findall(r"[a-z]+", before.lower())
    return [
        kind, len(s), len(d), sum(c.isalpha() for c in s), len(groups), groups[0], max(groups), groups[-1], max(octets),
        s.count(" "), s.count("-"), s.count("."), s.count("("), float("@" in s), float(s[0] == "+"), float(bool(d) and luhn(d)),
        float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in "+=#$/"), float(any(w in _CUES[KINDS[kind]] for w in words[-3:])),
        s.count(":"), s.count("["), s.count("/"), float(" at " in s and " dot " in s), *map(float, valid(text, start, kind, end)),
    ]


FEATURES = len(describe("1", 0, 0, 1))


class Boosted:
    """Boosted regression trees for a yes-no label: full trees of DEPTH levels over binned features."""

    def __init__(self, edges: list[np.ndarray], start: float):
        self.edges, self.start = edges, start
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)

    def grow(self, binned: DataFrame) -> None:
        """One more tree, split level by level by sums over all rows of binned (y, w, bins)."""
        feature, cut, value = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS), np.zeros(2**DEPTH)
        for level in range(DEPTH):
            for k, (g, h) in enumerate(self.sums(binned, feature, cut, level)):
                gl, hl, node = np.cumsum(g, 1), np.cumsum(h, 1), 2**level - 1 + k
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                j, c = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, c] > 1e-6:
                    feature[node], cut[node] = j, c
                j, c = feature[node], cut[node]
                if level == DEPTH - 1:
                    value[2 * k : 2 * k + 2] = gl[j, c] / (hl[j, c] + 1), (gt[j, 0] - gl[j, c]) / (ht[j, 0] - hl[j, c] + 1)
        self.trees.append((feature, cut, value))

    def sums(self, binned: DataFrame, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """First and second derivatives, added up for each node of the level, feature and bin. They are added as whole
        numbers, so that the order of rows doesn't matter; a part of the rows gives one row of sums."""
        shape = (2**level, 2, FEATURES, BINS + 1)

        def run(batches):
            total = np.zeros(shape, np.int64)
            for b in batches:
                rows = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, FEATURES)
                y, w = (b.column(c).to_numpy() for c in ("y", "w"))
                p = 1 / (1 + np.exp(-self.binned_score(rows)))
                at = self.walk(feature, cut, rows, level)
                cells = ((at[:, None] * FEATURES + np.arange(FEATURES)) * (BINS + 1) + rows).ravel()
                for i, v in enumerate((w * (y - p), w * p * (1 - p))):
                    added = np.bincount(cells, np.repeat(np.rint(v * 2**24), FEATURES), 2**level * FEATURES * (BINS + 1))
                    total[:, i] += added.astype(np.int64).reshape(2**level, FEATURES, BINS + 1)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        parts = binned.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r["sums"], np.int64) for r in parts).reshape(shape) / 2**24

    @staticmethod
    def walk(feature: np.ndarray, cut: np.ndarray, binned: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(binned), np.int64)
        for level in range(levels):
            node = 2**level - 1 + at
            at = 2 * at + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        return at

    def binned_score(self, binned: np.ndarray) -> np.ndarray:
        f = np.full(len(binned), self.start)
        for feature, cut, value in self.trees:
            f += RATE * value[self.walk(feature, cut, binned, DEPTH)]
        return f

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.binned_score(self.bins(x))


class Model:
    """The trees, and for each kind the least score that is taken."""

    def __init__(self, trees: Boosted | None, least: list[float]):
        self.trees, self.least = trees, least

    def spans(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """For each text its base spans and the added ones."""
        found = [base(t) if t else [] for t in texts]
        added: list[list] = [[] for _ in texts]
        if self.trees is not None:
            where, rows = [], []
            for i, t in enumerate(texts):
                for c in candidates(t) if t else []:
                    if all(c[2] <= s or e <= c[0] for s, _, e in found[i]):
                        where.append((i, c))
                        rows.append(describe(t, *c))
            if rows:
                for (i, c), score in zip(where, self.trees.score(np.array(rows, float))):
                    if score >= self.least[c[1]]:
                        added[i].append(c)
        return list(zip(found, added))


def fit(docs: DataFrame) -> Model:
    """Learns from the labelled candidates of all documents. Equal ones are one row with their weight; edges of bins, splits,
    leaves and thresholds are sums over all rows of a half."""

    def describe_all(batches):
        for b in batches:
            half, rows = [], []
            for text in b.column("text").to_pylist():
                found = examples(text) if text else []
                rows.extend(found)
                half.extend([hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=1).digest()[0] % 2 for _ in found[:1]] * len(found))
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
            columns = [pa.array(half, pa.int32()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["half", "kind", "y", "w", "x"])

    every = docs.select("text").mapInArrow(describe_all, "half int, kind int, y int, w double, x array<double>")
    # equal candidates stand together with their weight and number
    found = written(every.groupBy("half", "kind", "y", "x").agg(F.sum("w").alias("w"), F.count("*").alias("n")), "candidates")
    true = {(r["half"], r["kind"]): r["n"] for r in found.groupBy("half", "kind").agg(F.sum(F.col("y") * F.col("n")).alias("n")).collect()}
    if sum(n for (half, _), n in true.items() if half == 0) < TRUE:
        return Model(None, [])
    trees = learnt(found.where("half = 0"))
    limits = thresholds(found.where("half = 1"), trees)
    return Model(trees, [limits.get(k, float("inf")) if true.get((1, k), 0) >= TRUE else float("inf") for k in range(len(KINDS))])


def learnt(rows: DataFrame) -> Boosted:
    """Trees over all rows (y, w, x). Rows that fall into the same bins are one."""
    steps = ", ".join(str(i / BINS) for i in range(1, BINS))
    cuts = [F.expr(f"percentile_approx(x[{j}], array({steps}))").alias(f"c{j}") for j in range(FEATURES)]
    r = rows.agg(*cuts, F.sum(F.col("w") * F.col("y")).alias("yes"), F.sum(F.col("w") * (1 - F.col("y"))).alias("no")).first()
    trees = Boosted([np.unique(r[f"c{j}"]) for j in range(FEATURES)], float(np.log((r["yes"] + 0.5) / (r["no"] + 0.5))))

    def to_bins(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(-1, FEATURES)
                bins = [row.tobytes() for row in trees.bins(x).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column("y"), b.column("w"), pa.array(bins, pa.binary())], ["y", "w", "bins"])

    binned = written(rows.select("y", "w", "x").mapInArrow(to_bins, "y int, w double, bins binary").groupBy("y", "bins").agg(F.sum("w").alias("w")), "binned")
    for _ in range(TREES):
        trees.grow(binned)
    return trees


def thresholds(rows: DataFrame, trees: Boosted) -> dict[int, float]:
    """For each kind the least score at which rows of that score or more keep PRECISION, taken halfway down to the next
    lower one. Scores are summed from above in narrow ranges, so no kind is one sorted group."""

    def to_scores(batches):
        for b in batches:
            if b.num_rows:
                score = trees.score(b.column("x").flatten().to_numpy().reshape(-1, FEATURES))
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("y"), b.column("w"), pa.array(score, pa.float64())], ["kind", "y", "w", "score"])

    scored = rows.select("kind", "y", "w", "x").mapInArrow(to_scores, "kind int, y int, w double, score double")
    scored = written(scored.groupBy("kind", F.floor(F.col("score") * 64).alias("range"), "score").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")), "scores")
    higher = Window.partitionBy("kind").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("kind", "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    above = scored.groupBy("kind", "range").agg(F.sum("w").alias("rw"), F.sum("wy").alias("rwy"))
    above = above.select("kind", "range", *(F.coalesce(F.sum(c).over(higher), F.lit(0.0)).alias(c) for c in ("rw", "rwy")))
    right = (F.col("rwy") + F.sum("wy").over(upto)) / (F.col("rw") + F.sum("w").over(upto))
    least = scored.join(F.broadcast(above), ["kind", "range"]).select("kind", "score", (right >= PRECISION).alias("right")).where("right").groupBy("kind").agg(F.min("score").alias("least"))
    both = scored.join(F.broadcast(least), "kind").groupBy("kind").agg(F.first("least").alias("least"), F.max(F.expr("case when score < least then score end")).alias("lower"))
    return {r["kind"]: r["least"] if r["lower"] is None else (r["least"] + r["lower"]) / 2 for r in both.collect()}


def written_out(spans: list[tuple[int, int, int]], extra: list[tuple[int, int, int]] = ()) -> str:
    """kind:start:end, by start and then kind; added spans have kinds of their own, after the others."""
    named = [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in spans] + [(s, len(KINDS) + k, f"other_{KINDS[k]}:{s}:{e}") for s, k, e in extra]
    return ",".join(x for _, _, x in sorted(named))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their checksum and all spans of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for b in batches:
            found = model.value.spans(b.column("text").to_pylist())
            counts = [Counter(k for _, k, _ in spans) for spans, _ in found]
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            sha = [hashlib.sha256(written_out(spans).encode()).hexdigest() for spans, _ in found]
            every = [written_out(spans, extra) for spans, extra in found]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(sha, pa.string()), pa.array(every, pa.string())], names)

    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    if not text or not spans:
        return text
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s >= done:
            out.extend((text[done:s], f"[{KINDS[k].upper()}]"))
        done = max(done, e)
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all spans replaced."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            new = [redacted(t, spans + extra) for t, (spans, extra) in zip(texts, model.value.spans(texts))]
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
            if "n_chars" in b.schema.names:
                at = b.schema.get_field_index("n_chars")
                kept = b.column(at).to_pylist()
                sizes = [n if a == t else len(a) for a, t, n in zip(new, texts, kept)]
                b = b.set_column(at, "n_chars", pa.array(sizes, pa.int64()).cast(b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
