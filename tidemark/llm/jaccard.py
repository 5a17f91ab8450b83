"""N-gram Jaccard join: all pairs of documents whose sets of five-word shingles overlap by at least 80 %, as components.

Count-vector R-tree: shingles are hashed into GROUPS groups and a document is the point of its group counts. Two
documents share at most the sum of coordinate minima of their points, and two subtrees at most the sum of minima of
their boxes' upper corners; pairs below the overlap that 80 % asks for are never opened. Pairs that survive are verified
on their full sets. The points of all documents don't go into one tree: a tree is built for each bucket.

Buckets. In any fixed order of shingles, two documents that reach 80 % share one of their n - ceil(0.8 n) + 1 first
shingles, so that documents meet in the buckets of these. The order is by hash, with the shingles last that about
FREQUENT * PART_COUNTED documents have (the order decides how many documents meet, not which pairs are found). Buckets of
more than CELL documents are divided into CELL x CELL blocks that cover all their pairs.

Groups of copies. Equal sets are one node; a node has a 64-bit name, or a second one where two different sets (by a
128-bit hash) have the first in common. Nodes with one of KEYS equal minimum hashes are first verified against the
least node with that hash, which costs one pair for each node. Buckets whose nodes are then all in one component are
done. In the others FIRSTS nodes are verified with those they often meet, again with other nodes as long as one pair of
PROGRESS is a link, and in the end only pairs across components count. So a large group of copies is not expanded into its pairs.

Defined results: words are runs of bytes other than 0x20 and 0x09-0x0D, after A-Z are lowered. A text of one to four words has one shingle, the
whole sequence; null and empty texts, and texts of white space, have none, and stand alone. Repeated rows, ids that are
null or occur with several texts: sets link, rows follow their sets; a component's id is its least id that isn't null.
Very long texts are compared whole. Extra columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import connected
from .textvec import U, mix, shingle_sets

WORDS = 5
#: Groups of the tree's points; larger sets have finer counts, which fold into these, for the last bound before a pair is verified.
GROUPS = 128
FINER = ((1000, 512), (4000, 2048), (16_000, 8192))
KEYS = 3
FIRSTS, PROGRESS = 4, 32
#: A shingle is frequent if FREQUENT of the counted documents have it: one of PART_COUNTED documents, LEAST_COUNTED at
#: least. The FREQUENT_MOST most frequent come last in the order.
FREQUENT, PART_COUNTED, LEAST_COUNTED, FREQUENT_MOST = 4, 32, 2048, 400_000
CELL = 1024
LEAF, FANOUT = 32, 8
#: Records of one bucket partition, and rows up to which a table of ids or keys is broadcast (8 bytes each).
PART = 400_000
BROADCAST_ROWS = 2_000_000


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def small(df: DataFrame) -> DataFrame:
    """df, a written table of a few columns, with a broadcast hint if it has at most a quarter of BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS // 4 else df


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The shingles that most documents have, sorted; at most FREQUENT_MOST. They are counted over a fixed part of the
    documents, chosen by hash, so that what counts as frequent doesn't grow with the table."""
    rate = max(1 / PART_COUNTED, min(1.0, LEAST_COUNTED / max(1, docs.count())))

    def explode(batches):
        for b in batches:
            found = list(shingle_sets(b.column("text"), WORDS))
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(found) if found else np.zeros(0, np.uint64))], ["s"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20))).select("text")
    seen = chosen.mapInArrow(explode, "s long").groupBy("s").agg(F.count("*").alias("n"))
    most = seen.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(FREQUENT_MOST).select("s").toArrow()
    return np.sort(most.column("s").to_numpy().view(np.uint64))


def node_of(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, from its sorted hashes, in two halves."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def with_names(docs: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """features(), with each set's node under one name of 64 bits; and the first halves that several sets share, whose
    sets have their second half as name. Among n sets about n * n / 2 ** 65 halves are shared: 3 of ten billion."""
    made = written(features(docs), "features")
    twice = made.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("node")
    shared = frozenset(r["node"] for r in twice.collect())
    if shared:
        made = made.withColumn("node", F.when(F.col("node").isin(list(shared)), F.col("check")).otherwise(F.col("node")))
    return made.drop("check"), shared


def features(docs: DataFrame) -> DataFrame:
    """doc_id, node and check (halves of the set's name), n (set size), keys (minimum hashes), prefix and counts of every
    document."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))
    salts = [U((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64) for k in range(KEYS)]

    def run(batches):
        last = frequent.value
        for b in batches:
            node, check, size, keys, prefix, counts = [], [], [], [], [], []
            for s in shingle_sets(b.column("text"), WORDS):
                n = len(s)
                size.append(n)
                for half, x in zip((node, check), node_of(s)):
                    half.append(x)
                keys.append([int(mix(s ^ k).min().view(np.int64)) for k in salts] if n else [])
                k = n - -(-4 * n // 5) + 1 if n else 0
                if len(last) and n:
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    late = last[at] == s
                    first = s[~late][:k]
                    if len(first) < k:
                        first = np.concatenate([first, s[late][: k - len(first)]])
                else:
                    first = s[:k]
                prefix.append(first.tobytes())
                groups = max([GROUPS, *(g for least, g in FINER if n > least)])
                counts.append(np.bincount((mix(s + U(7)) % U(groups)).astype(np.int64), minlength=groups).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(prefix, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "node", "check", "n", "keys", "prefix", "counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, check long, n long, keys array<long>, prefix binary, counts binary")


def bounded_pairs(each: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs of nodes (a, b), those whose group counts allow 80 %. Counts are a small part of a set's size, so that
    sets are made and sent for few of the pairs that only share a hash or a part of a prefix. each: node, n, counts."""
    side = lambda k, i: each.select(F.col("node").alias(k), F.col("n").alias(f"n{i}"), F.col("counts").alias(f"c{i}"))

    def run(batches):
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in ("n0", "n1"))
            keep = (5 * n >= 4 * m) & (5 * m >= 4 * n)
            for i in np.flatnonzero(keep).tolist():
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), "<u2").astype(np.uint32) for c in ("c0", "c1"))
                keep[i] = allowed(x, y, n[i] + m[i])
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a", 0), "a").join(side("b", 1), "b").select("a", "b", "n0", "n1", "c0", "c1").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, made: DataFrame, pairs: DataFrame, shared: frozenset[int] = frozenset(), bounded: bool = False) -> DataFrame:
    """Of the pairs of nodes (a, b), those that reach 80 %. Unless they were bounded before, their group counts are compared
    first. The sets of the nodes that remain are made again from the texts."""
    pairs = written(pairs, "pairs")
    if not (n := pairs.count()):
        return pairs
    # a pair has two nodes; many pairs can still have few, so these are counted
    few = lambda df, label, n: F.broadcast(df) if 2 * n <= BROADCAST_ROWS // 4 else small(written(df, label))
    nodes = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # any document of each node will do
    columns = [F.min("doc_id").alias("doc_id"), *([] if bounded else [F.first(c).alias(c) for c in ("n", "counts")])]
    each = written(made.join(few(nodes(pairs), "nodes", n), "node").groupBy("node").agg(*columns), "each")
    if not bounded:
        pairs = written(bounded_pairs(each, pairs), "bounded")
        if not (n := pairs.count()):
            return pairs
        each = each.join(few(nodes(pairs), "nodes", n), "node", "left_semi")
    # texts are never shuffled for ids that fit a broadcast; null is no key of it, and rows without id are few or all needed
    ids = written(each.select(F.col("doc_id").alias("id")).distinct(), "ids")
    known = ids.where("id is not null")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS // 2 else known
    texts = docs.join(known, docs["doc_id"] == known["id"], "left_semi").select("text")
    if not ids.where("id is null").isEmpty():
        texts = texts.union(docs.where("doc_id is null").select("text"))

    def sets(batches):
        for b in batches:
            found = list(shingle_sets(b.column("text"), WORDS))
            names = [check if node in shared else node for node, check in map(node_of, found)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "set"])

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = written(texts.mapInArrow(sets, "node long, set binary").dropDuplicates(["node"]), "sets")
    side = lambda k, v: full.select(F.col("node").alias(k), F.col("set").alias(v))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(compare, "a long, b long"), "links")


def mixed_buckets(made: DataFrame) -> DataFrame:
    """Keys of the buckets that hold nodes of two components or more. made: node, component, prefix.

    Each task sends, for each bucket of a run of documents, the least and the largest component there, so that a bucket
    of many documents costs one record for each run."""
    total = made.agg(F.sum(F.octet_length("prefix")).alias("b")).first()["b"] or 0
    parts = max(8, -(-total // (8 * PART)))

    def ends(key, least, most):
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        if not len(new):
            return key, least, most
        return key[new], np.minimum.reduceat(least[order], new), np.maximum.reduceat(most[order], new)

    def send(batches):
        held, rows = [], 0

        def flush():
            component = np.concatenate([c for _, c in held])
            key, least, most = ends(np.concatenate([k for k, _ in held]), component, component)
            at = np.searchsorted((key >> U(32)).astype(np.int64), np.arange(parts + 1))
            here = [p for p in range(parts) if at[p] < at[p + 1]]
            cut = lambda x: pa.array([x[at[p] : at[p + 1]].tobytes() for p in here], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), cut((key & U(0xFFFFFFFF)).astype("<u4")), cut(least), cut(most)], ["part", "keys", "least", "most"])

        for b in batches:
            for raw, component in zip(b.column("prefix").to_pylist(), b.column("component").to_pylist()):
                k = bucket_keys(np.frombuffer(raw, np.uint64), parts)
                held.append((k, np.full(len(k), component, np.int64)))
                rows += len(k)
                if rows > 500_000:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()

    def meet(key: tuple, frame: pa.Table) -> pa.Table:
        low, least, most = (np.concatenate([np.frombuffer(x, t) for x in frame.column(c).to_pylist()]) for c, t in (("keys", "<u4"), ("least", np.int64), ("most", np.int64)))
        low, least, most = ends(low, least, most)
        return pa.table({"key": pa.array((int(key[0].as_py()) << 32) | low[least != most].astype(np.int64), pa.int64())})

    sent = made.select("prefix", "component").mapInArrow(send, "part int, keys binary, least binary, most binary")
    return written(sent.groupBy("part").applyInArrow(meet, "key long"), "mixed").withColumn("parts", F.lit(parts))


def bucket_keys(prefix: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each shingle: its partition in the upper half, 32 bits of hash in the lower."""
    h = mix(prefix ^ U(0x5851F42D4C957F2D))
    return ((h >> U(32)) % U(parts)) << U(32) | (h & U(0xFFFFFFFF))


class RTree:
    """Points packed into leaves and boxes, level by level; only upper corners and least sizes are needed."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        # packed by size, then by the group in which a document has most shingles
        self.order = np.lexsort((points.argmax(1), n * 8 // max(1, int(n.max()))))
        points, n = points[self.order], n[self.order]
        self.levels = [(points, n, n)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            p, low, high = self.levels[-1]
            at = np.arange(0, len(p), width)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
            width = FANOUT

    def pairs(self, other: RTree) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the points of both trees whose bound reaches the overlap asked for."""
        if len(self.levels) < len(other.levels):
            y, x = other.pairs(self)
            return x, y
        depth = len(self.levels) - 1
        x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(depth, -1, -1):
            p, low, high = self.levels[level]
            q, low_q, high_q = other.levels[min(level, len(other.levels) - 1)]
            if level < depth:
                x, y = self.children(x, y, level, len(p), level + 1 < len(other.levels), len(q))
            keep = bounded(p, low, high, q, low_q, high_q, x, y)
            x, y = x[keep], y[keep]
        return self.order[x], other.order[y]

    @staticmethod
    def children(x: np.ndarray, y: np.ndarray, level: int, size: int, both: bool, size_y: int) -> tuple[np.ndarray, np.ndarray]:
        width = LEAF if level == 0 else FANOUT
        i, j = (a.ravel() for a in np.meshgrid(np.arange(width), np.arange(width if both else 1), indexing="ij"))
        x = (x[:, None] * width + i).ravel()
        y = (y[:, None] * width + j).ravel() if both else np.repeat(y, width)
        inside = (x < size) & (y < size_y)
        return x[inside], y[inside]


def bounded(p, low, high, q, low_q, high_q, x, y) -> np.ndarray:
    """Which pairs (x, y) of boxes may hold a pair with 9 * overlap >= 4 * (sizes), in steps that bound memory."""
    keep = (5 * high_q[y] >= 4 * low[x]) & (5 * high[x] >= 4 * low_q[y])
    for s in range(0, len(x), 8192):
        e = slice(s, s + 8192)
        k = np.flatnonzero(keep[e]) + s
        overlap = np.minimum(p[x[k]], q[y[k]]).sum(1, dtype=np.int64)
        keep[k] &= 9 * overlap >= 4 * (low[x[k]] + low_q[y[k]])
    return keep


def allowed(x: np.ndarray, y: np.ndarray, sizes: int) -> bool:
    """The bound in GROUPS groups, which is cheap, then in as many as both sets have."""
    folded = np.minimum(*(z.reshape(-1, GROUPS).sum(0) for z in (x, y))).sum()
    return 9 * int(folded) >= 4 * sizes and finer(x, y, sizes)


def finer(x: np.ndarray, y: np.ndarray, sizes: int) -> bool:
    """The bound in as many groups as both sets have; the larger one's counts are folded."""
    if len(x) == len(y) == GROUPS:
        return True
    if len(x) != len(y):
        x, y = (z.reshape(-1, min(len(x), len(y))).sum(0) for z in (x, y))
    return 9 * int(np.minimum(x, y).sum()) >= 4 * sizes


def bucket_pairs(side: np.ndarray, component: np.ndarray, n: np.ndarray, place: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of candidate pairs of one block: within it (all rows have side 0), or between its rows of side 0 and 1."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):
        right = left
    if len(left) * len(right) <= 4 * LEAF:
        i, j = (a.ravel() for a in np.meshgrid(left, right, indexing="ij"))
        keep = bounded(points, n, n, points, n, n, i, j)
        i, j = i[keep], j[keep]
    else:
        tree = RTree(points[left], n[left])
        i, j = tree.pairs(tree if right is left else RTree(points[right], n[right]))
        i, j = left[i], right[j]
    # similar sets share a shingle among the first (size - overlap + 1) of each, for the overlap that 80 % asks of both
    overlap = -(-4 * (n[i] + n[j]) // 9)
    keep = (component[i] != component[j]) & (place[i] <= n[i] - overlap) & (place[j] <= n[j] - overlap)
    if right is left:  # each pair once
        keep &= i < j
    return i[keep], j[keep]


def members(made: DataFrame, mixed: DataFrame) -> DataFrame:
    """(key, node, component, n, place): the nodes in the mixed buckets, and at which place of its prefix a node is there."""
    parts = mixed.select("parts").first()["parts"]
    keys = mixed.select("key")
    few = keys.count() <= BROADCAST_ROWS
    wanted = made.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy()) if few else None)

    def run(batches):
        w = wanted.value
        for b in batches:
            at, key, place = ([np.zeros(0, np.int64)] for _ in range(3))
            for i, raw in enumerate(b.column("prefix").to_pylist()):
                k, first = np.unique(bucket_keys(np.frombuffer(raw, np.uint64), parts).view(np.int64), return_index=True)
                if w is not None:
                    here = w[np.minimum(np.searchsorted(w, k), len(w) - 1)] == k
                    k, first = k[here], first[here]
                at.append(np.full(len(k), i))
                key.append(k)
                place.append(first)
            at = pa.array(np.concatenate(at))
            columns = [pa.array(np.concatenate(key)), *(b.column(c).take(at) for c in ("node", "component", "n")), pa.array(np.concatenate(place))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "component", "n", "place"])

    rows = made.select("prefix", "node", "component", "n").mapInArrow(run, "key long, node long, component long, n long, place long")
    return written((rows if few else rows.join(keys, "key", "left_semi")).distinct(), "members")


def moved(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the components of a later grouping (node, component)."""
    now = groups.select("node", F.col("component").alias("_now"))
    return rows.join(small(now), "node", "left").withColumn("component", F.coalesce("_now", "component")).drop("_now")


def merged(more: DataFrame, rows: DataFrame) -> DataFrame:
    """(component, now): components that the links of a turn join, under a common name. Each takes its least neighbour's, and
    that one's, four steps on. That names no two apart that aren't connected, and leaves some for later: a short cut."""
    of = rows.select("node", "component").distinct()
    end = lambda k, c: of.select(F.col("node").alias(k), F.col("component").alias(c))
    across = more.join(end("a", "x"), "a").join(end("b", "y"), "b").where("x <> y").select("x", "y")
    least = across.union(across.select("y", "x")).groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("component"), F.least("x", "y").alias("now"))
    for _ in range(2):
        on = least.select(F.col("component").alias("now"), F.col("now").alias("then"))
        least = written(least.join(on, "now", "left").select("component", F.coalesce("then", "now").alias("now")), "merged")
    return least.where("component <> now")


def renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(small(names), "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now")


def likely(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) that would join large groups of copies: a bucket's first node, in FIRSTS orders of all nodes that differ
    by turn, with others of its buckets, if they share a third of a prefix. At most FIRSTS pairs for each row, and only a
    short cut: what is left out here is found by candidates()."""
    order = lambda k: F.struct(F.xxhash64("node", F.lit(k + turn * FIRSTS)), "node", "component", "n")
    rows = rows.repartition("key")  # once for both uses: partial minima of FIRSTS structs would be larger than the rows
    first = rows.groupBy("key").agg(F.array_distinct(F.array(*(F.min(order(k)).dropFields("col1") for k in range(FIRSTS)))).alias("f"))
    met = rows.join(first, "key").select("node", "component", "n", F.explode("f").alias("x"))
    met = met.where((F.col("component") != F.col("x.component")) & (5 * F.col("n") >= 4 * F.col("x.n")) & (5 * F.col("x.n") >= 4 * F.col("n")))
    often = met.groupBy(F.col("x.node").alias("x"), "node").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(15 * F.col("c") >= F.col("n"))
    return often.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def candidates(made: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of nodes (a < b) of different components that share a bucket and pass the R-tree's bound."""
    of_key = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    of_key = written(of_key.where("c0 <> c1").select("key", "size"), "buckets")
    rows = rows.join(small(of_key), "key")
    # the smaller of two similar sets meets the other within its first n - ceil(8/9 n) + 1 shingles. In a bucket sorted
    # by size, a node needs such a smaller one, or, being such a one, a larger one; large buckets go to the trees as they are
    rows = rows.withColumn("early", 9 * (F.col("n") - F.col("place")) >= 8 * F.col("n"))
    by_size = Window.partitionBy("key").orderBy("n", "node")
    before, after = by_size.rowsBetween(Window.unboundedPreceding, -1), by_size.rowsBetween(1, Window.unboundedFollowing)
    early = F.when(F.col("early"), F.col("n"))
    smaller = (5 * F.last(early, True).over(before) >= 4 * F.col("n")) | (F.first(early, True).over(after) == F.col("n"))
    larger = F.col("early") & ((5 * F.col("n") >= 4 * F.lead("n").over(by_size)) | (F.lag("n").over(by_size) == F.col("n")))
    near = F.coalesce(smaller, F.lit(False)) | F.coalesce(larger, F.lit(False))
    rows = rows.where(F.col("size") <= CELL).withColumn("near", near).where("near").drop("near").union(rows.where(F.col("size") > CELL))
    rows = written(rows.select("key", "node", "place"), "near")
    # buckets with the same members are one, in which each node has its first place: a shared passage makes many such
    same = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("node").alias("least"), F.max("node").alias("most")
    )
    kept = written(same.withColumn("kept", F.min("key").over(Window.partitionBy("size", "sum", "least", "most"))).select("key", "kept", "size"), "kept")
    rows = rows.join(small(kept), "key").groupBy(F.col("kept").alias("key"), "node").agg(F.min("place").alias("place"), F.max("size").alias("size"))
    rows = rows.withColumn("cells", F.when(F.col("size") > CELL, F.ceil(F.col("size") / CELL).cast("int"))).drop("size")
    own = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    block = lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), F.when(own > other, 1).otherwise(0).alias("side"))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    blocks = F.when(F.col("cells").isNull(), one).otherwise(F.transform(F.sequence(F.lit(0), F.col("cells") - 1), block))
    points = made.select("node", "component", "n", "counts").dropDuplicates(["node"])
    rows = rows.withColumn("block", F.explode(blocks)).select("key", F.col("block.i").alias("i"), F.col("block.j").alias("j"), F.col("block.side").alias("side"), "node", "place").join(points, "node")

    def join(batches):
        held = None
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            if not len(key[0]):
                continue
            new = np.flatnonzero(np.concatenate(([True], *[(np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0)])))
            yield blocks_of(table, new)
            held = table.slice(int(new[-1]))
        if held is not None:
            yield blocks_of(held, np.array([0, len(held)]))

    def blocks_of(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        side, node, component, n, place = (table.column(c).to_numpy() for c in ("side", "node", "component", "n", "place"))
        fine = [np.frombuffer(x, "<u2").astype(np.uint32) for x in table.column("counts").to_pylist()]
        points = np.array([x.reshape(-1, GROUPS).sum(0) for x in fine], np.uint32)
        out_a, out_b = [], []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e - s > 1:
                i, j = bucket_pairs(side[s:e], component[s:e], n[s:e], place[s:e], points[s:e])
                keep = [finer(fine[s + x], fine[s + y], n[s + x] + n[s + y]) for x, y in zip(i.tolist(), j.tolist())]
                i, j = i[keep] + s, j[keep] + s
                out_a.append(np.minimum(node[i], node[j]))
                out_b.append(np.maximum(node[i], node[j]))
        empty = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a or empty)), pa.array(np.concatenate(out_b or empty))], ["a", "b"])

    shuffled = rows.select("key", "i", "j", "side", "node", "component", "n", "place", "counts").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return shuffled.mapInArrow(join, "a long, b long").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    made, shared = with_names(docs)
    full = made.where("n > 0")
    # nodes with an equal minimum hash, against the least of them
    keyed = full.select("node", F.posexplode("keys").alias("k", "key")).distinct()
    leaders = keyed.groupBy("k", "key").agg(F.min("node").alias("a"))
    first = verified(docs, full, keyed.join(leaders, ["k", "key"]).where("node <> a").select("a", F.col("node").alias("b")).distinct(), shared)
    # their own leader's leader, where there is one: part of a component is enough here
    leader = first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("a"))
    above = leader.select(F.col("node").alias("a"), F.col("a").alias("up"))
    groups = written(leader.join(above, "a", "left").select("node", F.coalesce("up", "a").alias("component")), "groups")
    located = moved(full.withColumn("component", F.col("node")), groups)
    links, mixed = first, mixed_buckets(located)
    if not mixed.isEmpty():
        rows, turn = members(located, mixed), 0
        while True:
            pairs = written(likely(rows, turn), "likely")
            more = verified(docs, full, pairs, shared)
            found = more.count()
            if found:
                links, names = links.union(more), merged(more, rows)
                rows = written(renamed(rows, names).select(rows.columns), "members")
            # each turn joins more of a large group; when few pairs are links, what is left are pairs for the trees
            if found * PROGRESS < pairs.count():
                break
            turn += 1
        # whole components once, so that the trees see no pair within one
        if not (links := written(links, "links")).isEmpty():
            groups = written(connected(links), "groups")
            rows, located = written(moved(rows, groups).select(rows.columns), "members"), moved(full.withColumn("component", F.col("node")), groups)
        links = links.union(verified(docs, full, candidates(located, rows), shared, bounded=True))
    links = written(links, "links")
    groups = written(connected(links), "groups") if not links.isEmpty() else None
    # every node's component, and the least id of each
    ids = full.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    if groups is not None:
        ids = ids.join(groups, "node", "left")
        whole = ids.withColumn("component", F.coalesce("component", "node"))
        least = whole.groupBy("component").agg(F.min("id").alias("component_id"))
        named = whole.join(least, "component").select("node", "component_id")
    else:
        named = ids.select("node", F.col("id").alias("component_id"))
    out = made.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns: that whose id is the component's.

    Rows with one id are one document, of which the row with the least text stays. Rows without id stay."""
    ids = written(jaccard_components(docs).where("doc_id is not null").select("doc_id", "component_id"), "components")
    each = ids.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("rows"))
    each = written(each.where(~F.col("first") | (F.col("rows") > 1)), "not-alone")
    left = docs.join(small(written(each.where(~F.col("first")).select("doc_id"), "copies")), "doc_id", "left_anti")
    again = written(each.where("first").select("doc_id"), "repeated")
    if again.isEmpty():
        return left.select(docs.columns)
    order, number = Window.partitionBy("doc_id").orderBy("text"), "_row"
    while number in {c.lower() for c in docs.columns}:  # a name that documents don't have
        number += "_"
    once = left.join(small(again), "doc_id", "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
    return left.join(small(again), "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns))
