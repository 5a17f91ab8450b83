"""The prefix trie of conversations by partition refinement.

All conversations begin as one class. In a round, each active class is split by its members' next turn, where the turns
of all members are equal for a while, this run is taken at once; a class of one member retires, as its tail is a chain
without branches. A class without another split is a chain as well. So the rounds follow the branches on the deepest
path, not the number of turns. Every node lies in one class: its smallest member, number of members and last text come
from the class's rows at its depth. Folding back goes from the last round to the first: a class hands leaves and savings
to the class it was split from, and inside a class a running sum from its end gives every node its subtree.

Turns are compared by the SHA-256 of role and text and carry their number of words; texts are read once. Positions come
from a range partitioning by conversation and turn with counts of earlier partitions, so a conversation may hold any
share of all rows. Splits, runs and folds are groupings with partial sums; the list of ids under a node's hash is
streamed in order of ids, joined before by blocks of BLOCK ids, so its memory doesn't grow with a group of copies.

Defined results: null role and text are empty. Turns of one conversation go by turn, null first; equal turns by role, the
text's first 64 characters, and its hash; repeated rows are turns of their own. Rows without conv_id belong to no conversation. Very long texts count
whole. Remainders of negative ids are negative, as in SQL. Other columns are not read, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: How many consecutive ids are joined to one piece of a node's list; a power of two.
BLOCK = 4096
#: Members of one family of conversations, and the remainders that say how many turns are taken from its first.
FAMILY, TAKEN = 20, 4
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and n_words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))).cast("long").alias("n_words"), role.alias("role"), F.substring(text, 1, 64).alias("head"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("digest")]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "head", "turn").withColumn("uid", F.monotonically_increasing_id()), "turns").withColumn("part", F.shiftright("uid", 33))
    first = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("uid").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    first = first.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(first, ["conv_id", "part"]).select("conv_id", (F.col("uid") - F.col("first") + F.col("before")).alias("pos"), "digest", "n_words")


def rebuilt(original: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation begins as the first one of its family does, for so many turns as its id says, and goes on with
    its own turns after as many. Gives conv_id, pos (from 1), digest, n_words of its turns, and all ids with their length."""
    ids = original.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), (F.crc32(F.col("conv_id").cast("string")) % TAKEN).alias("h"))
    begin = original.where((F.col("pos") < TAKEN - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "family")
    ids = ids.join(begin.groupBy("family").agg(F.count("*").alias("there")), "family", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    ids = written(ids.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    taken = ids.where("taken > 0").join(begin, "family").where(F.col("pos") < F.col("taken")).select("conv_id", (F.col("pos") + 1).alias("pos"), "digest", "n_words")
    kept = original.join(ids.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("pos"), "digest", "n_words")
    return written(taken.unionByName(kept), "rebuilt"), ids.select("conv_id", "length")


def listed(ends: DataFrame, key: list[str]) -> DataFrame:
    """key and the SHA-256 of its conv_ids in ascending order, comma-joined. Ids are distinct within a key."""
    block = F.shiftright("conv_id", BLOCK.bit_length() - 1)
    pieces = ends.groupBy(*key, block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))  # at most BLOCK ids
    own = ", ".join(f"{k} long" for k in key)

    def run(batches):
        now, state = None, None
        for b in batches:
            out = []
            columns = [c.to_pylist() for c in b.columns]
            for *node, ids in zip(*columns[: len(key)], columns[-1]):
                if node != now:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield table(out)
        if state:
            yield table([(*now, state.hexdigest())])

    def table(out):
        columns = list(zip(*out)) if out else [()] * (len(key) + 1)
        kinds = [pa.int64()] * len(key) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*key, "ends_sha256"])

    return pieces.repartition(*key).sortWithinPartitions(*key, "block").mapInArrow(run, f"{own}, ends_sha256 string")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def prefix_trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie's nodes over turns (conv_id, pos from 1, digest, n_words) of conversations (conv_id, length)."""
    spark, key = ids.sparkSession, ["cls", "top"]  # a class: its smallest member when it was split off, and the depth of its first node
    whole = ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if not whole["n"]:
        return spark.createDataFrame([], NODES)
    root = spark.createDataFrame([(whole["least"], 0, None, None, whole["n"], 0)], "cls long, top long, up long, up_top long, n long, n_words long")
    members = [ids.where(F.lit(whole["n"] > 1)).select("conv_id", F.lit(whole["least"]).cast("long").alias("cls"), F.lit(0).cast("long").alias("top"))]
    runs, classes = [], [root]
    while True:
        ahead = rows.join(members[-1], "conv_id").where(F.col("pos") > F.col("top"))
        runs.append(written(ahead.groupBy(*key, "pos").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("n_words").alias("n_words"), (F.min("digest") != F.max("digest")).alias("differ")
        ), "runs"))
        cut = runs[-1].where("differ").groupBy(*key).agg(F.min("pos").alias("cut"))
        # where a class's members differ for the first time they are split by their turn
        split = ahead.join(cut, key).where(F.col("pos") == F.col("cut"))
        new = written(split.groupBy(*key, "cut", "digest").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("n_words").alias("n_words")), "classes")
        grown = new.where("n > 1").select(*key, "digest", F.col("least").alias("to"))
        if not new.head(1):
            break
        classes.append(new.select(F.col("least").alias("cls"), F.col("cut").alias("top"), F.col("cls").alias("up"), F.col("top").alias("up_top"), "n", "n_words"))
        members.append(written(split.join(grown, [*key, "digest"]).select("conv_id", F.col("to").alias("cls"), F.col("cut").alias("top")), "members"))
    every, run = together(classes), together(runs)
    cut = run.where("differ").groupBy(*key).agg(F.min("pos").alias("cut"))
    inside = lambda at: F.col("cut").isNull() | (F.col(at) < F.col("cut"))
    # a class's chain: its first node, and those of the run before its members differ
    first = every.where("n > 1").select(*key, F.col("top").alias("pos"), "n", F.col("cls").alias("least"), "n_words")
    chain = written(first.unionByName(run.join(cut, key, "left").where(inside("pos")).select(*key, "pos", "n", "least", "n_words")), "chains")
    last = written(chain.groupBy(*key).agg(F.max_by("least", "pos").alias("up_least"), F.sum((F.col("n") - 1) * F.col("n_words")).alias("chain_saved"), F.max("pos").alias("bottom")), "ends")
    # back from the last round: what the classes split off from a class hold
    below = spark.createDataFrame([], "cls long, top long, branches long, leaves long, saved long")
    held = []
    for own in reversed(classes):
        own = own.join(last, key, "left").join(below, key, "left")
        own = written(own.select(
            *key, "up", "up_top", "n", "bottom", F.coalesce("branches", F.lit(0)).alias("branches"), F.coalesce("leaves", F.lit(1)).alias("leaves"),
            F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("chain_saved", F.lit(0)).alias("chain_saved"),
        ), "folded")
        held.append(own)
        below = own.where("up IS NOT NULL").groupBy(F.col("up").alias("cls"), F.col("up_top").alias("top")).agg(
            F.count("*").alias("branches"), F.sum("leaves").alias("leaves"), F.sum(F.col("saved") + F.col("chain_saved")).alias("saved")
        )
    over = last.select(F.col("cls").alias("up"), F.col("top").alias("up_top"), F.col("up_least").alias("parent"))
    held = written(together(held).join(over, ["up", "up_top"], "left").drop("up", "up_top"), "folded")
    upward = Window.partitionBy(*key).orderBy(F.desc("pos"))
    at_top = F.col("pos") == F.col("top")
    of_chains = chain.join(held.drop("n"), key).select(
        *key, "pos", F.col("least").alias("conv_id"), F.when(at_top, F.col("parent")).otherwise(F.lead("least").over(upward)).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("pos") < F.col("bottom"), 1).otherwise(F.col("branches")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.sum((F.col("n") - 1) * F.col("n_words")).over(upward)).alias("saved_tokens"),
    )
    # classes of one member: their tails are chains, which save nothing
    single = held.where("n = 1").select(*key, "parent").join(ids.withColumnRenamed("conv_id", "cls"), "cls")
    one = F.lit(1).cast("long")
    of_singles = single.join(rows.withColumnRenamed("conv_id", "cls").select("cls", "pos"), "cls").where(F.col("pos") >= F.col("top"))
    of_singles = of_singles.unionByName(single.where("top = 0").withColumn("pos", F.lit(0).cast("long"))).select(  # the root has no turn
        *key, "pos", F.col("cls").alias("conv_id"), F.when(at_top, F.col("parent")).otherwise(F.col("cls")).alias("parent_conv_id"), one.alias("n_convs"),
        (F.col("pos") < F.col("length")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
    )
    ends = together(members).join(ids, "conv_id").join(cut, key, "left").where(inside("length")).select(*key, F.col("length").alias("pos"), "conv_id")
    ends = ends.unionByName(single.select(*key, F.col("length").alias("pos"), F.col("cls").alias("conv_id")))
    place = [*key, "pos"]
    ended = F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")
    return of_chains.unionByName(of_singles).join(listed(ends, place), place, "left").select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ended)


def conversation_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations."""
    return prefix_trie(*rebuilt(turns(conversations)))
