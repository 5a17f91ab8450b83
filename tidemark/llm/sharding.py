"""Sharding by extendible hashing, in DataFrame operations only.

Each row's key is a 64-bit hash of its id. The directory is indexed by leading bits of the key. A first pass counts
bytes and rows by the leading FIRST bits; a bucket within the limit stays whole at the fewest bits at which it fits (its
prefix), and a bucket beyond the limit is split on further bits, STEP at a time, with only its own rows, until every
shard fits. Rows with one key (copies of an id) share all bits, so the key's second half is a hash of the row's place
in the table, and such rows split on as others do. A single row larger than the limit is a shard of its own.

All counts are aggregations with partial sums by bucket. The directory, two numbers for each shard, is a table that is
joined, never collected.

Defined results: null text has 0 bytes; rows with null id are sharded as others; every row is in exactly one shard, an
empty table has none. Repeated rows count each. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Largest shard, in bytes of UTF-8 text.
SHARD_BYTES = 8 << 20
FIRST, STEP, BITS = 12, 8, 96


def prefix(bits: int | None = None, column: str = "depth"):
    """The leading bits of the row's 96-bit key as text of 0 and 1."""
    return F.substring("key", 1, bits) if bits is not None else F.expr(f"substring(key, 1, {column})")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its bytes and its key: 64 bits of the id's hash, then 32 bits of the row's place."""
    bits = lambda h, n: F.lpad(F.right(F.conv(F.hex(h), 16, 2), F.lit(n)), n, "0")
    place = F.monotonically_increasing_id()
    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.concat(bits(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 64), bits(F.hash(place, F.lit(1)), 32)).alias("key"),
    )


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """shard (a prefix), its bytes and rows: the shards that hold all rows."""
    done, low, high, open_ = None, 0, FIRST, rows
    while True:
        cells = written(open_.groupBy(F.substring("key", 1, high).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")), "cells")
        # at each depth from low to high: does the bucket that the cell lies in fit?
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("shard", F.expr("substring(cell, 1, depth)"))
        sizes = levels.groupBy("depth", "shard").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"), F.max("cell").alias("cell"))
        fits = (F.col("n_bytes") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") >= BITS)
        whole = sizes.where(fits)
        # a bucket that fits is a shard unless its parent fits too
        parent = whole.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("up"))
        shards = (
            whole.withColumn("up", F.expr("substring(shard, 1, depth - 1)")).join(parent, ["depth", "up"], "left_anti").select("shard", "depth", "n_bytes", "n_rows")
        )
        shards = written(shards, "shards")
        done = shards if done is None else done.unionByName(shards)
        split = written(sizes.where((F.col("depth") == high) & ~fits).select(F.col("shard").alias("cell")), "oversized")
        if high >= BITS or split.isEmpty():
            return done
        open_ = open_.join(split, F.substring("key", 1, high) == F.col("cell"), "left_semi")
        low, high = high + 1, min(BITS, high + STEP)


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard, and its shard's bits, bytes and rows."""
    rows = written(keyed(docs), "keys")
    found = written(directory(rows, limit), "directory")
    # a row looks its prefixes up at the depths that occur, at most BITS of them
    depths = [r["depth"] for r in found.select("depth").distinct().orderBy("depth").collect()]
    looked = F.array(*(F.struct(F.lit(d).alias("depth"), F.substring("key", 1, d).alias("shard")) for d in depths)) if depths else F.expr("array(named_struct('depth', 0, 'shard', ''))")
    # by cell of the key: the one shard that covers it, if the cell is not finer than the shard
    return (
        rows.withColumn("try", F.explode(looked)).select("doc_id", "n_bytes", F.col("try.depth").alias("depth"), F.col("try.shard").alias("shard"))
        .join(found.select("shard", "depth", F.col("n_bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows")), ["depth", "shard"])
        .select("doc_id", "n_bytes", "shard", F.col("depth").alias("shard_bits"), "shard_bytes", "shard_rows")
    )
