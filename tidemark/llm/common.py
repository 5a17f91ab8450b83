"""What the training-data operators share: the shared folder, written tables, documents and label samples."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch. A batch must fit a Python worker beside its temporary arrays.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets
    a new folder of this machine; on a cluster each executor would write to its own disk, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_tidemark_shared", None) or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark._tidemark_shared = folder
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back. This cuts the lineage: a lost executor costs no recomputation
    of what stands before, and nothing depends on one executor's disk."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts vary from empty to very long, so Arrow batches of them have few rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def fold(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def slices(docs: DataFrame, bytes_each: int, at_least: int = 8) -> int:
    """A number of partitions that follows the size of the text: about so many bytes in each."""
    total = docs.select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return int(max(at_least, -(-total // bytes_each)))


def label_sample(labels: DataFrame, label: str, modulus: int, left_out: int, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Labelled training ids: at most per_class of each class, those with the smallest hash of their id; and for each
    class how many labelled rows one sampled row stands for. Rows without id or label are left out. If an id has several
    labels, the larger holds. The bound is the documented one for fitting a classifier."""
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(modulus) != left_out))
        .groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    )
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), {y: count.get(y, 0) / max(1, min(per_class, count.get(y, 0))) for y in (0, 1)}


def sampled_texts(docs: DataFrame, sample: DataFrame, most_bytes: int) -> DataFrame:
    """The texts of a bounded sample of ids (doc_id, label, text), one row for each id; the ids are few, so they are
    broadcast. Of an id's rows the largest text counts. In the order of the ids' hash, texts that still fit most_bytes
    are taken whole; the bound is the documented one for fitting a classifier."""
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
    )
    rows = written(rows.repartition(8, "doc_id"), "sample")
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # as many as the sample
    left, out = most_bytes, []
    for r in sizes:
        if r["n"] > left:
            out.append(r["doc_id"])
        else:
            left -= r["n"]
    return rows.where(~F.col("doc_id").isin(out)) if out else rows
