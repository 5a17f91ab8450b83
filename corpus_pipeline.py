"""A corpus pipeline: toxicity, quality, near copies, personal data and packing, each over what the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever other columns these have beside doc_id and text.

Defined results of every stage: null text counts as empty; rows whose id is null or repeats stay rows of their own, except
that near copies keep an id once; very long texts are taken whole; equal texts share one decision; an empty table stays
empty. What a stage rejects or changes on equal scores follows from the score alone, and of near copies the least id
stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, packing, pii, quality, toxicity
from tidemark.llm.common import documents, small_batches, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.5 or more. A null or empty text has the score of texts without terms."""
    small_batches(spark)
    return toxicity.filtered(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is under the classifier's threshold; a null or empty text gets the curve's score."""
    small_batches(spark)
    return quality.filtered(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the component's id, once (of its rows, the one with the least text).
    Rows without id, and texts without words, stay."""
    small_batches(spark)
    return jaccard.representatives(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, in text, and sets n_chars of changed texts; keeps every document."""
    small_batches(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1024 tokens: one row for each piece. An empty text is the id 0."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages fit models, which SQL can't express.
ORACLE_SQL = None
