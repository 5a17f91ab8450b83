"""Extension: assessments that follow stages as they arrive.

Stage ids of a snapshot are finite, so no watermark is needed: each micro-batch appends its stages to the
evidence and assesses the snapshots it touched over all their evidence. A replayed micro-batch has its old number, which the
checkpoint keeps, so it overwrites its own rows. A `StageProgress` listener gets each micro-batch's counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.assessment import assess
from .progress import watched


def follow(stages: DataFrame, findings: DataFrame, evidence: str, results: str, checkpoint: str) -> StreamingQuery:
    """stages: a stream; findings: the table of findings; assessments are appended to results with their batch number."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{evidence}/batch={number}")
        spark = findings.sparkSession  # a batch has a session of its own
        known = spark.read.parquet(evidence)
        touched = known.where(f"batch = {number}").select("snapshot_id").distinct()
        known = known.drop("batch")
        now = assess(known.join(touched, "snapshot_id", "left_semi"), findings.join(touched, "snapshot_id", "left_semi"))
        now.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return watched(stages).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
