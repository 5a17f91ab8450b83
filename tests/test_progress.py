"""Counts of stages that come out of a running plan."""

import time

from tidemark import schema
from tidemark.streaming import progress


def stages(spark, statuses):
    rows = [("s", f"st{k}", "lint", s, k % 2 == 0, "t", "1", "", "all", 1, 1, 0.0, *[None] * 8) for k, s in enumerate(statuses)]
    return spark.createDataFrame(rows, schema.STAGES)


def test_a_batch_query_tells_its_counts(spark):
    df, seen = progress.observed(stages(spark, ["ok", "ok", "limited", "odd", None, "missing"]))
    assert df.where("status = 'ok'").count() == 2  # a filter above doesn't change what has passed
    assert {k: v for k, v in seen.get.items() if v} == {"stages": 6, "required": 3, "ok": 2, "limited": 1, "missing": 1, "other": 2}
    assert progress.line(seen.get, "head\x1b[2J") == "head?[2J: 6 stages, 3 required (2 ok, 1 limited, 1 missing, 2 other)"
    empty, none = progress.observed(stages(spark, []))
    empty.collect()
    assert progress.line(none.get) == "0 stages, 0 required"


def test_a_stream_tells_each_micro_batch(spark, tmp_path):
    told = []
    listener = progress.StageProgress(told.append, "base")
    spark.streams.addListener(listener)
    try:
        for k, statuses in enumerate((["ok"], ["failed", "ok", "ok"])):
            stages(spark, statuses).write.mode("append").parquet(str(tmp_path / "in"))
            stream = progress.watched(spark.readStream.schema(schema.STAGES).parquet(str(tmp_path / "in")))
            stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(60)
            for _ in range(100):
                if len(told) > k:
                    break
                time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told == ["base: 1 stages, 1 required (1 ok)", "base: 3 stages, 2 required (2 ok, 1 failed)"]
