"""K-6: how many stages have come, and with what status, while a plan runs.

The counts are Spark's observed metrics: they are taken as rows pass, cost no pass of their own, and come out when the batch
query or the micro-batch that they passed in ends. `observed()` is for a batch query; `StageProgress` listens to streams and
hands a line for each micro-batch to a caller's function, by default to standard error, so that results stay apart.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "tidemark_stages"
# What a stage can have come to.
STATUSES = ("ok", "limited", "failed", "missing", "timeout", "unsupported")
MOST_SHOWN = 160


def _counts() -> list:
    known = F.col("status").isin(*STATUSES)
    return [F.count("*").alias("stages"), F.count_if(F.col("required")).alias("required"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count_if(~F.coalesce(known, F.lit(False))).alias("other")]


def observed(stages: DataFrame) -> tuple[DataFrame, Observation]:
    """stages, and what is observed of them: `get` gives the counts once an action over the result has ended."""
    observation = Observation(NAME)
    return stages.observe(observation, *_counts()), observation


def watched(stages: DataFrame) -> DataFrame:
    """A stream of stages whose counts a StageProgress receives."""
    return stages.observe(NAME, *_counts())


def line(counts: dict, side: str = "") -> str:
    """The counts in words, those that are zero left out; control characters of the side's name are shown as question marks."""
    said = ", ".join(f"{counts[s]} {s}" for s in (*STATUSES, "other") if counts.get(s))
    name = "".join(c if c.isprintable() else "?" for c in side)[:MOST_SHOWN]
    return f"{name + ': ' if name else ''}{counts.get('stages', 0)} stages, {counts.get('required', 0)} required" + (f" ({said})" if said else "")


class StageProgress(StreamingQueryListener):
    """Register with spark.streams.addListener; `tell` is called in the driver for each micro-batch that had stages."""

    def __init__(self, tell: Callable[[str], None] | None = None, side: str = ""):
        self.tell, self.side = tell or (lambda text: print(text, file=sys.stderr, flush=True)), side

    def onQueryStarted(self, event) -> None:
        """Nothing has come yet."""

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None and row["stages"]:
            self.tell(line(row.asDict(), self.side))

    def onQueryTerminated(self, event) -> None:
        """What came has been told."""
