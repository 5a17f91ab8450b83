"""Changed lines of patches as intervals of each side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def changed_lines(patches: DataFrame) -> DataFrame:
    """(snapshot_id, side, path, start_line, end_line) of patches without context (snapshot_id, patch).

    A hunk's header says how many lines follow, so that a removed or added line which looks like a file's header isn't
    taken for one. A side without lines has no interval. A null patch (too large, or not available) gives one row for each
    side with a null path: the map is unknown, which isn't an empty map. A patch has a bounded size, so its lines are one
    group."""
    lines = patches.where("patch is not null").select("snapshot_id", F.posexplode(F.split("patch", "\n")).alias("pos", "text"))
    number = lambda i: F.when(F.regexp_extract("text", _HUNK, i) == "", F.lit(1)).otherwise(F.regexp_extract("text", _HUNK, i)).try_cast("long")
    lines = lines.withColumn("hunk", F.when(F.col("text").rlike(_HUNK), F.struct(number(1).alias("base"), number(2).alias("base_n"), number(3).alias("head"), number(4).alias("head_n"))))
    before = Window.partitionBy("snapshot_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("covered", F.coalesce(F.max(F.col("pos") + F.col("hunk.base_n") + F.col("hunk.head_n")).over(before), F.lit(-1)))
    outside = F.col("pos") > F.col("covered")
    for side, mark, folder in (("base", "--- ", "a/"), ("head", "+++ ", "b/")):
        name = F.regexp_replace(F.regexp_replace("text", "^.{4}\"?", ""), "\"?\\t?$", "")
        named = F.when(outside & F.startswith("text", F.lit(mark)), F.when(F.startswith(name, F.lit(folder)), F.substring(name, 3, 1 << 20)).otherwise(""))
        lines = lines.withColumn(f"{side}_path", F.last(named, True).over(before))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_path").alias("path"), F.col(f"hunk.{s}").alias("start"), F.col(f"hunk.{s}_n").alias("n")) for s in ("base", "head")))
    found = lines.where(F.col("hunk").isNotNull() & outside).select("snapshot_id", F.explode(sides).alias("s")).where("s.n > 0 and s.path <> ''")
    found = found.select("snapshot_id", "s.side", "s.path", F.col("s.start").alias("start_line"), (F.col("s.start") + F.col("s.n") - 1).alias("end_line"))
    unknown = patches.where("patch is null").select("snapshot_id", F.explode(F.array(F.lit("base"), F.lit("head"))).alias("side"))
    return found.unionByName(unknown, allowMissingColumns=True)
