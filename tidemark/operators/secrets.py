"""Secret scan with a rule catalog given as a file: keyword prefilter, regular expression, entropy, allow lists.

The catalog (TOML: rules with id, regex, keywords, entropy, path, secretGroup, allowlists) is a parameter; its rules are
a small table that is broadcast. Lines meet only rules of which they hold a keyword. Matches never leave the scan: the
result has the rule and the place.
"""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "rule string, regex string, keywords array<string>, entropy double, path string, secret_group int, allowed string, stopwords array<string>"


def java_regex(pattern: str) -> str:
    """POSIX classes of RE2 in Java's spelling; the rest is common to both."""
    return re.sub(r"\[:(\w)(\w+):\]", lambda m: f"\\p{{{m[1].upper()}{m[2]}}}", pattern)


def rules(spark: SparkSession, catalog: str) -> DataFrame:
    """The catalog's rules, with the allow lists that hold for all of them."""
    data = tomllib.loads(Path(catalog).read_text())
    common = data.get("allowlist", {})
    rows = []
    for r in data.get("rules", []):
        if "regex" not in r:
            continue
        lists = [common, *r.get("allowlists", [])]
        allowed = [x for a in lists for x in a.get("regexes", [])]
        words = [w.lower() for a in lists for w in a.get("stopwords", [])]
        rows.append((
            "secret." + r["id"], java_regex(r["regex"]), [k.lower() for k in r.get("keywords", [])], r.get("entropy"), r.get("path"), r.get("secretGroup", 0),
            "|".join(f"(?:{java_regex(x)})" for x in allowed) or None, words,
        ))
    return spark.createDataFrame(rows, RULES)


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def scan(texts: DataFrame, catalog: DataFrame, severity: str = "high") -> DataFrame:
    """relative_path, line, rule and severity of every match in texts (relative_path, content)."""
    lines = texts.select("relative_path", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("at", "text"))
    lower = F.lower("text")
    words = catalog.withColumn("keyword", F.explode_outer(F.when(F.size("keywords") > 0, F.col("keywords"))))
    met = lines.join(F.broadcast(words), F.col("keyword").isNull() | F.contains(lower, F.col("keyword")))
    met = met.where(F.col("path").isNull() | F.regexp_like("relative_path", F.col("path"))).dropDuplicates(["relative_path", "at", "rule"])
    found = met.where(F.regexp_like("text", F.col("regex"))).withColumn("all", F.regexp_extract_all("text", F.col("regex"), F.col("secret_group")))
    found = found.withColumn("secret", F.explode("all")).where(F.col("secret") != "")
    found = found.where(F.col("entropy").isNull() | (entropy(F.col("secret")) >= F.col("entropy")))
    found = found.where(~F.coalesce(F.regexp_like("secret", F.col("allowed")), F.lit(False)) & ~F.exists("stopwords", lambda w: F.contains(F.lower("secret"), w)))
    return found.select("relative_path", (F.col("at") + 1).alias("line"), "rule", F.lit(severity).alias("severity")).distinct()
