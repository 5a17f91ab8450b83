"""A relation is Spark SQL over named inputs; inputs are tables or other relations.

Spark runs it as a view over DataFrames, so that Catalyst sees one logical plan through all relations below. The check
statement lists the relations below as common table expressions and spells the few functions whose names differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Every relation by name.
RELATIONS: dict[str, Relation] = {}

#: Bits of a filter that is broadcast, at most (64 MB); about four for each row below that.
SLOTS = 1 << 29

#: Functions that the two engines name differently.
NAMES = {
    "bround(": "round_even(", "regexp_like(": "regexp_matches(", "collect_list(": "list(", "collect_set(": "list(distinct ",
    "array_join(": "array_to_string(", "array_sort(": "list_sort(", "startswith(": "starts_with(", "endswith(": "ends_with(", "octet_length(": "strlen(",
    "array_distinct(": "list_distinct(", "array_size(": "len(",
}


@dataclass(frozen=True)
class Relation:
    name: str
    sql: str
    inputs: tuple[str, ...] = field(default=())
    #: The check's own wording, where functions differ by more than their names; None: derived; "": not expressible.
    check: str | None = None
    #: Rows of its inputs for each of the {parts} that its statement deals them into ({slots}: of its filter); 0: it names no number.
    rows_each: int = 0
    #: What its statement asks of its inputs as {name}: whether any of their rows meets a condition.
    asks: dict[str, str] = field(default_factory=dict)

    def over(self, **inputs: DataFrame) -> DataFrame:
        """The relation over the caller's DataFrames. Where rows are dealt, they are counted first, and asked what the
        statement asks of them: the parts grow in number, not in size."""
        spark = next(iter(inputs.values())).sparkSession
        given = {k: inputs[k] for k in self.inputs}
        if self.rows_each:
            seen = [df.selectExpr("count(*) as n", *(f"coalesce(bool_or({x}), false) as {k}" for k, x in self.asks.items())).first() for df in given.values()]
            told = {k: any(r[k] for r in seen) for k in self.asks}
            rows = sum(r["n"] for r in seen)
            numbers = {"parts": max(spark.sparkContext.defaultParallelism, -(-rows // self.rows_each)), "slots": min(SLOTS, max(1 << 16, 1 << (4 * rows).bit_length()))}
            return spark.sql(self.sql, **given, **told, **{k: v for k, v in numbers.items() if f"{{{k}}}" in self.sql})
        return spark.sql(self.sql, **given)

    def frame(self, spark: SparkSession, sf_dir: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
        """The relation over the tables of a folder; each relation below is made once."""
        made = {} if made is None else made
        for name in self.inputs:
            if name not in made:
                made[name] = RELATIONS[name].frame(spark, sf_dir, made) if name in RELATIONS else spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return self.over(**made) if self.inputs else spark.sql(self.sql.format())

    def below(self) -> list[str]:
        """Names of the relations it needs, in an order of definition."""
        out: list[str] = []
        for name in self.inputs:
            if name in RELATIONS:
                out.extend(x for x in (*RELATIONS[name].below(), name) if x not in out)
        return out

    def own_check(self) -> str:
        text = self.sql if self.check is None else self.check
        for spark_name, check_name in NAMES.items():
            text = text.replace(spark_name, check_name)
        text = re.sub(r"(?<![a-z])char\(", "chr(", text)
        text = re.sub(r"sha2\((.*?), 256\)", r"sha256(\1)", text, flags=re.S)
        text = re.sub(r"(?<![A-Za-z0-9_])r'", "'", text)
        return text.format(**{k: k for k in self.inputs})

    def statement(self) -> str | None:
        if self.check == "" or any(RELATIONS[x].check == "" for x in self.below()):
            return None
        parts = [f"{x} AS ({RELATIONS[x].own_check()})" for x in self.below()]
        return (f"WITH {', '.join(parts)} " if parts else "") + f"SELECT * FROM ({self.own_check()}) AS result"


def relation(name: str, sql: str, *inputs: str, check: str | None = None, rows_each: int = 0, asks: dict[str, str] | None = None) -> Relation:
    RELATIONS[name] = made = Relation(name, sql.strip(), inputs, check, rows_each, asks or {})
    return made
