"""Quantified comparisons, and rows for empty input, as joins and aggregates of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEGATED = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def with_quantified(df: DataFrame, value: str, op: str, quantifier: str, other: DataFrame, into: str) -> DataFrame:
    """Add ``value op ANY/ALL (other)`` in three-valued logic; ``other`` has one column, and may be empty or hold NULLs.

    ALL is not ANY of the negated comparison. An order comparison needs only the set's least or greatest value, so the other
    side is one row, whatever its size. Equality with any of the values is a join with the distinct values.
    """
    column, own = other.columns[0], F.col(value)
    facts = other.agg(F.min(column).alias("_low"), F.max(column).alias("_high"), F.count("*").alias("_n"), F.count(column).alias("_known"))
    out = df.crossJoin(F.broadcast(facts))  # one row
    all_ = quantifier.upper() == "ALL"
    if all_:
        op = NEGATED[op]
    if op == "=":
        values = other.select(F.col(column).alias("_match")).where("_match is not null").distinct()
        out = out.join(values, own == F.col("_match"), "left")
        hit = F.col("_match").isNotNull()
    elif op == "<>":
        hit = (F.col("_low") != F.col("_high")) | (own != F.col("_low"))
    else:
        hit = {"<": own < F.col("_high"), "<=": own <= F.col("_high"), ">": own > F.col("_low"), ">=": own >= F.col("_low")}[op]
    unknown = F.lit(None).cast("boolean")
    any_ = F.when(F.col("_n") == 0, False).when(own.isNull(), unknown).when(hit, True).when(F.col("_n") > F.col("_known"), unknown).otherwise(False)
    return out.withColumn(into, ~any_ if all_ else any_).select(*df.columns, into)


def if_empty(df: DataFrame, **values: Column) -> DataFrame:
    """The rows, or one row of the given values if there are none."""
    kinds = dict(df.dtypes)
    one = df.sparkSession.range(1).select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(f"_else_{c}") for c in df.columns])
    rows = df.withColumn("_there", F.lit(True))
    out = one.join(rows, F.lit(True), "left")
    return out.select(*[F.when(F.col("_there"), F.col(c)).otherwise(F.col(f"_else_{c}")).alias(c) for c in df.columns])
