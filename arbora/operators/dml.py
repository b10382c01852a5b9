"""INSERT, UPDATE and DELETE that return rows: copies of a table, as Spark's frames do not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new table, and the rows that were inserted."""
    rows = rows.toDF(*table.columns).select(*[F.col(c).cast(t) for c, t in table.dtypes])  # by position
    return table.union(rows), rows


def update(table: DataFrame, where: Column, **values: Column) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(where, F.lit(False))
    new = table.select(hit.alias("_hit"), *[F.when(hit, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in table.dtypes])
    return new.drop("_hit"), new.where("_hit").drop("_hit")


def delete(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """What is left, and the rows that were deleted. An unknown condition deletes nothing."""
    hit = F.coalesce(where, F.lit(False))
    return table.where(~hit), table.where(hit)
