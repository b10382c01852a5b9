"""A bounded sample of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, text and label: at most ``most`` of the labelled documents, those whose ids hash lowest.

    ``learn`` tells from the label table's key which rows may be learned from. A document with several labels counts by the
    largest, an id with several texts by one of them. Rows without id, label or text are left out.
    """
    chosen = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most).withColumnRenamed(key, "_k")
    rows = docs.select(F.col(key), F.col(text).alias("_t")).where(F.col("_t").isNotNull()).join(F.broadcast(chosen), F.col(key) == F.col("_k"))  # most rows
    return rows.groupBy(F.col("_k").alias("key")).agg(F.min("_t").alias("text"), F.first("_y").alias("y"))
