"""Tumbling windows over a stream; the relational part has no streams, so this is beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], late: str = "1 hour", **aggregates: Column) -> DataFrame:
    """Aggregates of each window and key, of a stream or of a table. Rows more than ``late`` behind are left out of a stream.

    In the modes ``update`` and ``append`` state is kept for open windows only, so it does not grow with the stream; the mode
    ``complete`` keeps all windows.
    """
    rows = df.withWatermark(time, late) if df.isStreaming else df
    out = rows.groupBy(F.window(time, width).alias("_w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *aggregates)
