"""Sequences: gapless numbers for the rows of a frame, and a counter for single calls."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Sequence:
    """``start``, ``start + step``, ... for single calls on the driver, and for whole frames.

    ``low`` and ``high`` bound the values; beyond them a sequence that cycles begins again at its other end, and any other raises
    an error.
    """

    def __init__(self, start: int = 1, step: int = 1, low: int | None = None, high: int | None = None, cycle: bool = False) -> None:
        self.start, self.step, self.low, self.high, self.cycle = start, step, low, high, cycle
        self._last: int | None = None

    def _next(self) -> int:
        return self.start if self._last is None else self._last + self.step

    def _outside(self, value: int) -> bool:
        return (self.high is not None and value > self.high) or (self.low is not None and value < self.low)

    def nextval(self) -> int:
        value = self._next()
        if self._outside(value):
            end = self.low if self.step > 0 else self.high
            if not self.cycle or end is None:
                raise ValueError("the sequence is exhausted")
            value = end
        self._last = value
        return value

    def currval(self) -> int:
        if self._last is None:
            raise ValueError("nextval() was not called yet")
        return self._last

    def number(self, df: DataFrame, order: Column | str, into: str) -> DataFrame:
        """Give every row the next value, in order. Only partition counts meet; rows are range-partitioned, never in one task.

        ``df`` must give the same rows when it is read again, as a stored table does. Bounds are not passed over: an error.
        """
        first = self._next()
        rows = df.repartitionByRange(F.col(order) if isinstance(order, str) else order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
        rows = rows.persist(StorageLevel.DISK_ONLY)  # the ranges' bounds are sampled, and must be the same for both reads
        rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
        sizes = [(r["_part"], r["_size"]) for r in rows.groupBy("_part").agg(F.count("*").alias("_size")).orderBy("_part").collect()]  # a row for each partition
        before, total = [], 0
        for part, n in sizes:
            before.append((part, total))
            total += n
        if not total:
            return df.withColumn(into, F.lit(None).cast("long"))
        last = first + (total - 1) * self.step
        if self._outside(first) or self._outside(last):
            raise ValueError("the sequence is exhausted")
        out = rows.join(F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _before long")), "_part")
        self._last = last
        return out.withColumn(into, F.lit(first) + (F.col("_before") + F.col("_in") - 1) * self.step).drop("_part", "_in", "_before")
