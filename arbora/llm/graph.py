"""Connected components of a large graph by alternating large and small stars.

Each round is two joins on aggregated minima; the edge list never grows, and neither edges nor components reach the
driver. Rounds are written to the shared folder, so a lost executor costs a task and not the iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, scratch, stored


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(u, v)``; the root is the smallest node that can be reached.

    Loops, repeated edges and either direction are allowed; null ends are dropped. Without edges the result is empty. Minima
    are stored before they are joined, so that adaptive execution can split the edges of a hub.
    """
    spark = edges.sparkSession
    down = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    with scratch(spark):
        now = stored(down(edges), "edges")
        seen = _checksum(now)
        while seen[0]:
            with scratch(spark):
                both = now.union(now.select("v", "u"))
                least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
                large = stored(down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
                least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
                small = large.join(least, "u")
                now = stored(down(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))), "edges")
            last, seen = seen, _checksum(now)
            if seen == last:
                break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


class Forest:
    """Union-find over the items of one task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """True if the two were apart."""
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


by_value(__name__)
