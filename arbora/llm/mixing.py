"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight, up to ``most`` times its own words. What a clamped source cannot
take is shared again among the others by weight, until none is above its cap; the level at which that ends is found in
one pass over the sources ordered by cap over weight. A source's target is met by whole repetitions of all its
documents, and by one more of those that come first in a seeded order. Only DataFrame and SQL functions run here.

Defined cases: a null text or one without words has 0 words, and so takes 0; a null source is a source of its own, last
in order; rows with equal ids stand side by side in the seeded order, the smaller first; without any words all targets
are 0; an empty table gives no rows. :func:`mix` does not look at columns beside key, text and source; :func:`apply_mix`
carries them, whatever their names but those that start with ``mix_``. The sources, a row each, are ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running, stored


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Target words of every source of ``(source, source_size)``; one row each, as many as there are sources."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    ordered = sizes.withColumn("source_no", F.row_number().over(rank) - 1)
    ordered = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    ordered = ordered.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share))
    ordered = ordered.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    ordered = ordered.withColumn("water", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy(F.lit(0))))
    return ordered.withColumn("target", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight"))))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "", size: Column | None = None
) -> DataFrame:
    """Key, source, size, source_size, target and taken (words that the mix takes, repeats counted) of every document.

    ``repeats`` is how often the mix holds the document. A source's taken words miss its target by half a document at most.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    drawn = F.md5(F.coalesce(F.concat(F.col(key).cast("string"), F.lit(seed)), F.lit("")).cast("binary"))
    rows = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), drawn.alias("drawn")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most).coalesce(1), "mix-targets")
    rows = rows.join(targets.select(F.col("source").alias("_s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("lane", F.substring("drawn", 1, 3))
    rows = running(rows, ["source_no"], "lane", [F.col("drawn"), F.col("key"), F.col("size")], F.col("size"), "before")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    repeats = whole + F.when((F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * rest), F.lit(1)).otherwise(F.lit(0))
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", repeats.cast("long").alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "", **options) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as the mix holds it.

    What a source adds to its whole repetitions ends at one place of the seeded order, so each source needs one row: its
    whole repetitions and that place. Texts are not shuffled. Rows alike in key and size share a place and are taken alike,
    all of them where the mix ends among them; a row without words comes as often as the whole repetitions say.
    """
    plan = mix(docs, key, text, source, seed=seed, **options)
    drawn = lambda: F.md5(F.coalesce(F.concat(F.col(key).cast("string"), F.lit(seed)), F.lit("")).cast("binary"))
    place = lambda size: F.struct(drawn().alias("a"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("b"), size.alias("c"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("mix_whole", whole).groupBy(F.col(source).alias("mix_s"))
    plan = plan.agg(F.max("mix_whole").alias("mix_whole"), F.max(F.when(F.col("repeats") > F.col("mix_whole"), place(F.col("size")))).alias("mix_last"))
    plan = stored(plan, "mix-plan")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("mix_size", size).join(plan, F.col(source).eqNullSafe(F.col("mix_s")))
    more = (F.col("mix_size") > 0) & F.coalesce(place(F.col("mix_size")) <= F.col("mix_last"), F.lit(False))
    return rows.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("mix_whole") + more.cast("int")))).select(*docs.columns)
