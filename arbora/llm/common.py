"""What several operators share: word patterns, shared-folder tables, running totals without a hot task."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word and a gap between words, for Java and for Python alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Send a module's functions to the executors inside the task, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for models that are costly to build."""
    import sys as _sys

    return _sys.modules.setdefault("_arbora_worker_cache", types.ModuleType("_arbora_worker_cache")).__dict__


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine serves a local session, whose executors are in the driver; on a cluster
    that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Paths of the tables stored in each open ``scratch``.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and gives the planner the table's true size, by which
    it broadcasts small tables and shuffles large ones. The files stay, as results may be read from them at any later time,
    but inside :func:`scratch`.
    """
    path = f"{shared_dir(df.sparkSession)}/arbora/{df.sparkSession.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    for paths in _OPEN[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what is stored inside, but for the table stored last, which belongs to the next outer ``scratch``."""
    _OPEN.append([])
    try:
        yield
    finally:
        *gone, last = _OPEN.pop() or [""]
        for paths in _OPEN[-1:]:
            paths.append(last)
        for path in gone:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remainder(column: str, modulus: int) -> Column:
    """``crc32`` of an id's decimal text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)).cast("int")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


def once(value: Column) -> Column:
    """``value``, evaluated in its own step.

    The condition is always true but not deterministic, so Catalyst neither pushes a later filter below the step nor
    copies the expression into the lambdas that use it, where it would be evaluated again for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def running(df: DataFrame, group: Sequence[str], lane: str, order: Sequence[Column | str], value: Column, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the same group that come before, in order of lane, then ``order``.

    The rows of a group are dealt to tasks by ``(group, lane)``, so a group that holds most rows is spread over as many
    tasks as it has lanes. Only one row for each group and lane goes through the window over whole groups. Group and
    lane columns must not be null. ``df`` is read twice, so it should be a stored table.
    """
    inside = Window.partitionBy(*group, lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    lanes = df.groupBy(*group, lane).agg(F.sum(value).alias("_lane_sum"))
    lanes = lanes.withColumn("_lane_start", F.coalesce(F.sum("_lane_sum").over(before), F.lit(0))).drop("_lane_sum")
    rows = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(lanes, [*group, lane]).withColumn(into, F.col("_lane_start") + F.col("_inside")).drop("_lane_start", "_inside")


def per_batch(function: Callable, df: DataFrame, schema: str) -> DataFrame:
    """``mapInPandas`` with the function applied to each Arrow batch."""

    def run(batches):
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


by_value(__name__)
