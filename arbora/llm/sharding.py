"""Sharding by fixed virtual slots.

A record, its key and text, is hashed into one of thousands of virtual slots, for good. Bytes are summed per slot, and a
versioned map says which shard holds which slot. Rebalancing edits the map: it moves whole slots from shards that hold more
than their share to those that hold least. Given a folder, a run loads the latest version there, edits it for the bytes it
finds, and saves the next one; else it starts with version 0. Only DataFrame and SQL functions run here.

A slot that holds more than ``HOT`` times its part of the bytes, as a slot of many equal records does, cannot be moved as a
whole without harm: its rows are dealt again to all slots by their numbers.

Defined cases: a null text weighs 1 byte and has no checksum; a null key counts as an empty one; repeated rows share a slot,
but for hot slots, and get different places; ties of slots go by number; an empty table gives no rows, and a map in which
every slot has 0 bytes. Columns of the input beside key and text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, stored

SLOTS = 4096
HOT = 8


def with_slots(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Key, size (UTF-8 bytes of the text plus 1), the text's checksum and the virtual slot of every row."""
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)), F.lit(slots))
    return df.select(
        F.col(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        slot.cast("int").alias("virtual_slot"),
    )


def cooled(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The stored rows, numbered by ``row``, with those of hot slots dealt again to all slots."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    part = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / slots
    hot = sums.select("virtual_slot", (F.col("bytes") > HOT * part).alias("hot")).where("hot")  # slots / HOT rows at most
    rows = rows.join(F.broadcast(hot), "virtual_slot", "left")
    again = F.pmod(F.xxhash64("virtual_slot", "row"), F.lit(slots)).cast("int")
    return rows.withColumn("virtual_slot", F.when(F.col("hot"), again).otherwise(F.col("virtual_slot"))).drop("hot", "row")


def slot_bytes(spark: SparkSession, rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes of every slot, also of empty ones: ``slots`` rows, whatever the input's size."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(sums, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map: slots dealt in turn."""
    return sizes.withColumn("shard", F.pmod("virtual_slot", F.lit(shards)).cast("int")).withColumn("version", F.lit(0))


def rebalance(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map ``(virtual_slot, bytes, shard, version)`` for ``shards`` shards.

    A shard keeps its largest slots as long as they fit its share of the bytes. The other slots, largest first, go to
    the shard with the fewest bytes. The map has a fixed number of rows, so one task folds over it.
    """
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    marked = slot_map.withColumn("upto", F.sum("bytes").over(largest_first)).withColumn("all_bytes", F.sum("bytes").over(everything))
    marked = marked.withColumn("stays", (F.col("upto") * shards <= F.col("all_bytes")) & (F.col("shard") < shards))
    folded = marked.agg(
        F.collect_list(F.when(F.col("stays"), F.struct(F.col("shard").alias("shard"), F.col("bytes").alias("bytes")))).alias("kept"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("virtual_slot"))))).alias("moved"),
    )
    folded = folded.withColumn("loads", F.expr(f"transform(sequence(0, {shards - 1}), s -> aggregate(filter(kept, k -> k.shard = s), 0L, (a, k) -> a + k.bytes))"))
    folded = folded.withColumn(
        "placed",
        F.expr(
            """aggregate(moved, named_struct('loads', loads, 'to', cast(array() as array<int>)),
                 (a, m) -> named_struct(
                   'loads', transform(a.loads, (v, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, v - m.less, v)),
                   'to', concat(a.to, array(cast(array_position(a.loads, array_min(a.loads)) - 1 as int)))),
                 a -> a.to)"""
        ),
    )
    moves = folded.select(F.explode(F.arrays_zip(F.col("moved.virtual_slot").alias("virtual_slot"), F.col("placed").alias("to"))).alias("m")).select("m.virtual_slot", "m.to")
    return slot_map.join(F.broadcast(moves), "virtual_slot", "left").select(
        "virtual_slot", "bytes", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version"), (F.col("to").isNotNull() & (F.col("to") != F.col("shard"))).alias("moved")
    )


def latest(spark: SparkSession, maps: str) -> int | None:
    """The newest version in a folder of maps, by the driver's view of the shared file system; None without any."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(maps)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []
    return max((int(n.removeprefix("version-")) for n in found if n.startswith("version-")), default=None)


def load_map(spark: SparkSession, maps: str, version: int | None = None) -> DataFrame:
    """A saved map ``(virtual_slot, bytes, shard, version)``, the latest one if no version is named."""
    return spark.read.parquet(f"{maps}/version-{latest(spark, maps) if version is None else version}")


def save_map(slot_map: DataFrame, maps: str, version: int) -> DataFrame:
    """Save a map under its version, which must be new, and read it back."""
    slot_map.coalesce(1).write.parquet(f"{maps}/version-{version}")
    return load_map(slot_map.sparkSession, maps, version)


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 16, slots: int = SLOTS, key: str = "doc_id", text: str = "text", maps: str | None = None) -> DataFrame:
    """Shard and place of every document, by a map that balances bytes over ``shards`` shards.

    ``maps`` is a folder of versioned maps that runs share. Returns key, size, text_crc32, virtual_slot, shard, slot (place in
    the shard, gapless from 0) and map_version.
    """
    rows = stored(with_slots(docs, key, text, slots).withColumn("row", F.monotonically_increasing_id()), "slotted")
    rows = stored(cooled(rows, slots), "cooled")
    sizes = slot_bytes(spark, rows, slots)
    last = latest(spark, maps) if maps else None
    if last is None:
        before = first_map(sizes, shards)
    else:
        before = sizes.join(load_map(spark, maps, last).select("virtual_slot", "shard", "version"), "virtual_slot")
    after = rebalance(before, shards)
    slot_map = save_map(after, maps, (last or 0) + 1) if maps else stored(after.coalesce(1), "slot-map")
    slot_map = slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version"))
    rows = rows.join(F.broadcast(slot_map), "virtual_slot")  # a row for each slot
    return running(rows, ["shard"], "virtual_slot", [F.col(key), F.col("text_crc32"), F.col("size")], F.lit(1), "slot").withColumn("slot", F.col("slot").cast("long"))
