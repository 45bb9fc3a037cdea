"""Sharding over fixed virtual slots, with DataFrame functions only.

Records are hashed into a fixed number of virtual slots. Bytes are summed for
each slot, and a stored table ``(version, v_slot, shard, bytes, rows)`` says which
shard holds a slot. The first version places the slots, largest first, on the
least loaded shard. Rebalancing, for other sizes or another number of shards,
edits the newest version: slots leave shards that hold too much and no others
move. The edit is stored as the next version; readers take the newest, or one
that they name.

Defined cases: a null text has no bytes (size 1); records of one
id, null or repeated, are dealt by their text; repeated rows share a virtual slot; an empty table gives an empty map and
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fraudlens.llm.storage import shared_folder

SLOTS = 4096
MAP = "v_slot int, shard int, bytes long, rows long, version int"
MAP_COLUMNS = ("version", "v_slot", "shard", "bytes", "rows")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # of the id and the text, so that records of one id, null or repeated, are spread
    return rows.withColumn("v_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot; as many rows as there are slots at most."""
    return rows.groupBy("v_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _deal(slots: Column, loads: Column) -> Column:
    """Fold over slots (largest first): each goes to the least loaded shard, the first of equals."""

    def step(acc: Column, slot: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        loads_after = F.transform(acc["loads"], lambda x, i: F.when(i + 1 == to, x + slot["bytes"]).otherwise(x))
        return F.struct(loads_after.alias("loads"), F.concat(acc["at"], F.array(to - 1)).alias("at"))

    return F.aggregate(slots, F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("at")), step)["at"]


def place_slots(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """The first map. The slots (a fixed number of rows) meet in one row for the fold."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "v_slot", "bytes", "rows")))
    one = sizes.agg(ordered.alias("slots"))
    one = one.withColumn("at", _deal(F.col("slots"), F.array_repeat(F.lit(0).cast("long"), shards)))
    return one.select(F.explode(F.arrays_zip("slots", "at")).alias("x")).select(
        F.lit(version).alias("version"), F.col("x.slots.v_slot").alias("v_slot"), F.col("x.at").alias("shard"), F.col("x.slots.bytes").alias("bytes"), F.col("x.slots.rows").alias("rows")
    )


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the stored map; storing it again replaces it."""
    slot_map.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(folder)


def stored_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest if none is named."""
    versions = spark.read.schema(MAP).parquet(folder)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version").eqNullSafe(F.lit(version))).select(*MAP_COLUMNS)


def rebalance(slot_map: DataFrame, shards: int, sizes: DataFrame | None = None) -> DataFrame:
    """The next version of a map, for as many, more or fewer shards and, if
    given, the slots' new ``sizes``. A shard gives slots, the smallest first,
    while that brings it nearer to the new mean; shards that are no more give all.
    Only those slots move: they are dealt over all shards, the largest first, to
    the least loaded."""
    newest = slot_map.join(F.broadcast(slot_map.agg(F.max("version").alias("version"))), "version")
    if sizes is not None:  # one row for each slot on both sides
        newest = sizes.join(newest.select("version", "v_slot", "shard"), "v_slot", "full").select(
            F.max("version").over(Window.partitionBy()).alias("version"), "v_slot", F.coalesce("shard", F.lit(shards)).alias("shard"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
        )
    order = Window.partitionBy("shard").orderBy("bytes", "v_slot")
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)  # the map has a fixed number of rows
    left = F.sum("bytes").over(Window.partitionBy("shard")) - F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edited = newest.withColumn("_moves", (F.col("shard") >= shards) | (left + F.col("bytes") / 2 >= mean)).withColumn("version", (F.col("version") + 1).cast("int"))
    loads = edited.filter("NOT _moves").groupBy("shard").agg(F.sum("bytes").alias("load"))
    held = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("held"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0).cast("long")))
    slots = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "v_slot", "version", "bytes", "rows")))
    moved = edited.filter("_moves").agg(slots.alias("slots")).join(F.broadcast(held)).withColumn("at", _deal(F.col("slots"), loads))
    moved = moved.select(F.explode(F.arrays_zip("slots", "at")).alias("x"))
    moved = moved.select("x.slots.version", "x.slots.v_slot", F.col("x.at").alias("shard"), "x.slots.bytes", "x.slots.rows")
    return edited.filter("NOT _moves").select(*MAP_COLUMNS).unionByName(moved)


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its place there, gapless from 0.

    Records are numbered inside their virtual slot; a slot begins where the
    shard's slots before it end. The map has a fixed number of rows, so it is
    broadcast and its running sums take one small task."""
    ahead = Window.partitionBy("shard").orderBy("v_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.select("v_slot", "shard", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("_from"))
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy("v_slot").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(F.broadcast(places), "v_slot").withColumn("slot", F.col("_from") + F.col("_row") - 1)


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Law ``bytes``: doc_id, size, text_crc32, law, shard, slot, grown_shard and the virtual slot."""
    rows = sized(docs, id_col, text_col, slots)
    folder = shared_folder(docs.sparkSession) + "/slot_map"
    store_map(place_slots(slot_sizes(rows), shards), folder)
    return assign(rows, stored_map(docs.sparkSession, folder)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "v_slot"
    )
