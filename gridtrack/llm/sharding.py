"""Sharding over fixed virtual slots, in DataFrame functions only.

Every row is hashed once and for all into one of a few thousand slots.  Only the
slots are placed: the bytes per slot are summed, and a map from slot to shard is
stored under a version number.  Version 0 deals slots in turn; ``rebalance``
edits the last version, moving as few bytes as it can, and stores the next.  A
map has one row per slot, so its size does not depend on the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridtrack.session import stage

SLOTS = 4096


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)`` of every row.

    Size is the bytes of the text plus 1, a null text has none and the checksum
    of no bytes.  The slot depends on id and checksum, so rows that share an id
    or a text do not share a slot.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return rows.withColumn(
        "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_totals(rows: DataFrame) -> DataFrame:
    """Rows and bytes of every slot in use: at most one row per slot."""
    return rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt in turn, whatever they hold."""
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"),
        (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of a slot map: bytes level over ``shards``, few slots moved.

    Slots are visited from the heaviest to the lightest.  A slot stays where the
    last version has it while its shard keeps within the mean; otherwise it goes
    to the shard with the fewest bytes so far.  The visit is a fold over one
    array with a row per slot.
    """
    weights = slot_map.join(totals, "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    visit = weights.agg(
        F.max("version").alias("version"), F.sum("bytes").alias("all_bytes"),
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("weight"), "virtual_slot", "shard"))).alias("slots"))
    fold = f"""
      aggregate(
        slots,
        named_struct('load', array_repeat(0L, {shards}), 'placed', array_repeat(0, 0)),
        (state, slot) -> named_struct(
          'load', transform(state.load, (held, i) -> held - if(i = {{target}}, slot.weight, 0L)),
          'placed', array_append(state.placed, cast({{target}} AS int))),
        state -> state.placed)
    """
    lightest = "array_position(state.load, array_min(state.load)) - 1"
    stays = f"slot.shard < {shards} AND state.load[least(slot.shard, {shards - 1})] - slot.weight <= ceil(all_bytes / {shards})"
    placed = F.expr(fold.format(target=f"if({stays}, slot.shard, {lightest})"))
    pairs = visit.select("version", F.posexplode(F.arrays_zip("slots", placed.alias("placed"))).alias("rank", "pair"))
    return pairs.select(
        (F.col("version") + 1).alias("version"), F.col("pair.slots.virtual_slot").alias("virtual_slot"),
        F.col("pair.placed").alias("shard"))


def shard_by_bytes(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Rows with their shard and place, and the stored map with all its versions.

    Rows: ``(doc_id, size, text_crc32, virtual_slot, shard, slot)``; ``slot`` counts
    the rows of a shard from 0 without a gap, by virtual slot and id.  Repeated
    rows each have a place.  An empty table gives no rows and a map all the same.
    """
    rows = stage(slotted(docs, slots), "shard-rows")
    totals = stage(slot_totals(rows), "shard-totals")
    dealt = first_map(docs.sparkSession, shards, slots)
    stored = stage(dealt.unionByName(rebalance(dealt, totals, shards)), "slot-map")
    latest = stored.where("version = 1").drop("version")

    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = latest.join(totals, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1)
    placed = ranked.join(F.broadcast(places), "virtual_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
    ), stored
