"""Sharding by fixed virtual slots, under the law of near equal sizes.

A record's slot is a hash of its id and text modulo a fixed number of slots. The slots never change; a map from slot to shard does. Bytes
are summed per slot, and rebalancing edits the map: every shard keeps its largest slots up to the fair share, and the released ones, which are
small, go one by one, largest first, each to the shard that holds least by then. So no more bytes move than a shard has too many, and shards end
up one small slot apart. Each edit is a new version of the map; old versions stay readable.

One slot may hold far more than others: a record that stands in the table again and again. A slot above a part (1 / ``HEAVY``) of a
fair share is cut into pieces, each with an entry of its own in the map, and its rows are dealt over the pieces. A single long record cannot be cut.

Only the map, with a row per slot, is sorted as a whole. Records are never grouped by shard: their places inside it are counted per
(slot, piece, grain), where the number of grains follows from the fullest piece, and offsets are prefix sums of these counts.

Defined results. A null text has no bytes and the checksum of no bytes; a record's size is its bytes and one more. Null ids are an id like any
other. Repeated rows are rows of their own. An empty table gives no rows and a map without bytes. The places of equal records are settled by the order in which they
were read; equal records are interchangeable. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

SLOTS = 8192
#: a slot above this part of a fair share is cut into pieces
HEAVY = 16
#: rows of one (slot, piece, grain) at most, as planned from the counts
GRAIN_ROWS = 250_000


def with_slot(records: DataFrame, key: Column, text: Column, slots: int = SLOTS) -> DataFrame:
    """Add ``_slot``, ``_size`` and ``_salt``, a number that tells equal records apart."""
    return records.select(
        "*", F.pmod(F.xxhash64(key, text), F.lit(slots)).cast("int").alias("_slot"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("_size"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map (version, slot, pieces, piece, shard), made before anything is known of the records."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(
        F.lit(1).alias("version"), slot.alias("slot"), F.lit(1).alias("pieces"), F.lit(0).alias("piece"), (slot % shards).alias("shard"))


def cut_slots(records: DataFrame, shards: int) -> DataFrame:
    """(slot, pieces): in how many pieces the slots with rows are cut, from their bytes and rows."""
    per = records.groupBy(F.col("_slot").alias("slot")).agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"))
    share = F.greatest(F.sum("bytes").over(Window.partitionBy()) / shards / HEAVY, F.lit(1.0))  # a row per slot
    return per.select("slot", F.least("n", F.ceil(F.col("bytes") / share), F.lit(shards * HEAVY)).cast("int").alias("pieces"))


def with_piece(records: DataFrame, cut: DataFrame) -> DataFrame:
    """Deal the rows of each slot over its pieces."""
    cut = F.broadcast(cut.select(F.col("slot").alias("_slot"), F.col("pieces").alias("_pieces")))  # a row per slot
    pieces = F.coalesce("_pieces", F.lit(1))
    return records.join(cut, "_slot", "left").select(*records.columns, F.pmod("_salt", pieces).cast("int").alias("_piece"))


def rebalanced(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map's next version for the measured ``sizes`` (slot, pieces, piece, bytes); slots without rows stay where they are.

    Pieces that the old map did not know start at its entry of piece 0. Shards beyond ``shards`` are emptied.
    """
    slots = old.where("piece = 0").select("slot", F.col("shard").alias("home"), "version")
    known = old.select("slot", "piece", "shard")
    now = slots.join(sizes, "slot", "left").select(
        "slot", "version", "home", F.coalesce("pieces", F.lit(1)).alias("pieces"), F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    now = now.join(known, ["slot", "piece"], "left").select("slot", "pieces", "piece", "bytes", "version", F.coalesce("shard", "home").alias("shard"))
    everything = Window.partitionBy()
    kept_size = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "piece").rowsBetween(Window.unboundedPreceding, 0))
    now = now.withColumn("stays", (F.col("shard") < shards) & ((F.col("bytes") == 0) | (kept_size * shards <= F.sum("bytes").over(everything) + shards - 1)))

    stay = now.where("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    load = F.map_from_entries(F.collect_list(F.struct("shard", "bytes")))
    loads = stay.agg(load.alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0).cast("bigint"))).alias("loads"))
    free = now.where("not stays").agg(F.sort_array(F.collect_list(F.struct("bytes", "slot", "piece")), asc=False).alias("free"))

    def place(state: Column, one: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == least, x + one["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["to"], F.array(least)).alias("to"))

    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("to"))
    # both sides are one row: slots that were released, and what each shard still holds
    moved = free.crossJoin(loads).select("free", F.aggregate("free", start, place, lambda s: s["to"]).alias("to")).select(
        F.explode(F.arrays_zip("free", "to")).alias("m")).select(F.col("m.free.slot"), F.col("m.free.piece"), F.col("m.to").alias("to"))
    return now.join(moved, ["slot", "piece"], "left").select(
        (F.col("version") + 1).alias("version"), "slot", "pieces", "piece", F.coalesce("to", "shard").alias("shard"))


def save_map(edited: DataFrame, path: str) -> None:
    """Add a version to a stored map; each version is a folder of its own, so a repeated write replaces only itself."""
    version = edited.agg(F.max("version")).first()[0]
    edited.drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a stored map, or a given one."""
    every = spark.read.option("recursiveFileLookup", "false").parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == version).select("version", "slot", "pieces", "piece", "shard")


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``_shard`` to records with slot and salt, whatever other columns they have."""
    cut = slot_map.where("piece = 0").select("slot", "pieces")
    to = F.broadcast(slot_map.select(F.col("slot").alias("_slot"), F.col("piece").alias("_piece"), F.col("shard").alias("_shard")))  # a row per slot and piece
    found = with_piece(records, cut)
    return found.join(to, ["_slot", "_piece"]).select(*found.columns, "_shard")


def positions(records: DataFrame, *order: str) -> DataFrame:
    """Add ``_position``: gapless from 0 inside each shard, for records with shard, slot, piece and salt."""
    most = records.groupBy("_slot", "_piece").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cells = ["_shard", "_slot", "_piece", "_grain"]
    records = records.withColumn("_grain", F.pmod(F.shiftright("_salt", 20), F.lit(most // GRAIN_ROWS + 1)).cast("int"))
    before = Window.partitionBy("_shard").orderBy(*cells[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = records.groupBy(*cells).agg(F.count("*").alias("_n")).select(*cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*cells).orderBy(*order, "_salt"))
    return records.select("*", inside.alias("_inside")).join(offsets, cells).select(
        *[c for c in records.columns if c != "_grain"], (F.col("_offset") + F.col("_inside") - 1).alias("_position"))


def shard_records(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS,
                  old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, size, crc, slot, shard, position) for all records, and the new version of the map.

    ``old`` is the map to edit; without one, the even map of ``first_map`` is version 1 and the result version 2.
    """
    spark = docs.sparkSession
    bytes_of = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    slim = with_slot(slim, F.col("_id"), F.col("_text"), slots).withColumn("_crc", F.crc32(F.encode(F.coalesce("_text", F.lit("")), "UTF-8"))).drop("_text")
    slim = stored(slim, "records")
    cut = cut_slots(slim, shards)
    sizes = with_piece(slim, cut).groupBy(F.col("_slot").alias("slot"), F.col("_piece").alias("piece")).agg(F.sum("_size").alias("bytes"))
    sizes = sizes.join(F.broadcast(cut), "slot")
    edited = stored(rebalanced(first_map(spark, shards, slots) if old is None else old, sizes, shards), "slot-map")
    found = positions(placed(slim, edited), "_id", "_crc")
    return found.select(*[F.col(f"_{c}").alias(c) for c in ("id", "size", "crc", "slot", "piece", "shard", "position")]), edited


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> None:
    """Write whole records into a folder per shard, in one pass and without a shuffle."""
    rows = placed(with_slot(docs, F.col(doc_id), F.col(text), slots), slot_map)
    rows.select(*docs.columns, "_shard").write.partitionBy("_shard").parquet(path)
