"""Sharding by fixed virtual slots.

A record's virtual slot is a hash of its doc_id and its text's checksum, one of
``slots``, so that many texts of one doc_id spread. Bytes and rows are summed per
virtual slot, and a map from slots to shards, with a version, is stored in the shared
folder: the heaviest slot goes to the lightest shard. Where a map is stored already,
sharding loads the newest version, edits it for the sizes and the number of shards of
now, which moves as few slots as needed, stores that as the next version and places by
it; records never change their slot. Only the map (``slots`` rows) comes to the driver
and is broadcast.

Cases: a null text has size 1 and the checksum of no bytes; a null doc_id is hashed
like any other value; rows of one doc_id and one text share a virtual slot, each with a
place of its own in the shard; a text of any length is one record; an empty table gives
an empty result; other columns are left out.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from ..session import exists

SLOTS = 4096
SHARDS = 8
MAP = "virtual_slot int, shard int, n_bytes long, n_rows long, version int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record; the text goes no further."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", F.crc32(raw)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_rows"))


def assign(sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Heaviest slot first, to the shard that is lightest so far; ties to the smaller number."""
    heap = [(0, s) for s in range(shards)]
    found = {}
    for slot, n_bytes, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        found[slot] = shard
        heapq.heappush(heap, (held + n_bytes, shard))
    return found


def edit(sizes: list[tuple[int, int, int]], now: dict[int, int], shards: int) -> dict[int, int]:
    """The map for another number of shards, or for sizes that have changed. Slots leave
    shards that go away and shards above the mean; the rest stay where they are."""
    weight = {slot: n for slot, n, _ in sizes}
    mean = sum(weight.values()) / shards
    found = {slot: now[slot] for slot in weight if now.get(slot, shards) < shards}
    held = [0] * shards
    for slot, shard in found.items():
        held[shard] += weight[slot]
    loose = [slot for slot in weight if slot not in found]
    for slot in sorted(found, key=lambda x: (weight[x], x)):
        if held[found[slot]] - weight[slot] >= mean:
            held[found[slot]] -= weight[slot]
            loose.append(slot)
            del found[slot]
    heap = [(n, s) for s, n in enumerate(held)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda x: (-weight[x], x)):
        n, shard = heapq.heappop(heap)
        found[slot] = shard
        heapq.heappush(heap, (n + weight[slot], shard))
    return found


def newest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]] | None:
    """The version and the map that were stored last below path, if any."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(MAP).option("recursiveFileLookup", "true").parquet(path)
    version = rows.agg(F.max("version")).first()[0]
    return None if version is None else (version, {r.virtual_slot: r.shard for r in rows.where(F.col("version") == version).collect()})  # at most `slots` rows


def store(spark: SparkSession, path: str, sizes: list[tuple[int, int, int]], found: dict[int, int], version: int) -> DataFrame:
    """Writes one version of the map and reads it back."""
    rows = [(slot, found[slot], n_bytes, n_rows, version) for slot, n_bytes, n_rows in sizes]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version:06d}")
    return spark.read.schema(MAP).parquet(f"{path}/version={version:06d}")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard and slot of each record: its place in the shard, gapless from 0. Places are
    counted within virtual slots, then moved by the rows of the shard's slots before."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(bases), "virtual_slot")
        .withColumn("slot", (F.col("base") + F.col("place")).cast("long"))
        .drop("base", "place")
    )


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot of each record, by the next version of the map below
    path: an edit of the newest one, or a new map where there is none. A path stands for one number of slots."""
    spark = docs.sparkSession
    rows = records(docs, slots)
    sizes = [tuple(r) for r in slot_sizes(rows).collect()]  # at most `slots` rows
    path = path or common.fresh_path(spark, "slot-map")
    known = newest(spark, path)
    version, found = (known[0] + 1, edit(sizes, known[1], shards)) if known else (1, assign(sizes, shards))
    return place(rows, store(spark, path, sizes, found, version))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law kept is `bytes`: the map levels the bytes of the shards."""
    return shard(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
