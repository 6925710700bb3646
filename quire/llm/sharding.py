"""Sharding over fixed virtual slots.

A record's slot is the hash of its text modulo a fixed number of slots, so equal
texts share a slot and slots never change when shards do.  Bytes are aggregated
per (slot, part), where the part spreads a slot's records over ``PARTS``
sub-slots by id: 65,536 counters whatever the data holds.  A versioned map names
the shard of each slot; rebalancing edits the map, moving slots (and, for a slot
above ``1/SPLIT`` of a shard's share, its parts one by one) from the heaviest to
the lightest shard.  Records are never rehashed.

A null text has size 1 and the hash of an empty text; null ids are hashed as
such; repeated rows are placed one by one.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quire.session import scratch_path

from .common import cut

SLOTS = 4096
PARTS = 16
SPLIT = 4           # a slot above 1/SPLIT of a shard's mean load may be split into parts
ROWS_PER_BUCKET = 2048

MAP_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType(), False),
    T.StructField("virtual_slot", T.IntegerType(), False),
    T.StructField("shard_of_part", T.ArrayType(T.IntegerType(), False), False),
])


def place(docs: DataFrame, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot, part)`` of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), crc.alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.xxhash64(F.lit("part"), "doc_id", crc), F.lit(parts)).cast("int").alias("part"))


@dataclass
class SlotMap:
    """Versioned map, stored as a table of one row per slot and version; a row
    holds the shard of each of the slot's parts."""

    spark: SparkSession
    path: str
    slots: int = SLOTS
    parts: int = PARTS

    def write(self, version: int, shard_of: dict[tuple[int, int], int]) -> None:
        rows = [(version, s, [shard_of[s, p] for p in range(self.parts)]) for s in range(self.slots)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self, version: int | None = None) -> DataFrame:
        df = self.spark.read.schema(MAP_SCHEMA).parquet(self.path)
        if version is None:
            version = df.agg(F.max("version")).first()[0]
        return df.filter(F.col("version") == version)

    def latest(self) -> tuple[int, dict[tuple[int, int], int]]:
        rows = self.read().collect()            # one row per slot
        return rows[0]["version"], {(r["virtual_slot"], p): k for r in rows
                                    for p, k in enumerate(r["shard_of_part"])}

    def initialise(self, shards: int) -> None:
        self.write(1, {(s, p): s % shards for s in range(self.slots) for p in range(self.parts)})


def rebalance(shard_of: dict, load: dict, shards: int, slots: int = SLOTS, parts: int = PARTS) -> dict:
    """A new map with near-equal loads, moving as little as it can: while the
    heaviest shard holds a unit that is smaller than its distance to the lightest
    one, the unit nearest to half that distance moves there.  Units are slots;
    the parts of a slot above 1/``SPLIT`` of the mean load are units of their own."""
    total = sum(load.values())
    limit = total / max(1, shards) / SPLIT
    units: dict[tuple, int] = {}
    where: dict[tuple, int] = {}
    for s in range(slots):
        own = [(s, p) for p in range(parts)]
        size = sum(load.get(k, 0) for k in own)
        together = size <= limit and len({shard_of[k] for k in own}) == 1
        for unit in ([(s, None)] if together else own):
            units[unit] = size if unit[1] is None else load.get(unit, 0)
            where[unit] = shard_of[own[0] if unit[1] is None else unit]
    sums = [0] * shards
    held: list[dict] = [{} for _ in range(shards)]
    for unit, size in units.items():
        k = where[unit] if where[unit] < shards else sums.index(min(sums))
        where[unit] = k
        sums[k] += size
        held[k][unit] = size
    for _ in range(4 * len(units)):
        a, b = max(range(shards), key=sums.__getitem__), min(range(shards), key=sums.__getitem__)
        gap = sums[a] - sums[b]
        movable = [(abs(2 * size - gap), unit) for unit, size in held[a].items() if 0 < size < gap]
        if not movable:
            break
        unit = min(movable, key=lambda x: (x[0], x[1][0], x[1][1] if x[1][1] is not None else -1))[1]
        size = held[a].pop(unit)
        held[b][unit], where[unit] = size, b
        sums[a] -= size
        sums[b] += size
    return {(s, p): where[(s, None)] if (s, None) in where else where[(s, p)]
            for s in range(slots) for p in range(parts)}


def number_rows(rows: DataFrame, group: str, order: list, n_buckets: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within each ``group`` without one task per group:
    rows are numbered inside hash buckets and shifted by the counts before them."""
    bucket = F.pmod(F.xxhash64(F.lit("row"), *order), F.lit(n_buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (rows.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy(group, "bucket").orderBy(*order)
    return (rows.withColumn("nth", F.row_number().over(inside)).join(counts, [group, "bucket"])
            .withColumn(out, (F.col("base") + F.col("nth") - 1).cast("long"))
            .drop("bucket", "nth", "base"))


def shard_documents(docs: DataFrame, shards: int = 8, path: str | None = None) -> DataFrame:
    """Places all records and balances the shards by bytes.  ``slot`` is the
    record's place in its shard, gapless from 0; ``virtual_slot`` is its slot."""
    spark = docs.sparkSession
    placed = cut(place(docs))
    slot_map = SlotMap(spark, path or scratch_path(spark, "slot-map"))
    slot_map.initialise(shards)
    # SLOTS * PARTS counters at most
    counters = placed.groupBy("virtual_slot", "part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).toPandas()
    load = dict(zip(zip(counters["virtual_slot"].tolist(), counters["part"].tolist()), counters["b"].tolist()))
    n_rows = int(counters["n"].sum())
    version, current = slot_map.latest()
    slot_map.write(version + 1, rebalance(current, load, shards))
    # the map has SLOTS rows whatever the data holds, so it may be broadcast
    mapped = (placed.join(F.broadcast(slot_map.read(version + 1)), "virtual_slot")
              .withColumn("shard", F.element_at("shard_of_part", F.col("part") + 1)))
    n_buckets = max(16, -(-n_rows // (ROWS_PER_BUCKET * shards)))
    numbered = number_rows(mapped, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], n_buckets, "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                           F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "part",
                           F.col("version").alias("map_version"))
