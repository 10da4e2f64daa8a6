"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its text, so equal texts share a slot and thereby a shard. Bytes are summed per slot, and
slots go to shards from the heaviest down, each to the shard that holds least. Growing or balancing edits the map:
only the slots that an edit names move, and every edit is a new version.

A slot that holds more than a shard's fair share can't stay whole; its records are dealt to parts by a hash of the id,
and the map has a row per part. All that reaches the driver is a row per slot.

Defined cases: a NULL text has no bytes and is placed by its id; an empty text has no bytes; every record counts one
byte more than its text; repeated rows are records of their own; an empty table gives an empty result and an empty map;
other columns are kept by `write_shards` and not read elsewhere.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096

#: Cells in which records are numbered, beyond one per slot: bounds the rows of the numbering table at any input size.
CELLS = 20_000


@dataclass(frozen=True)
class SlotMap:
    """`shard_of[(slot, part)]` is the shard; `parts[slot]` says into how many parts a slot is dealt (1 if absent)."""

    version: int
    shards: int
    shard_of: dict[tuple[int, int], int]
    parts: dict[int, int]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s, p, self.parts.get(s, 1), shard) for (s, p), shard in sorted(self.shard_of.items())]
        return spark.createDataFrame(rows, "vslot int, part int, parts int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version beside the earlier ones below `path`."""
        self.frame(spark).withColumn("shards", F.lit(self.shards)).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/version={self.version}"
        )

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the last one by default."""
        found = spark.read.parquet(path)
        if version is None:
            version = found.agg(F.max("version")).first()[0]
        rows = found.where(F.col("version") == version).collect()
        shards = rows[0]["shards"] if rows else 0
        return SlotMap(
            version, shards, {(r["vslot"], r["part"]): r["shard"] for r in rows}, {r["vslot"]: r["parts"] for r in rows if r["parts"] > 1}
        )


def slot_of(text: str | Column, key: str | Column, slots: int = SLOTS) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.pmod(F.coalesce(F.xxhash64(F.when(text.isNotNull(), text)), F.lit(0)) + F.when(text.isNull(), F.xxhash64(key)).otherwise(0), F.lit(slots)).cast("int")


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) per record."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size_of("text").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        slot_of("text", "doc_id", slots).alias("vslot"),
    )


def slot_loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """{slot: (bytes, records)}; at most a row per slot."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    return {r["vslot"]: (r["bytes"], r["n"]) for r in found}


def _units(loads: dict[int, tuple[int, int]], parts: dict[int, int]) -> list[tuple[float, int, int]]:
    return [(size / parts.get(s, 1), s, p) for s, (size, _) in loads.items() for p in range(parts.get(s, 1))]


def assign(loads: dict[int, tuple[int, int]], shards: int) -> SlotMap:
    """The first version: heaviest slots first, each to the lightest shard; ties to the lower number."""
    share = max(1.0, sum(size for size, _ in loads.values()) / shards)
    parts = {s: math.ceil(2 * size / share) for s, (size, n) in loads.items() if size > share and n > 1}
    heap = [(0.0, shard) for shard in range(shards)]
    shard_of = {}
    for size, s, p in sorted(_units(loads, parts), key=lambda u: (-u[0], u[1], u[2])):
        held, shard = heapq.heappop(heap)
        shard_of[s, p] = shard
        heapq.heappush(heap, (held + size, shard))
    return SlotMap(1, shards, shard_of, parts)


def _held(m: SlotMap, loads: dict[int, tuple[int, int]]) -> list[float]:
    held = [0.0] * m.shards
    for size, s, p in _units(loads, m.parts):
        held[m.shard_of[s, p]] += size
    return held


def rebalance(m: SlotMap, loads: dict[int, tuple[int, int]], tolerance: float = 0.02) -> SlotMap:
    """The next version after loads have changed: slots move from the heaviest to the lightest shard as long as that
    brings the two closer. Slots that had no records before go to the lightest shard.
    """
    shard_of = dict(m.shard_of)
    sizes = {(s, p): size for size, s, p in _units(loads, m.parts)}
    held = [0.0] * m.shards
    for unit, size in sizes.items():
        if unit in shard_of:
            held[shard_of[unit]] += size
    for unit, size in sorted(sizes.items(), key=lambda u: (-u[1], u[0])):
        if unit not in shard_of:
            shard_of[unit] = min(range(m.shards), key=lambda i: (held[i], i))
            held[shard_of[unit]] += size
    mean = sum(held) / max(1, m.shards)
    for _ in range(len(sizes)):
        top, low = max(range(m.shards), key=lambda i: held[i]), min(range(m.shards), key=lambda i: held[i])
        gap = held[top] - held[low]
        movable = [u for u, size in sizes.items() if shard_of[u] == top and size < gap]
        if gap <= tolerance * mean or not movable:
            break
        unit = min(movable, key=lambda u: (abs(gap / 2 - sizes[u]), u))
        shard_of[unit] = low
        held[top] -= sizes[unit]
        held[low] += sizes[unit]
    return replace(m, version=m.version + 1, shard_of=shard_of)


def grow(m: SlotMap, loads: dict[int, tuple[int, int]]) -> SlotMap:
    """The next version with one shard more: it takes slots from the heaviest shards until it has its share."""
    new, shard_of = m.shards, dict(m.shard_of)
    held = [*_held(m, loads), 0.0]
    sizes = {(s, p): size for size, s, p in _units(loads, m.parts)}
    share = sum(held) / (new + 1)
    while True:
        top = max(range(new), key=lambda i: held[i])
        movable = [u for u, size in sizes.items() if shard_of[u] == top and 0 < size <= share - held[new]]
        if held[top] <= share or not movable:
            return SlotMap(m.version + 1, new + 1, shard_of, m.parts)
        unit = min(movable, key=lambda u: (abs(held[top] - share - sizes[u]), u))
        shard_of[unit] = new
        held[top] -= sizes[unit]
        held[new] += sizes[unit]


def place(rows: DataFrame, m: SlotMap) -> DataFrame:
    """`rows` (with vslot and doc_id) with the shard that the map gives them."""
    found = F.broadcast(m.frame(rows.sparkSession))  # one row per slot and part: a fixed bound
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts")).cast("int")
    return rows.join(found, "vslot").where(part == F.col("part"))


def number(rows: DataFrame, loads: dict[int, tuple[int, int]]) -> DataFrame:
    """Add `slot`, a record's number within its shard from 0 on, without a gap.

    Records are numbered within small cells, of which a hot slot has many; a shard's cells follow one another.
    """
    spark = rows.sparkSession
    total = sum(n for _, n in loads.values())
    a_cell = max(200, total // CELLS)
    cells = spark.createDataFrame([(s, max(1, math.ceil(n / a_cell))) for s, (_, n) in loads.items()], "vslot int, cells int")
    rows = rows.join(F.broadcast(cells), "vslot").withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit("cell")), F.col("cells")))
    counts = rows.groupBy("shard", "vslot", "part", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("vslot", "part", "cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "vslot", "part", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "vslot", "part", "cell").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("nr", F.row_number().over(own) - 1).join(begins, ["shard", "vslot", "part", "cell"]).withColumn(
        "slot", F.col("before") + F.col("nr")
    )


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """Every record with its shard and its number there, and the map that decided it."""
    rows = records(docs, slots)
    loads = slot_loads(rows)
    m = assign(loads, shards)
    return number(place(rows, m), loads), m


def write_shards(docs: DataFrame, m: SlotMap, path: str, slots: int = SLOTS) -> None:
    """One folder per shard below `path`; a hot shard's records are spread over several files by slot."""
    rows = docs.withColumn("vslot", slot_of("text", "doc_id", slots))
    placed = place(rows, m).drop("part", "parts")
    placed.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.partitionBy("shard").parquet(path)
