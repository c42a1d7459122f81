"""Shards from fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots. The bytes of
each slot are summed once (a table as long as the number of slots, whatever the
size of the corpus), and a *versioned* slot-to-shard map is laid over the slots.
Rebalancing edits that map: it moves as few slots as the tolerance asks for and
gives the edited map the next version, so records never need to be hashed anew.

Only DataFrame expressions touch records. What reaches the driver is the slot
table, whose length is a parameter.

Equal texts hash alike, so they lie in one slot and in one shard. A slot that is
heavier than a shard's fair share (one text making up a large part of the
corpus) cannot lie in one shard if shards are to be equal; such a slot is split
into sub-slots by the hash of the record id, and nothing else is.

Defined results for odd input: a null text has no bytes and the text checksum of
the empty text; a null id hashes as a null does (all such rows share one hash
bucket); repeated rows are each placed; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gistra.llm.common import table, whole_text

SLOTS = 4096
#: Sub-slots of a split slot, and hash buckets in which rows of a shard are numbered.
PARTS = 1024
BUCKETS = 256


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map. ``split`` names the slots dealt by sub-slot."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    split: dict[int, tuple[int, ...]] = field(default_factory=dict)

    def shard(self, slot: Column, part: Column) -> Column:
        """The shard of a slot (and, in a split slot, of a sub-slot)."""
        whole = F.from_json(F.lit(json.dumps(list(self.shard_of))), "array<int>")[slot]
        for at, parts in sorted(self.split.items()):
            own = F.from_json(F.lit(json.dumps(list(parts))), "array<int>")[part]
            whole = F.when(slot == at, own).otherwise(whole)
        return whole

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table (version, slot, part, shard); part is -1 for an unsplit slot."""
        rows = [[self.version, s, -1, x] for s, x in enumerate(self.shard_of) if s not in self.split]
        rows += [[self.version, s, i, x] for s, xs in sorted(self.split.items()) for i, x in enumerate(xs)]
        text = json.dumps([dict(zip(("version", "slot", "part", "shard"), r)) for r in rows])
        kind = "array<struct<version:int,slot:int,part:int,shard:int>>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to a stored map."""
        self.frame(spark).withColumn("n_shards", F.lit(self.n_shards)).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The stored map of a version, the latest if none is given."""
        df = spark.read.parquet(path)
        at = version if version is not None else df.agg(F.max("version")).first()[0]
        rows = df.filter(F.col("version") == at).orderBy("slot", "part").collect()
        split: dict[int, list[int]] = {}
        for r in rows:
            if r.part >= 0:
                split.setdefault(r.slot, []).append(r.shard)
        whole = {r.slot: r.shard for r in rows if r.part < 0}
        n = max([*whole, *split]) + 1
        return cls(at, rows[0].n_shards, tuple(whole.get(s, 0) for s in range(n)), {k: tuple(v) for k, v in split.items()})


def slot_of(text: Column, n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(n_slots)).cast("int")


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(PARTS)).cast("int")


def slot_bytes(records: DataFrame, size: str = "size", slot: str = "slot") -> list[int]:
    """Bytes of each slot, as a list as long as there are slots."""
    rows = records.groupBy(slot).agg(F.sum(size).alias("bytes")).collect()
    out = [0] * (max((r[slot] for r in rows), default=-1) + 1)
    for r in rows:
        out[r[slot]] = int(r["bytes"])
    return out


def heavy_slots(weights: list[int], n_shards: int) -> list[int]:
    """Slots above a shard's fair share."""
    fair = sum(weights) / n_shards
    return [s for s, w in enumerate(weights) if w > fair and w > 0]


def part_bytes(records: DataFrame, slots: list[int], key: str = "doc_id", size: str = "size", slot: str = "slot") -> dict[int, list[int]]:
    """Bytes of the sub-slots of the slots to be split; fewer slots than there are shards."""
    out = {s: [0] * PARTS for s in slots}
    if slots:
        rows = records.filter(F.col(slot).isin(slots)).groupBy(F.col(slot).alias("s"), part_of(F.col(key)).alias("p")).agg(F.sum(size).alias("bytes"))
        for r in rows.collect():
            out[r.s][r.p] = int(r["bytes"])
    return out


def first_map(weights: list[int], n_shards: int, n_slots: int = SLOTS, parts: dict[int, list[int]] | None = None) -> SlotMap:
    """Heaviest slot first, each to the lightest shard; slots above a fair share are split.

    ``parts``: bytes of the sub-slots of those, taken as equal where not given.
    """
    weights = weights + [0] * (n_slots - len(weights))
    units: list[tuple[float, int, int]] = []
    split = set(heavy_slots(weights, n_shards))
    for s, w in enumerate(weights):
        own = (parts or {}).get(s) or [w / PARTS] * PARTS
        units += [(x, s, i) for i, x in enumerate(own)] if s in split else [(w, s, -1)]
    heap = [(0.0, x) for x in range(n_shards)]
    whole, parts = [0] * n_slots, {s: [0] * PARTS for s in split}
    for w, s, i in sorted(units, key=lambda u: (-u[0], u[1], u[2])):
        load, x = heapq.heappop(heap)
        heapq.heappush(heap, (load + w, x))
        if i < 0:
            whole[s] = x
        else:
            parts[s][i] = x
    return SlotMap(1, n_shards, tuple(whole), {s: tuple(v) for s, v in parts.items()})


def rebalance(old: SlotMap, weights: list[int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots move off the heaviest shards until all are within tolerance.

    With more shards than before, rows move only where a shard is over its fair
    share; with fewer, those of the vanished shards move first.
    """
    n = n_shards or old.n_shards
    weights = weights + [0] * (len(old.shard_of) - len(weights))
    where: dict[tuple[int, int], int] = {}
    mass: dict[tuple[int, int], float] = {}
    for s, x in enumerate(old.shard_of):
        for i, y in enumerate(old.split[s]) if s in old.split else [(-1, x)]:
            where[s, i] = y
            mass[s, i] = weights[s] / PARTS if i >= 0 else weights[s]
    load = [0.0] * n
    homeless = []
    for u, x in where.items():
        if x < n:
            load[x] += mass[u]
        else:
            homeless.append(u)
    fair = sum(mass.values()) / n
    held: dict[int, list[tuple[int, int]]] = {}
    for u, x in where.items():
        held.setdefault(x, []).append(u)
    for x in range(n):
        for u in sorted(held.get(x, []), key=lambda u: (-mass[u], u)):
            if load[x] - fair > tolerance * fair and mass[u] > 0 and load[x] - mass[u] >= fair * (1 - tolerance):
                load[x] -= mass[u]
                homeless.append(u)
    heap = [(w, x) for x, w in enumerate(load)]
    heapq.heapify(heap)
    for u in sorted(homeless, key=lambda u: (-mass[u], u)):
        w, x = heapq.heappop(heap)
        where[u] = x
        heapq.heappush(heap, (w + mass[u], x))
    whole = tuple(where.get((s, -1), 0) for s in range(len(old.shard_of)))
    split = {s: tuple(where[s, i] for i in range(PARTS)) for s in old.split}
    return SlotMap(old.version + 1, n, whole, split)


def assign(records: DataFrame, slots: SlotMap, key: str = "doc_id", slot: str = "slot") -> DataFrame:
    """Adds ``shard`` and ``position``, the gapless number of the row within its shard.

    Rows are numbered within (hash bucket of the key, shard), so the numbering
    of one shard is spread over many tasks; a table of bucket by shard counts
    gives each its offset.
    """
    placed = records.withColumn("shard", slots.shard(F.col(slot), part_of(F.col(key)))).withColumn("__bucket", F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "__bucket").count()
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("shard", "__bucket").orderBy(key)
    return (
        placed.withColumn("__n", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "__bucket"])  # at most shards x BUCKETS rows
        .withColumn("position", (F.col("__offset") + F.col("__n")).cast("long"))
        .drop("__bucket", "__n", "__offset")
    )


def op7_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 16) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    text = whole_text()
    records = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        slot_of(text).alias("__slot"),
    )
    weights = slot_bytes(records, slot="__slot")
    slots = first_map(weights, n_shards, parts=part_bytes(records, heavy_slots(weights, n_shards), slot="__slot"))
    return assign(records, slots, slot="__slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("position").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
