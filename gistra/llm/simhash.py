"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

Fingerprints of 64 bits link at two or fewer differing bits. Cut into two
segments of 32 bits, at least one segment of a linked pair differs by at most
one bit. Each distinct fingerprint is indexed under the 32 one-wildcard variants
of both segments (one bit cleared, its place part of the key); linked pairs meet
under a common key, and the pairs that meet are verified.

Keys with few fingerprints are compared pair by pair. A key shared by more than
``CROWD`` fingerprints (a large group of near copies) is not: its fingerprints
are indexed once more, under their whole value and the 64 values one bit away.
Two fingerprints have such a value in common exactly if they differ by at most
two bits, at most 65 fingerprints share one, and linking each to the least of
them keeps every link's connection without pairs. So no group, however large,
is compared with itself or gathered in one task, and no link is lost.

Exact copies share a fingerprint and are one node from the start. Links are
reduced to components with checkpointed label passing.

Fingerprints are computed per row in Arrow batches; the rest is DataFrame
operations.

Defined results for odd input: null and empty texts, and texts of white space
only, have fingerprint zero and link like any other; texts with fewer than
three words have one shingle; a null id counts as greater than any id and a
component of such rows only has a null component id; repeated rows link to each
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistra.llm.common import cut, table
from gistra.llm.graph import components

SHINGLE = 3
SEED = 42
#: Fingerprints under one key that are still compared pair by pair.
CROWD = 24
NO_ID = (1 << 63) - 1


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, SEED) for s in shingles], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit value whose bits are set in over half the hashes; zero of none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Replaces the text column by its fingerprint, as a signed long."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*keep, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(fps)], names=schema.names)

    return docs.mapInArrow(run, schema)


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b), a < b, that connect the distinct fingerprints of ``nodes(fp)``.

    Under keys with few members every link within two bits is there; crowded
    keys contribute links to the least member of each shared neighbour value.
    """
    wild = "transform(sequence(0, 31), i -> shiftleft({part}L, 37) | shiftleft(bigint(i), 32) | ({seg} & ~shiftleft(1L, i)))"
    high, low = "(shiftrightunsigned(fp, 32) & 4294967295L)", "(fp & 4294967295L)"
    keyed = nodes.select("fp", F.explode(F.expr(f"concat({wild.format(part=0, seg=high)}, {wild.format(part=1, seg=low)})")).alias("key"))
    groups = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    two = groups.filter("n = 2").select("a", "b")
    # a pair meets under 32 keys where one half is equal
    more = keyed.join(groups.filter("n > 2").select("key", "n"), "key")
    few = (
        more.filter(F.col("n") <= crowd).groupBy("key").agg(F.collect_list("fp").alias("fps"))
        .select(F.explode(F.expr("flatten(transform(fps, x -> transform(filter(fps, y -> y > x and bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))))")).alias("p"))
        .select("p.a", "p.b")
    )
    crowded = more.filter(F.col("n") > crowd).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("value"))
    balls = near.groupBy("value").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    star = balls.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return two.filter("bit_count(a ^ b) <= 2").union(few).union(star).distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(key, fp, component): the least key of everything reachable over links."""
    rows = cut(fingerprints(docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)), text))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = F.min(F.coalesce(key, F.lit(NO_ID))).alias("least")
    nodes = cut(rows.groupBy("fp").agg(least).repartition(parts, "fp"))  # each will become 64 rows, so many small tasks
    labels = components(links(nodes.select("fp"), crowd))
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    roots = rooted.groupBy("label").agg(F.min("least").alias("component"))
    named = rooted.select("fp", "label").join(roots, "label").select("fp", "component")
    return rows.join(named, "fp").select(key, "fp", F.when(F.col("component") < NO_ID, F.col("component")).alias("component"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the least key, with all its columns.

    Of repeated rows of that key one stays; of a group without keys one row does.
    """
    groups = near_groups(docs, key, text)
    stay = groups.filter(F.col(key) == F.col("component")).select(F.col(key).alias("__key")).distinct()
    named = docs.join(stay, docs[key] == F.col("__key"), "left_semi").dropDuplicates([key])
    bare = docs.filter(F.col(key).isNull())
    if bare.limit(1).count() == 0:
        return named
    lone = groups.filter(F.col(key).isNull() & F.col("component").isNull()).select("fp").distinct()
    # rows without a key: fingerprints again, one row of each group without keys
    fps = fingerprints(bare.withColumn("__text", F.col(text)), "__text", "__fp")
    return named.unionByName(fps.join(lone, fps["__fp"] == lone["fp"], "left_semi").dropDuplicates(["__fp"]).drop("__fp"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"),
    )
