"""Document fingerprints from spot signatures.

A spot signature is a common word (the anchor) with the chain of the next
content words after it; navigation and lists have few anchors, prose has many.
A fingerprint is the set of a text's signatures, as sorted 32-bit hashes.
Likeness of fingerprints is the Jaccard coefficient of the sets.

Near pairs are found without comparing all: sets are partitioned by size so that
sets that could reach the threshold lie in the same or the next partition, and
within a partition only sets that share one of their rarest signatures meet
(two sets this alike cannot differ in all of those). A meeting is pruned by the
sizes of the sets before the sets are intersected. Equal sets are one node.

Defined results for odd input: a null text is empty; a text without words has
an empty set; a text with words but without anchors takes every word as an
anchor; two empty sets are alike (1), an empty and another are not (0); texts of
any length are fingerprinted whole; a null id sorts after all others; of
repeated ids the order is by text; the only row of a table is its own next row;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistra.llm.common import cut, table
from gistra.llm.graph import components

#: The anchors, frequent words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an the this that these those is are was were be been has have had do does did of to in on at by for from with and or as it "
    "le la les un une des du de et est sont dans sur par pour que qui au aux ne pas se ce "
    "der die das den dem ein eine ist sind war und oder im in zu von mit auf für nicht es sich "
    "el los las un una es son y o en con por para del al no su se lo".split()
)
CHAIN = 3
THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")
NO_ID = 1 - (1 << 63)


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct hashes of the spot signatures of a whole text."""
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for w in WORD.findall((text or "").lower()):
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    if not spots:
        spots = [(w, k + 1) for k, w in enumerate(content)]
    digest, join = xxhash.xxh32_intdigest, " ".join
    found = {join((w, *content[k : k + chain])) for w, k in spots}
    return np.unique(np.fromiter(map(digest, found), np.uint32, len(found)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def spelled(sigs: np.ndarray) -> str:
    """A fingerprint as text: 8 hex digits for each signature."""
    return sigs.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "sigs") -> DataFrame:
    """Replaces the text by its signatures, array<long>."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = pa.array([signatures(x.as_py()).astype(np.int64) for x in batch.column(text)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), sigs], names=schema.names)

    return docs.mapInArrow(run, schema)


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(membership, links): (key, set_id) for every row, and (a, b, likeness) between distinct sets.

    A set of n signatures reaches the threshold t with another only if they share
    one of each other's n - ceil(t n) + 1 rarest ones, and only if the other's
    size is between t n and n / t.
    """
    rows = cut(fingerprints(docs.select(F.col(key).alias(key), F.col(text).alias(text)), text).withColumn("set_id", F.xxhash64("sigs")))
    sets = cut(rows.groupBy("set_id").agg(F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")).filter("n > 0"))
    each = sets.select("set_id", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(often, "sig").groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    prefix = ranked.select("set_id", "n", F.explode(F.expr(f"slice(s, 1, n - cast(ceil({threshold} * n - 1e-9) as int) + 1)")).alias("s"))
    prefix = prefix.filter("s.df > 1").select("set_id", "n", F.col("s.sig").alias("sig"))
    part = F.floor(F.log(F.col("n").cast("double")) / -float(np.log(threshold))).cast("int")
    left = prefix.withColumn("part", part)
    right = prefix.withColumn("part", F.explode(F.array(part - 1, part, part + 1))).select(F.col("set_id").alias("other"), F.col("n").alias("m"), "sig", "part")
    met = left.join(right, ["sig", "part"]).filter((F.col("set_id") < F.col("other")) & (F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9))
    met = met.select("set_id", "other").distinct()
    a, b = sets.select("set_id", F.col("sigs").alias("x")), sets.select(F.col("set_id").alias("other"), F.col("sigs").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = both / (F.size("x") + F.size("y") - both)
    links = met.join(a, "set_id").join(b, "other").select(F.col("set_id").alias("a"), F.col("other").alias("b"), alike.alias("likeness")).filter(F.col("likeness") >= threshold)
    return rows.select(key, "set_id"), links


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id): the least key of everything reachable over near pairs."""
    members, links = near_pairs(docs, key, text, threshold)
    labels = components(links)
    named = members.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = named.groupBy("label").agg(F.min(key).alias("class_id"))
    return named.join(least, "label").select(key, "class_id")


def beside_next(docs: DataFrame, run, schema: T.StructType, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs ``run`` over streams of batches (id, text, guest) in descending order of id.

    Rows are dealt into contiguous id ranges, one per task, by cut points taken
    from quantiles of the ids. The first rows of every range are also sent, as
    guests that sort last, to the range before it (those of the first range to
    the last one), so every row has its successor in its own task. Each text is
    shuffled once; the driver handles one id per task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("at"), F.col(text).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(sorted({int(x) for x in rows.approxQuantile("at", [k / parts for k in range(1, parts)], 1 / (8 * parts))})[::-1], dtype=np.int64)

    def bucket(at: pa.Array) -> np.ndarray:
        """0 for ids from the greatest cut point on, and so on down."""
        return np.searchsorted(-cuts, -at.to_numpy(zero_copy_only=False), side="left").astype(np.int32)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            b = bucket(batch.column("at"))
            for x in np.unique(b):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([at[b == x].max()], pa.int64())], names=["bucket", "head"])

    found = rows.select("at").mapInArrow(heads, "bucket int, head long").groupBy("bucket").agg(F.max("head").alias("head")).orderBy("bucket").collect()
    buckets = [r.bucket for r in found]
    to = {r.head: buckets[k - 1] for k, r in enumerate(found)}  # k = 0: the last range
    wanted = np.array(sorted(to), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "at", "text", "guest", "bucket"]
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(n, bool)), pa.array(bucket(batch.column("at")))], names=names)
            at = batch.column("at").to_numpy(zero_copy_only=False)
            head = np.isin(at, wanted)
            if head.any():
                part = batch.filter(pa.array(head))
                there = np.array([to[x] for x in at[head]], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.ones(part.num_rows, bool)), pa.array(there)], names=names)

    dealt = rows.mapInArrow(deal, "id long, at long, text string, guest boolean, bucket int")
    own = dealt.repartitionById(max(parts, len(cuts) + 1), F.col("bucket")).sortWithinPartitions("guest", F.col("at").desc(), F.coalesce("text", F.lit("")))
    return own.select("id", "text", "guest").mapInArrow(run, schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside its edited text and its next document."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        before = None
        for batch in batches:
            for key, text, guest in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                own = signatures(text)
                if before is not None:
                    k, t, s = before
                    half = len(t) // 2
                    edited = t[: len(t) - half] + text[:half]
                    e = signatures(edited)
                    out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), spelled(s), spelled(e), likeness(s, e), likeness(s, own)))
                if guest:
                    before = None
                    break
                before = (key, text, own)
                if len(out) >= 256:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return beside_next(table(spark, sf_dir, "documents"), run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*rows), schema.fields)], names=schema.names)
