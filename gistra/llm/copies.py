"""Near copies: documents whose sets of five-word shingles have a Jaccard coefficient of at least 0.8.

The search starts with operator 2: each set has a fingerprint of 64 bits, and
the operator's deletion variants find the fingerprints within two bits, from
which verified pairs come. Such fingerprints are far closer than this
similarity asks (see the README), so what still lies in different classes is
searched among the sets themselves, and no link is lost. Under any fixed order of
all shingles, two sets that reach the threshold t share one of each other's first
n - ceil(t n) + 1, so sets are indexed under those only. The order is by hash,
with shingles that a sample of the documents shows to be common put last; the
order decides how many sets meet by chance and never which are found. What is
common is told to tasks by a bit table of fixed size. Equal sets are one node
from the start. Sets that meet are pruned by size and by a sketch that holds
the parity of the number of members in each of about three parts a member:
sketches differ in no more bits than sets do in members, also where the wider of
two is folded to the other's width. The rest are compared whole, from the text.

Sets under a key with few members meet pair by pair. A fuller key (a large
group of near copies) only has to be connected: its members meet one of them,
another one under each key. Of all who meet across the classes of the
fingerprints, each set is first compared with the one whose sketch is nearest.
Then only what still lies in different classes is compared: first the other
pairs that met, then the members of full keys
outside the key's largest class with those of other classes: each with the
nearest of them as long as that links any, and all that are apart by then at the end.
Members of one class need no
comparing, so a group of copies costs its size.

Defined results for odd input: null and empty texts, and texts of white space
only, have the empty set and are copies of each other; texts with fewer than
five words have one shingle; a null key counts as greater than any key; an
empty table gives an empty result; other columns are ignored by ``near_groups``
and kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistra.llm.common import cut, tidy, written
from gistra.llm.graph import components
from gistra.llm.simhash import links as fingerprint_links
from gistra.llm.simhash import majority

SHINGLE = 5
THRESHOLD = 0.8
#: Sets under one key that are still compared pair by pair.
CROWD = 16
#: Share of documents looked at for common shingles, and in how many of those one has to be.
SAMPLE, LEAST = 0.1, 3
#: The bit table has 2 ** TABLE bits, of which about MARKED are set at most.
TABLE, MARKED = 24, 1 << 21
NO_KEY = (1 << 63) - 1
#: Least and most bits of a sketch, both powers of two.
NARROW, WIDE = 1 << 10, 1 << 17
#: As many documents at most are told to all tasks (8 bytes each), more are joined.
TOLD = 1_000_000
#: Members of a full key in a block.
BLOCK = 64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64).view(np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    last = len(words) - size + 1
    h = np.zeros(last, np.uint64)
    for k in range(size):
        h += w[k : last + k] * ODD[k % len(ODD)]
        h ^= h >> np.uint64(29)
    h *= ODD[1]
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def set_id(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes(), 7)], np.uint64).view(np.int64)[0])


def _kept(n: int, threshold: float) -> int:
    return n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0


def prefix(s: np.ndarray, threshold: float, common: np.ndarray) -> np.ndarray:
    """The shingles that a set is indexed under: 63 bits each, negative if not common, in ascending order."""
    low = s & NO_KEY
    at = low & ((1 << TABLE) - 1)
    late = (common[at >> 6] >> (at & 63)) & 1 == 1
    return np.sort(np.where(late, low, low | ~NO_KEY))[: _kept(len(s), threshold)]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of members in twice as many parts as members, or up to four times, as 64-bit words."""
    width = min(WIDE, max(NARROW, 1 << (2 * len(s) - 1).bit_length())) if len(s) else NARROW
    odd = np.bincount((s >> 40) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def _sets(docs: DataFrame, key: str, text: str, threshold: float, common: np.ndarray | None) -> DataFrame:
    """(key, set_id, n, s, w, fp) of every row: s is the prefix, w the sketch, fp the fingerprint; without a table of common shingles s is the set."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(x.as_py()) for x in part.column(1)]
                ids, n = pa.array(map(set_id, sets), pa.int64()), pa.array(map(len, sets), pa.int32())
                if common is None:
                    lists, bits, fps = pa.array(sets, kind), pa.nulls(len(sets), kind), pa.nulls(len(sets), pa.int64())
                else:
                    lists, bits = pa.array([prefix(s, threshold, common) for s in sets], kind), pa.array(map(sketch, sets), kind)
                    fps = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, n, lists, bits, fps], names=["key", "set_id", "n", "s", "w", "fp"])

    return _narrow(docs, key, text).mapInArrow(run, "key long, set_id long, n int, s array<long>, w array<long>, fp long")


def common_shingles(docs: DataFrame, key: str, text: str, sample: float = SAMPLE, least: int = LEAST) -> np.ndarray:
    """A bit table of the shingles that many sampled documents have, by the low bits of their hashes.

    Of more than MARKED common shingles, those found less often (by powers of
    two) are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(x.as_py()) & NO_KEY for x in batch.column(1).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["sig"])

    table = np.zeros(1 << (TABLE - 6), np.int64)
    seen = _narrow(docs.sample(sample, 5), key, text).mapInArrow(run, "sig long")
    often = cut(seen.groupBy("sig").agg(F.count("*").alias("c")).filter(F.col("c") >= least).withColumn("power", F.floor(F.log2("c")).cast("int")))
    total, border = 0, 63
    for power, c in sorted(((r.power, r.c) for r in often.groupBy("power").agg(F.count("*").alias("c")).collect()), reverse=True):  # 63 rows at most
        total += c
        if total > MARKED:
            break
        border = power
    at = F.col("sig").bitwiseAND((1 << TABLE) - 1)
    words = often.filter(F.col("power") >= border).groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sig & 63 as int))")).alias("bits"))
    got = words.toArrow()  # as many rows as the table has words at most
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return table


def _possible(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, differ): the pairs whose sketches don't differ in more bits than sets at the threshold may in members."""
    x = nodes.select(F.col("set_id").alias("a"), F.col("n"), F.col("w").alias("x"))
    y = nodes.select(F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("w").alias("y"))
    fold = "if(size({0}) > size({1}), transform(sequence(0, size({1}) - 1), i -> aggregate(sequence(i, size({0}) - 1, size({1})), 0L, (t, j) -> t ^ {0}[j])), {0})"
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", F.expr(fold.format("x", "y")).alias("x"), F.expr(fold.format("y", "x")).alias("y"))
    met = met.withColumn("differ", F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (t, c) -> t + c)"))
    return met.filter(F.col("differ") <= (F.col("n") + F.col("m")) * ((1 - threshold) / (1 + threshold)) + 1e-6).select("a", "b", "differ")


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each set, the pair with the one whose sketch is nearest."""
    both = pairs.select(F.col("a").alias("set_id"), "a", "b", "differ").union(pairs.select("b", "a", "b", "differ"))
    return both.groupBy("set_id").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets in different classes."""
    x, y = labels.select(F.col("node").alias("a"), F.col("label").alias("p")), labels.select(F.col("node").alias("b"), F.col("label").alias("q"))
    named = pairs.select("a", "b").join(x, "a", "left").join(y, "b", "left")
    return named.filter(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; sets are made again of the texts of the pairs."""
    wanted = cut(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct().join(nodes.select("set_id", "least"), "set_id"))
    n = wanted.count()
    if not n:
        return pairs.select("a", "b")
    near = F.broadcast if n <= TOLD else lambda df: df
    # texts by key; rows without a key are looked at all
    texts = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    found = texts.join(near(wanted.select(F.col("least").alias("__id"))), "__id", "left_semi")
    if not wanted.filter(F.col("least") == NO_KEY).isEmpty():
        found = found.union(texts.filter("__id is null"))
    whole = _sets(found, "__id", "__text", threshold, None).select("set_id", "s")
    sets = whole.join(near(wanted.select("set_id")), "set_id", "left_semi").groupBy("set_id").agg(F.max("s").alias("s"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(sets.select(F.col("set_id").alias("b"), F.col("s").alias("y")), "b").join(sets.select(F.col("set_id").alias("a"), F.col("s").alias("x")), "a")
    out = cut(met.filter(both >= threshold * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"))
    tidy(docs.sparkSession)
    return out


def _fit(n: Column, m: Column, threshold: float) -> Column:
    return F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _outside(full: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: float, nearest: bool = False) -> DataFrame:
    """Pairs of the members of full keys outside their key's largest class and members of other classes.

    Members are dealt to blocks of about BLOCK; block meets block, and only the
    pairs that size and sketch allow come out. Copies share many full keys: a pair
    comes out under the least one that both have, and once. With ``nearest`` only
    each outside member's pair with the nearest sketch comes out, one a key as a rule.
    """
    named = cut(full.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id")))
    classes = named.groupBy("sig", "label").agg(F.count("*").alias("c"))
    large = classes.groupBy("sig").agg(F.max_by("label", F.struct("c", "label")).alias("large"), F.sum("c").alias("all"), F.max("c").alias("most"), F.count("*").alias("classes"))
    rest = cut(named.join(large.filter("classes > 1"), "sig"))
    # sets of different classes meet under every full key of both, as all such keys have several classes
    keys = rest.groupBy("set_id").agg(F.collect_set("sig").alias("keys")).join(nodes.select("set_id", "w"), "set_id")
    rest = cut(rest.join(keys, "set_id").withColumn("less", F.expr("filter(keys, k -> k < sig)")).drop("keys"))

    def blocks(rows: DataFrame, size: str, out: str) -> DataFrame:
        block = F.pmod(F.xxhash64("set_id"), F.ceil(F.expr(size) / BLOCK).cast("long"))
        member = F.struct("set_id", "n", "label", (F.col("label") == F.col("large")).alias("large"), "w", "less")
        return rows.groupBy("sig", block.alias(f"{out}_block")).agg(F.collect_list(member).alias(out))

    # all blocks that an outside one meets follow each other
    met = blocks(rest.filter("label <> large"), "all - most", "xs").join(blocks(rest, "all", "ys"), "sig").select("sig", "xs_block", "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, xs, best = None, {}, {}
        for batch in batches:
            out = []
            for sig, block, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
                if at != (sig.as_py(), block.as_py()):
                    out += best.values()
                    at, xs, best = (sig.as_py(), block.as_py()), _block(x), {}
                for differ, a, b in _between(xs, _block(y), threshold):
                    if not nearest:
                        out += ((0, a, other) for other in b.tolist())
                    else:
                        k = np.lexsort((b, differ))[0]
                        best[a] = min(best.get(a, (NO_KEY, 0, 0)), (int(differ[k]), a, int(b[k])))
            yield _ends(out)
        yield _ends(best.values())

    return met.mapInArrow(run, "a long, b long")


def _ends(pairs: Iterable[tuple[int, int, int]]) -> pa.RecordBatch:
    ends = [(a, b) if a < b else (b, a) for _, a, b in pairs]
    return pa.RecordBatch.from_arrays([pa.array([e[side] for e in ends], pa.int64()) for side in (0, 1)], names=["a", "b"])


def _block(members: pa.ListScalar) -> dict[int, tuple[np.ndarray, ...]]:
    """(set ids, sizes, labels, whether in the key's largest class, lists of lesser full keys, sketches as rows of a matrix) of a block's members, by width of sketch."""
    rows = members.values
    ids, n, labels, large, w, less = (rows.field(k) for k in ("set_id", "n", "label", "large", "w", "less"))
    width, words = pa.compute.list_value_length(w).to_numpy(), w.flatten().to_numpy().view(np.uint64)
    starts = np.cumsum(width) - width
    fixed = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, n, labels, large)]
    lists = np.empty(len(ids), object)
    lists[:] = np.split(less.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(less).to_numpy())[:-1])
    return {int(k): (*(x[width == k] for x in (*fixed, lists)), words[starts[width == k][:, None] + np.arange(k)]) for k in np.unique(width)}


def _between(xs: dict[int, tuple[np.ndarray, ...]], ys: dict[int, tuple[np.ndarray, ...]], threshold: float) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(bits that differ, a, ids b) for the members a of an outside block and b of a block that lie in different classes, that size and sketch allow, and that have no lesser full key in common.

    Members outside the largest class are in blocks of both sides; such a pair comes out at its lesser id.
    """
    for p, (a, n, la, _, kx, x) in xs.items():
        for q, (b, m, lb, inside, ky, y) in ys.items():
            keys, owner = np.concatenate(ky), np.repeat(np.arange(len(ky)), [len(k) for k in ky])
            least = min(p, q)
            x_folded, y_folded = (np.bitwise_xor.reduce(z.reshape(len(z), -1, least), axis=1) for z in (x, y))
            for i in range(len(a)):  # a member against a block: as much memory as the block
                at = np.flatnonzero((lb != la[i]) & ((b > a[i]) | (inside == 1)) & (np.minimum(n[i], m) >= threshold * np.maximum(n[i], m) - 1e-9))
                if len(at):
                    differ = np.bitwise_count(x_folded[i] ^ y_folded[at]).sum(axis=1, dtype=np.int64)
                    near = (differ <= (n[i] + m[at]) * ((1 - threshold) / (1 + threshold)) + 1e-6) & ~np.isin(at, owner[np.isin(keys, kx[i])])
                    if near.any():
                        yield differ[near], int(a[i]), b[at[near]]


def _met(nodes: DataFrame, crowd: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare, and the members (sig, set_id, n) of full keys."""
    at = nodes.select("set_id", F.explode("s").alias("sig"))
    sizes = at.groupBy("sig").agg(F.count("*").alias("members")).filter("members > 1")
    at = cut(at.join(sizes, "sig").join(nodes.select("set_id", "n"), "set_id"))
    few = (
        at.filter(F.col("members") <= crowd).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("set_id", "n"))).alias("m"))
        .select(F.explode(F.expr(
            f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) - 1e-9), y -> struct(x.set_id as a, y.set_id as b))))"
        )).alias("p"))
        .select("p.a", "p.b")
    )
    full = at.filter(F.col("members") > crowd).select("sig", "set_id", "n")
    mid = full.groupBy("sig").agg(F.max_by(F.struct("set_id", "n"), F.xxhash64("sig", "set_id")).alias("mid"))
    star = full.join(mid, "sig").filter((F.col("set_id") != F.col("mid.set_id")) & _fit(F.col("n"), F.col("mid.n"), threshold))
    return cut(few.union(star.select(*_ordered(F.col("set_id"), F.col("mid.set_id")))).distinct()), full


def _close(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all sets whose fingerprints operator 2 links, through the least set of each fingerprint."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = nodes.select("fp", "set_id")
    least = cut(of.groupBy("fp").agg(F.min("set_id").alias("a")).repartition(parts, "fp"))  # each will become 64 rows, so many small tasks
    equal = of.join(least, "fp").filter(F.col("set_id") != F.col("a")).select("a", F.col("set_id").alias("b"))
    linked = fingerprint_links(least.select("fp"))
    ends = linked.join(least.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    return cut(equal.union(ends.select(*_ordered(F.col("x"), F.col("y")))))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """(key, set_id, component, label): the least key of everything reachable over pairs at the threshold."""
    spark = docs.sparkSession
    rows = cut(_sets(docs, key, text, threshold, common_shingles(docs, key, text)))
    tidy(spark)
    # rows of a set have the same n, s, w and fp
    nodes = rows.groupBy("set_id").agg(F.min(F.coalesce("key", F.lit(NO_KEY))).alias("least"), *(F.max(c).alias(c) for c in ("n", "s", "w", "fp")))
    # the method of operator 2 first; each set is compared with the one nearest to it of those whose fingerprints link
    close = cut(_possible(_close(nodes), nodes, threshold))
    tidy(spark)
    first = cut(_nearest(close))
    links = _verified(first, nodes, docs, key, text, threshold)
    labels = components(links)
    pairs, full = _met(nodes, crowd, threshold)
    tidy(spark)
    pairs = cut(_possible(pairs, nodes, threshold))

    def joined(rest: DataFrame) -> bool:
        """Whether the pairs that were not compared before link anything."""
        nonlocal first, labels
        more, _ = written(rest.join(first, ["a", "b"], "left_anti"))
        if more.isEmpty():
            return False
        found = _verified(more, nodes, docs, key, text, threshold)
        first = first.union(more)
        if found.isEmpty():
            return False
        # a class is told by its labels, not by its links again
        labels = components(labels.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")).union(found))
        return True

    # then across the classes there are by then: the nearest that met, the other pairs
    joined(_nearest(pairs.join(_apart(pairs, labels), ["a", "b"], "left_semi")))
    joined(_apart(pairs.union(close).select("a", "b").distinct(), labels))
    # the rest of full keys, the nearest as long as they link, so that of a class few pairs are left for the end
    while joined(_outside(full, labels, nodes, threshold, nearest=True).distinct()):
        tidy(spark)
    joined(_outside(full, labels, nodes, threshold))
    tidy(spark)
    rooted = rows.select("key", "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    roots = rooted.groupBy("label").agg(F.min(F.coalesce("key", F.lit(NO_KEY))).alias("component"))
    return rooted.join(roots, "label").select(F.col("key").alias(key), "set_id", F.when(F.col("component") < NO_KEY, F.col("component")).alias("component"), "label")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the least key, with all its columns.

    Of repeated rows of that key one stays; of a group without keys one row does.
    """
    groups = cut(near_groups(docs, key, text))
    stays = F.col(key) == F.col("component")
    each = groups.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n"))
    other = cut(each.filter("not stays or n > 1"))
    again = other.filter("stays").select("__key")
    same_key = docs[key] == F.col("__key")
    if other.count() <= TOLD:
        named = docs.filter(F.col(key).isNotNull()).join(F.broadcast(other.select("__key")), same_key, "left_anti")
        if not again.isEmpty():
            named = named.unionByName(docs.join(F.broadcast(again), same_key, "left_semi").dropDuplicates([key]))
    else:
        named = docs.join(each.filter("stays").select("__key"), same_key, "left_semi").dropDuplicates([key])
    bare = docs.filter(F.col(key).isNull())
    if bare.limit(1).count() == 0:
        return named
    lone = groups.filter(F.col(key).isNull() & F.col("component").isNull()).groupBy("label").agg(F.min("set_id").alias("__set"))
    mark = F.udf(lambda t: set_id(shingles(t)), "long")
    left = bare.withColumn("__set", mark(F.col(text).cast("string"))).join(lone.select("__set"), "__set", "left_semi")
    return named.unionByName(left.dropDuplicates(["__set"]).drop("__set"))
