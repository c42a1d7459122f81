import random

import pytest
import xxhash

from gistra.llm import graph, simhash


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_plain_one():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É é\x85x y z w", "x " * 5000]
    texts += [" ".join(rng.choice(["foo", "Bar", "ß", "qux"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]


@pytest.mark.parametrize("crowd", [2, 24])
def test_links_connect_what_all_pairs_connect(spark, crowd):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(80)}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(60):
            at2 = at
            for b in rng.sample(range(12), rng.randint(0, 4)):
                at2 ^= 1 << b
            values.add(at2)
            values.add(at2 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(map(signed, values))
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = simhash.links(df, crowd)
    got = {(r.a, r.b) for r in found.collect()}
    assert got <= set(pairs)
    want = roots(values, pairs)
    assert roots(values, got) == want
    labels = {r.node: r.label for r in graph.components(found).collect()}
    assert all(labels.get(v, v) == want[v] for v in values)


def test_long_chain(spark):
    n = 12
    order = list(range(n))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {r.label for r in graph.components(df).collect()} == {0}


def test_odd_rows(spark):
    long = "word " * 40000
    rows = [(5, None, 1), (3, "", 1), (None, "solo text here now", 1), (7, "same text again and again", 1), (9, "same text again and again", 2), (9, "same text again and again", 2), (1, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component) for r in simhash.near_groups(df).collect()}
    assert {(5, 3), (3, 3), (7, 7), (9, 7)} <= got
    assert (None, None) in got
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 7]


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_cost_rows_in_proportion_to_links(spark, monkeypatch):
    rng = random.Random(3)
    order = rng.sample(range(10**6), 40)
    pairs = list(zip(order, order[1:])) + [(-1, -1), (-5, -4), (-4, -4)]
    rows, write = [], graph.written

    def counted(df):
        out = write(df)
        rows.append(out[0].count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots({x for p in pairs for x in p}, pairs)
    assert sum(rows) <= 10 * len(pairs)
