import random

import pytest

from gistra.llm import copies


def brute(texts, threshold=0.8):
    """The least key of everything reachable over pairs, from all pairs of shingle sets."""

    def grams(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {k: grams(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= threshold * len(x | y) - 1e-9 and (x or y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in keys}


def made():
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(3000)
    line = " ".join(word() for _ in range(40))
    texts = {1: "", 2: None, 3: " ", 4: "one two", 5: "One  two", 6: "one three"}
    for k in range(12):  # copies with ever more edits, some over and some under the threshold
        base = [word() for _ in range(rng.choice((12, 60, 200)))]
        for n in range(10):
            t = list(base)
            for _ in range(rng.randrange(1 + len(t) // 20)):
                t[rng.randrange(len(t))] = word()
            texts[100 + 20 * k + n] = " ".join(t)
    for n in range(60):  # one common line in texts that are otherwise different
        texts[1000 + n] = " ".join([line, *(word() for _ in range(rng.randrange(80)))])
    base = [word() for _ in range(120)]
    for n in range(60):  # a large group, of which many are far from any one member
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = word()
        texts[2000 + n] = " ".join(t)
    return texts


@pytest.mark.parametrize("crowd", [24, 3])
def test_groups_are_those_of_all_pairs(spark, crowd):
    texts = made()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component for r in copies.near_groups(docs, crowd=crowd).collect()}
    assert got == brute(texts)


def test_stage_drops_what_five_words_call_copies(spark):
    import corpus_pipeline

    texts = made()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(brute(texts).values())


def test_rows_without_a_key(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (3, "k l m n o"), (3, "k l m n o")]
    got = copies.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a b c d e f"), (0, "q r s t u v"), (3, "k l m n o")]


def test_sketches_never_say_more_than_sets():
    rng = random.Random(9)
    for n in (0, 3, 400, 520, 1500, 9000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = base[: n - n // 9] + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(1 + n // 5))]
        x, y = copies.shingles(" ".join(base)), copies.shingles(" ".join(other))
        p, q = sorted((copies.sketch(x), copies.sketch(y)), key=len)
        q = q.reshape(-1, len(p))
        folded = q[0].copy()
        for part in q[1:]:
            folded ^= part
        assert sum(int(v).bit_count() for v in (p ^ folded).view("uint64")) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_dedup_without_telling_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(copies, "TOLD", 0)
    texts = made()
    docs = spark.createDataFrame(list(texts.items()) + [(101, "again")], "doc_id long, text string")
    want = set(brute(texts).values())
    assert {r.doc_id for r in copies.dedup(docs).collect()} >= want


def test_fingerprints_of_operator_2_link_first(spark, monkeypatch):
    rng = random.Random(11)
    texts = {}
    for k in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        texts[2 * k] = " ".join(base)
        texts[2 * k + 1] = " ".join(base[:-1] + ["end"] * (k % 2) + [base[-1]])  # a set more, or the same set
    fps = {d: copies.majority(copies.shingles(t)) for d, t in texts.items()}
    want = {d: d - 1 if d % 2 and (fps[d] ^ fps[d - 1]).bit_count() <= 2 else d for d in texts}
    assert sum(want[d] != d and texts[d] != texts[d - 1] for d in texts) > 1
    met = copies._met

    def nothing(nodes, crowd, threshold):
        pairs, full = met(nodes, crowd, threshold)
        return pairs.limit(0), full.limit(0)

    monkeypatch.setattr(copies, "_met", nothing)  # without the search among the sets
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component for r in copies.near_groups(docs).collect()} == want


def test_rest_of_full_keys_makes_each_pair_once(spark, monkeypatch):
    rng = random.Random(12)
    base, sets = [f"w{k}" for k in range(150)], []
    for n in range(100):  # more than a block; every other one has edits, so that some pairs are possible and some not
        words = list(base)
        for _ in range(rng.randrange(1, 5) if n % 2 else 1):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        sets.append(copies.shingles(" ".join([*words, *base[: n % 3 * 8]])))
    ids, n, w = [copies.set_id(s) for s in sets], [len(s) for s in sets], [copies.sketch(s) for s in sets]
    label = {i: ids[0] for k, i in enumerate(ids) if k % 4 == 0} | {i: ids[1] for k, i in enumerate(ids) if k % 8 == 1}
    under = {key: [k for k in range(100) if key < 6 or rng.random() < 0.7] for key in range(12)}  # copies share many keys
    apart = lambda a, b: label.get(ids[a], ids[a]) != label.get(ids[b], ids[b])
    fits = lambda a, b: min(n[a], n[b]) >= 0.8 * max(n[a], n[b]) and sum(int(v).bit_count() for v in (w[a] ^ w[b]).view("uint64")) <= (n[a] + n[b]) / 9 + 1e-6
    met = [(a, b) for members in under.values() for a in members for b in members if a < b and apart(a, b) and fits(a, b)]
    want = sorted({tuple(sorted((ids[a], ids[b]))) for a, b in met})
    assert 100 < len(want) < len(met) / 5 and len(want) < sum(apart(a, b) for a in range(100) for b in range(a))
    full = spark.createDataFrame([(key, ids[k], n[k]) for key, members in under.items() for k in members], "sig long, set_id long, n int")
    labels = spark.createDataFrame(list(label.items()), "node long, label long")
    nodes = spark.createDataFrame([(ids[k], n[k], w[k].tolist()) for k in range(100)], "set_id long, n int, w array<long>")
    real, made = type(full).mapInArrow, []
    monkeypatch.setattr(type(full), "mapInArrow", lambda *args: made.append(real(*args)) or made[-1])
    got = copies._outside(full, labels, nodes, 0.8)
    assert sorted((r.a, r.b) for r in got.collect()) == want
    assert made[-1].count() == len(want)  # no pair again under another key, or from the other side
    copies._outside(full, labels, nodes, 0.8, nearest=True)
    near = [(r.a, r.b) for r in made[-1].collect()]
    assert set(near) <= set(want) and 50 < len(near) < len(want)
    assert len(set(near)) == len(near)
