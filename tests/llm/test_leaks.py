import random

from gistra.llm import decontaminate as D


def five(words, size=5):
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def test_edited_copies_are_those_of_all_pairs(spark):
    """One edit in a short answer leaves most of an item's shingles; brute force over whole texts finds the same."""
    rng = random.Random(8)
    word = lambda: "v%d" % rng.randrange(400)
    items = {i: " ".join([*(word() for _ in range(rng.randint(20, 50))), "end?", *(word() for _ in range(rng.randint(1, 5)))]) for i in range(30)}
    docs = {}
    for d in range(240):
        copy = items[d % 30].split()
        at = len(copy) - 1 - rng.randrange(4) if d % 2 else rng.randrange(len(copy))
        for _ in range(d // 60):
            copy[at : at + rng.randrange(2)] = [word()] * rng.randrange(3)
            at = rng.randrange(len(copy))
        docs[d] = " ".join([*(word() for _ in range(rng.randrange(300))), *copy, *(word() for _ in range(rng.randrange(300)))])
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = set()
    for d, t in docs.items():
        seen = five(D.words_of(t))
        for i, x in items.items():
            whole, parts = five(D.words_of(x)), [five(p) for p in D.parts_of(x)]
            if len(whole & seen) >= 0.8 * len(whole) or all(len(p & seen) >= 0.8 * len(p) for p in parts):
                want.add((d, i))
    assert got == want


def test_short_items_inside_long_texts(spark):
    items = {1: "Capital of Peru?", 2: "Lima", 3: "水の沸点は何度ですか？百度です。", 4: "two short words now"}
    docs = {
        1: "filler words " * 300 + "the capital of Peru, they say " + "more words " * 200,
        2: "filler words " * 300 + "of Peru the capital " + "two short words later " * 30,
        3: "x " * 200 + "試験です水の沸点は何度ですか？百度です。終わり" + " y" * 200,
        4: "they left Lima, two short words. now it ends " + "z " * 400,
    }
    frames = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(*frames).collect()) == [(1, 1), (3, 3), (4, 2), (4, 4)]
    assert [r.doc_id for r in D.clean(*frames).collect()] == [2]


def test_walk_finds_every_item_above_the_threshold():
    """Block-max WAND against plain sums of impacts, with common terms and repeated items."""
    import numpy as np

    rng = random.Random(5)
    words = ["c%d" % k for k in range(12)] + ["r%d" % k for k in range(300)]
    pick = lambda: words[min(int(rng.expovariate(0.02)), 311)]
    items = [(i, " ".join(pick() for _ in range(rng.randint(3, 40)))) for i in range(90)] + [(90, "c0 c1 c2"), (91, "c0 c1 c2")]
    df = {}
    for _, t in items:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    index = D.Index(items, df, len(items), sum(len(t.split()) for _, t in items) / len(items))
    passages = []
    for _ in range(200):
        base = rng.choice(items)[1].split()
        passages.append(set(rng.sample(base, rng.randint(1, len(base)))) | {pick() for _ in range(rng.randrange(60))})
    pairs = np.array(sorted((w, index.terms[t]) for w, p in enumerate(passages) for t in p if t in index.terms))
    got = {(w, i): round(s, 9) for w, i, s in index.retrieve(pairs[:, 0], pairs[:, 1], len(passages))}
    want = {}
    for w, p in enumerate(passages):
        for t in p & index.terms.keys():
            k = index.terms[t]
            for at in range(index.start[k], index.start[k + 1]):
                want[w, int(index.item[at])] = want.get((w, int(index.item[at])), 0) + float(index.impact[at])
    assert got == {k: round(s, 9) for k, s in want.items() if s >= D.THRESHOLD - 1e-9}
    assert len(got) > 100


def test_many_indexes_find_what_one_does(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join("x%d" % rng.randrange(200) for _ in range(30))) for i in range(50)]
    docs = [(d, " ".join(["y"] * d + [items[d % 50][1]])) for d in range(60)] + [(99, items[3][1] + " " + items[4][1])]
    told = lambda: sorted(map(tuple, D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()))
    one = told()
    monkeypatch.setattr(D, "ITEMS", 7)
    assert told() == one and len(one) == 62
