import hashlib
import random

import numpy as np

from gistra.llm import spotsigs as G


def plain(text):
    words, content, out = G.WORD.findall((text or "").lower()), [], set()
    content = [w for w in words if w not in G.ANCHORS]
    k, some = 0, any(w in G.ANCHORS for w in words)
    for w in words:
        if w in G.ANCHORS:
            out.add((w, *content[k : k + G.CHAIN]))
        else:
            k += 1
            if not some:
                out.add((w, *content[k : k + G.CHAIN]))
    return out


def test_signatures():
    texts = [None, "", "!!", "lone", "no anchors here whatsoever", "At a rally to kick off a weeklong campaign for the South Carolina primary, he said", "the the the", "der Hund und die Katze " * 40]
    for t in texts:
        assert len(G.signatures(t)) == len(plain(t))
        assert (G.parsed(G.spelled(G.signatures(t))) == G.signatures(t)).all()


def test_likeness():
    a, b = G.signatures("the cat sat on the mat and the dog ran to the door"), G.signatures("the cat sat on the mat and the dog ran to a window")
    assert G.likeness(a, a) == 1 and 0 < G.likeness(a, b) < 1
    empty = np.zeros(0, np.uint32)
    assert G.likeness(empty, empty) == 1 and G.likeness(empty, a) == 0


def docs(n, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}x" for i in range(400)] + sorted(G.ANCHORS)[:30] * 4
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    near = []
    for t in base[: n // 3]:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return base + near + base[:5]


def test_near_classes_are_those_of_all_pairs(spark):
    texts = docs(60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = [G.signatures(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if G.likeness(sigs[i], sigs[j]) >= 0.8 - 1e-12 and (len(sigs[i]) or len(sigs[j]) == 0):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = {r.doc_id: r.class_id for r in G.near_classes(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_query_is_brute_force(spark, data):
    rows = {r.doc_id: r for r in G.op4_fingerprints(spark, data).collect()}
    ordered = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id", ascending=False).select("doc_id", "text").collect()
    assert len(rows) == len(ordered)
    for i, (k, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)].text
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == G.spelled(G.signatures(t)) and r.edited_fingerprint == G.spelled(G.signatures(edited))
        a, b, c = (set(G.signatures(x).tolist()) for x in (t, edited, after))
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 1e-12
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1)) < 1e-12


def test_odd_rows(spark, tmp_path):
    rows = [(None, "last of all", 1), (7, None, 1), (7, "tied", 1), (3, "x " * 30000, 1), (9, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, guest int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_chars): r for r in G.op4_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == 5
    assert got[None, 11].near_next == 0  # the first of all is the empty text of 9
    one = df.filter("doc_id = 3")
    one.write.parquet(str(tmp_path / "one" / "documents.parquet"))
    (r,) = G.op4_fingerprints(spark, str(tmp_path / "one")).collect()
    assert r.near_next == 1 and r.near_edited == 1
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert G.op4_fingerprints(spark, str(tmp_path / "none")).count() == 0
