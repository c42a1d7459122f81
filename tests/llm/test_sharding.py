import zlib

from gistra.llm import sharding as S


def placed(spark, rows, n=16):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot long")
    text = S.whole_text()
    from pyspark.sql import functions as F

    rec = df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), S.slot_of(text).alias("__slot"))
    weights = S.slot_bytes(rec, slot="__slot")
    m = S.first_map(weights, n, parts=S.part_bytes(rec, S.heavy_slots(weights, n), slot="__slot"))
    return m, S.assign(rec, m, slot="__slot").collect()


def test_equal_sizes_gapless_positions_groups_together(spark):
    rows = [(i, f"text {i % 1500} " * (1 + i % 9), 0, 0) for i in range(4000)]
    _, got = placed(spark, rows)
    load, at = {}, {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
        at.setdefault(r.shard, []).append(r.position)
    assert len(load) == 16 and max(load.values()) <= 1.02 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in at.values())
    by_text = {}
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        by_text.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_a_third_of_all_rows_is_split(spark):
    rows = [(i, "the same" if i % 3 == 0 else f"own {i}", 0, 0) for i in range(3000)]
    m, got = placed(spark, rows)
    load = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert len(m.split) == 1 and max(load.values()) <= 1.02 * min(load.values())


def test_odd_rows(spark):
    _, got = placed(spark, [(None, None, 1, 1), (None, None, 1, 1), (1, "", 1, 1), (1, "", 1, 1)], 3)
    assert len(got) == 4 and sum(r.size for r in got) == 4
    _, got = placed(spark, [])
    assert got == []


def test_maps_are_versioned_and_edited(spark, tmp_path):
    weights = [(i * 37) % 101 for i in range(S.SLOTS)]
    weights[5] = 10_000_000
    one = S.first_map(weights, 4)
    two = S.rebalance(one, weights, 5)
    assert (one.version, two.version, two.n_shards) == (1, 2, 5)
    load = [0.0] * 5
    moved = 0.0
    for s, x in enumerate(two.shard_of):
        for i, y in enumerate(two.split[s]) if s in two.split else [(-1, x)]:
            w = weights[s] / S.PARTS if i >= 0 else weights[s]
            load[y] += w
            moved += w * (y != (one.split[s][i] if i >= 0 else one.shard_of[s]))
    assert max(load) <= 1.03 * sum(load) / 5 and moved <= 0.25 * sum(load)
    path = str(tmp_path / "map")
    one.save(spark, path)
    two.save(spark, path)
    assert S.SlotMap.load(spark, path, 1).split == one.split
    back = S.SlotMap.load(spark, path)
    assert back.version == 2 and back.split == two.split
    assert all(back.shard_of[s] == x for s, x in enumerate(two.shard_of) if s not in two.split)


def test_query(spark, data):
    rows = S.op7_sharding(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
