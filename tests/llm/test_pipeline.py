"""Every stage against what its operator says of its own input."""

import corpus_pipeline as P
import pytest

from gistra.llm import bpe, decontaminate, secrets
from gistra.llm.common import table
from test_copies import brute

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in P.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(at / name))
        docs = spark.read.parquet(str(at / name))
        out.append({r.doc_id: r for r in docs.collect()})
    return {r.doc_id: r for r in table(spark, FOLDER, "documents").collect()}, out


def test_stages(spark, stages):
    docs, (quality, dedup, clean, masked, encoded) = stages
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    assert all((d in quality) == bool(q) for d, q in labels.items())
    assert set(dedup) == set(brute({d: r.text for d, r in quality.items()}).values())
    leaked = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(list(dedup.values())), table(spark, FOLDER, "benchmark")).collect()}
    assert set(clean) == set(dedup) - leaked
    assert set(masked) == set(clean) == set(encoded)
    for d, r in masked.items():
        assert r.n_chars == len(r.text) and (r.text == clean[d].text or secrets.MASK in r.text)
    enc = bpe.Encoder(bpe.vocabulary())
    for d, r in encoded.items():
        assert " ".join(map(str, r.ids)) == enc.encode([masked[d].text])[0]
    assert all(list(x.asDict()) == list(docs[0].asDict()) for s in (quality, dedup, clean, masked) for x in list(s.values())[:1])


def test_run_gives_the_last_stage(spark, stages):
    _, out = stages
    assert {r.doc_id: r.ids_sha256 for r in P.run(spark, FOLDER).collect()} == {d: r.ids_sha256 for d, r in out[-1].items()}
