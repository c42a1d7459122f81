import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gistra.llm import bpe

PATH = bpe.vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(PATH)


def check(texts):
    got = ENCODER.encode(texts)
    want = LIBRARY.encode_batch(texts, add_special_tokens=False)
    for t, g, w in zip(texts, got, want):
        assert g == " ".join(map(str, w.ids)), t
        assert ENCODER.decode(g) == LIBRARY.decode(w.ids, skip_special_tokens=False)


def test_odd_texts():
    check([
        "", " \t\n", "Hello WORLD's don't I'LL", "ΣΑΣ ΑΣ. İstanbul ß ﬁ ǅ", "a<|endoftext|>b <|startoftext|> <|END|> <|endoftext|", "\x1c\x1d z\x1fq　k\x85l", "½ ²3 10% «naïve»",
        "日本語 😀😀 é é", "a" * 3000, "ab" * 500, "1234567", "\0\0<|endoftext|>", "'sS '''ll don''t 'rerere", "​﻿", "#" * 400 + "!?" * 99,
    ])


def test_random_words():
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCÀéèΣσς'.,!? \n\t\x1c\x85½日"
    check(["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    check(texts)


def test_generations_of_known_chunks():
    small = bpe.Encoder(PATH, keep=10)
    texts = [f"word{i} other thing{i % 3}" for i in range(60)]
    for k in range(0, 60, 5):
        assert small.encode(texts[k : k + 5]) == [" ".join(map(str, e.ids)) for e in LIBRARY.encode_batch(texts[k : k + 5], add_special_tokens=False)]


def test_a_word_is_learned_once_whatever_stands_beside_it(monkeypatch):
    learned, encode_words = [], bpe.Bpe.encode_words

    def counted(self, words):
        words = list(words)
        learned.extend(words)
        return encode_words(self, words)

    monkeypatch.setattr(bpe.Bpe, "encode_words", counted)
    fresh = bpe.Encoder(PATH)
    texts = ["marks", "marks, (marks)", '"marks" 7marks7', "été marks. été,\x1cmarks", "日本 marks 日本,"]
    got = [fresh.encode([t])[0] for t in texts]
    assert got == [" ".join(map(str, e.ids)) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert len(learned) == len(set(learned))


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Two words", None), (3, "Two words", None)], "doc_id long, text string, ids string")
    got = bpe.round_trip(df, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    rows = got.orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256 == empty, r.decoded_sha256 == empty) for r in rows[:2]] == [(0, True, True)] * 2
    assert rows[2] == rows[3] and rows[2].ids == LIBRARY.encode("Two words", add_special_tokens=False).ids
    back = bpe.decode(bpe.encode(df, PATH).select("doc_id", "ids"), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["", "", "two</w> words</w>", "two</w> words</w>"]
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_bytes_vocabulary(name):
    model = bpe.bpe(bpe.vocabulary(name))
    library = Tokenizer.from_file(bpe.vocabulary(name))
    words = {" hello", "hello", " the", "thethethe", " é", "\n\n", "    ", "日本語", " 12345"}
    for w, ids in model.encode_words(words).items():
        assert ids == library.encode(w, add_special_tokens=False).ids
