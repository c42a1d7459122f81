import random

from tokenizers import Tokenizer

from gistra.llm import counts as C
from gistra.llm.bpe import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def test_quick_pattern_is_the_pattern():
    rng = random.Random(1)
    plain = [chr(i) for i in range(0x2100) if not C.FAR.search(chr(i))]
    for _ in range(3000):
        t = "".join(rng.choice(plain if rng.random() < 0.5 else " \n'sdt1ab_.") for _ in range(rng.randint(0, 30)))
        assert C.QUICK.findall(t) == C.PATTERN.findall(t)


def test_edits_equal_counting_anew():
    counts, rng = C.Counter(PATH), random.Random(3)
    letters = "abc  \n\n'st'reA1 é日.!,\t"
    for _ in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 50, 900])))
        tree = C.TokenTree(C.pieces_of(text), counts)
        for _ in range(6):
            n = len(text)
            a = rng.randint(0, n)
            b = min(n, a + rng.choice([0, 0, 1, 3, 40, n]))
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 10, 400])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text
            assert [p for block in tree.blocks for p in block] == C.PATTERN.findall(text)
            assert tree.total == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_edits_out_of_range_are_clipped():
    tree = C.TokenTree(C.pieces_of("one two"), C.Counter(PATH))
    tree.edit(100, 200, " three")
    tree.edit(-5, 3, "1")
    assert tree.text() == "1 two three"


def test_a_small_edit_costs_little():
    text = "several words of text, " * 3000
    tree = C.TokenTree(C.pieces_of(text), C.Counter(PATH))
    before = tree.encoded
    tree.edit(len(text) // 2, len(text) // 2 + 1, "xy")
    assert tree.encoded - before < 12


def test_query(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Some text <|endoftext|> here " * 50, 9), (3, "Some text <|endoftext|> here " * 50, 9)], "doc_id long, text string, n_tokens int")
    rows = C.with_counts(df, PATH).orderBy("doc_id").collect()
    for r, t in zip(rows, ["", "", *["Some text <|endoftext|> here " * 50] * 2]):
        edited = t
        for a, b, new in C.edits_of(t):
            edited = edited[: min(a, len(edited))] + new + edited[min(max(b, a), len(edited)) :]
        assert r.n_tokens == len(LIBRARY.encode(t, add_special_tokens=False).ids)
        assert r.edited_n_tokens == len(LIBRARY.encode(edited, add_special_tokens=False).ids)
    assert C.with_counts(df.limit(0), PATH).count() == 0
