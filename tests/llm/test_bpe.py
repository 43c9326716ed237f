import random

import pytest

from fraglens.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")

TEXTS = [
    None, "", " ", "\n\n  \n", "Hello world, it's the 12th of May!", "aaaaaaaaaaaaaaa bbbbbbbbbbbbbbbbb" * 3, "café übergröße été ñandú 日本語 😀😀‍", "a<|endoftext|>b <|endoftext|><|endoftext|>",
    "\x1c \x85 \xa0 x　 y\t\tz  ", "don't I'LL we'd they've 'tis ''s", "x" * 5000, "0123456789" * 50, "!?" * 100 + " " * 300 + "end", "Ⅷ ½ ١٢٣ ﬁ",
]


def corpus():
    rnd = random.Random(0)
    syllables = ["th", "er", "on", "tion", "ing", "é", "ß", "ou", "Q", "7", "-", "##", "ment", "eaux", "zxq", "'s"]
    return TEXTS + [" ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 9))) for _ in range(80)) for _ in range(150)]


def test_equals_library(spark):
    texts = corpus()
    got = {r.doc_id: r for r in bpe.bpe_round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), PATH).collect()}
    lib = tokenizers.Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ",".join(map(str, ids)), t
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False) == (t or "")


def test_pair_check_equals_merging():
    with open(PATH, encoding="utf-8") as f:
        c = bpe.Codec(f.read())
    rnd = random.Random(1)
    import numpy as np

    a = np.array([rnd.randrange(50000) for _ in range(4000)])
    b = np.array([rnd.randrange(50000) for _ in range(4000)])
    ok = [c.bytes[x] in c.proposed and c.bytes[y] in c.proposed for x, y in zip(a, b)]
    bad = c.unstable(a, b)
    for x, y, k, good in zip(a.tolist(), b.tolist(), bad.tolist(), ok):
        if good:
            assert (c.merged(c.bytes[x] + c.bytes[y]) != [x, y]) == k


def test_empty(spark):
    assert bpe.bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_long_repeated_and_odd_rows(spark, monkeypatch):
    """A cache that is cleared all the time, texts of a million bytes, repeated rows, no id, clashing columns."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    lib = tokenizers.Tokenizer.from_file(PATH)
    long = " ".join(f"word{k}" for k in range(120_000)) + "z" * 200_000
    rows = [(1, long, "a", 1), (1, long, "a", 1), (None, "no id", "b", 2), (2, "plain", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").selectExpr("*", "1 as decoded")
    got = bpe.bpe_round_trip(df, PATH).collect()
    want = {t: ",".join(map(str, lib.encode(t, add_special_tokens=False).ids)) for _, t, _, _ in rows}
    assert sorted(((r.doc_id, r.ids == want[r.decoded], r.n_tokens == want[r.decoded].count(",") + 1) for r in got), key=str) == sorted([(1, True, True)] * 2 + [(None, True, True), (2, True, True)], key=str)


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"id": 50256, "content": "<x>", "lstrip": True}]}])
def test_other_files_are_refused(change):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f) | change
    with pytest.raises(ValueError):
        bpe.Codec(json.dumps(spec))
