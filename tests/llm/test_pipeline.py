"""The pipeline's stages together against a plain version of each."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from fraglens.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
from test_decontaminate import words as alnum  # noqa: E402
from test_near_duplicates import components  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")


def cut_repeats(rows, window=13):
    first = {}
    spans = {d: list(WORD.finditer(t)) for d, t in rows.items()}
    for d, w in spans.items():
        for i in range(len(w) - window + 1):
            k = tuple(m[0] for m in w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in spans.items():
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(m[0] for m in w[i : i + window])] < d for j in range(window)}
        text, at = "", 0
        for i, m in enumerate(w):
            if i in gone:
                text += rows[d][at : m.start()]
                at = w[i + 1].start() if i + 1 < len(w) else len(rows[d])
        out[d] = text + rows[d][at:]
    return out


def test_against_plain_stages(spark, tmp_path):
    rnd = random.Random(2)
    vocab = {"en": ["the", "and", "with", "of", "thing", "other"], "de": ["der", "und", "mit", "straße", "über", "nicht"]}
    prose = lambda lang, n: " ".join(rnd.choice(vocab[lang]) + rnd.choice(["", "", "s", "en", "1"]) for _ in range(n))
    items = [(k, prose("en", 20)) for k in range(3)] + [(9, "A short, short question?")]
    passage = prose("de", 55)
    rows = {d: prose("en" if d % 2 else "de", rnd.randint(30, 120)) for d in range(60)}
    lang = {d: "en" if d % 2 else "de" for d in rows}
    for d in (7, 21, 40):
        rows[d] += "\n" + passage + "\n" + prose("en", 20)
    rows[50] = rows[3]
    rows[51] = rows[3]
    rows[30] += " " + items[1][1].upper()
    rows[33] += " a short short QUESTION: what"
    rows[70], rows[71], rows[72] = None, "", "12 34 !"
    df = spark.createDataFrame([(d, t, lang.get(d), "s", len(t or "")) for d, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = {d: t for d, t in rows.items() if t and re.search("[a-z]", t)}
    groups = components(kept)
    kept = {d: t for d, t in kept.items() if groups[d] == d}
    kept = cut_repeats(kept)
    runs = {tuple(w[i : i + 10]) for w in (alnum(t) for _, t in items) for i in range(max(1, len(w) - 9))}
    held = lambda t: any(tuple(alnum(t)[i : i + n]) in runs for n in {*map(len, runs)} for i in range(len(alnum(t)) - n + 1))
    kept = {d: t for d, t in kept.items() if not held(t)}
    assert 30 not in kept and 33 not in kept
    assert {50, 51} & set(kept) == set()
    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    assert set(got) == set(kept)
    for d, t in kept.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), d
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_return_documents_and_take_nulls(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "the of and with", "en", "s", 3), (2, "the of and with", "en", "s", 3), (2, "the of and with", "en", "s", 3)]
    rows += [(3, "der und mit " * 50_000, None, None, None), (3, "another text of one id", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as block_id", "2 as sid", "3 as contaminated", "4 as c0")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, str(tmp_path)).columns == corpus_pipeline.COLUMNS
            stage(spark, some, str(tmp_path)).collect()
