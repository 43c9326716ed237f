import numpy as np
import pytest

from fraglens.llm import language_gru as L
from fraglens.llm import quality_zstd as Q
from fraglens.llm import samples

WORDS = {"en": ["the", "and", "with", "of", "thing"], "de": ["der", "und", "mit", "ß", "über"], "fr": ["le", "été", "avec", "que", "ç"]}


def table():
    rng = np.random.RandomState(0)
    rows = []
    for d in range(240):
        lang = list(WORDS)[d % 3]
        rows.append((d, " ".join(rng.choice(WORDS[lang], rng.randint(5, 60))), lang if d % 11 else None))
    return rows


def test_gradients_by_differences(monkeypatch):
    rng = np.random.RandomState(1)
    p = {k: v.astype(np.float64) for k, v in L.initial(3, rng).items()}
    x, y = rng.randint(60, 70, (7, 5)).astype(np.uint8), rng.randint(0, 3, 5)
    mask = (rng.rand(7, 5) > 0.2).astype(float)
    _, g = L.gradients(p, x, y, mask)
    for k in p:
        for _ in range(6):
            at = tuple(rng.randint(0, n) for n in p[k].shape)
            at = (x[0, 0], *at[1:]) if k[0] == "x" else at
            old, eps = p[k][at], 1e-2
            p[k][at] = old + eps
            up = L.gradients(p, x, y, mask)[0]
            p[k][at] = old - eps
            down = L.gradients(p, x, y, mask)[0]
            p[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * eps), abs=2e-4, rel=0.05)


def test_language_accuracy_and_cases(spark):
    rows = table() + [(900, None, "en"), (901, "", "en"), (902, "123 !?", None), (903, "日本", None), (None, "the and of", "en"), (3, "le été", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    truth = {d: lang for d, (_, _, lang) in enumerate(rows[:240]) if lang}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
    by = {r.doc_id: r for r in got}
    assert [by[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert L.identify(df).first().lang_pred == "und"
    assert L.identify(df.limit(0)).collect() == []


def test_quality(spark):
    rng = np.random.RandomState(0)
    rows, labels = [], []
    for d in range(300):
        good = d % 4 != 0
        words = rng.choice(["the", "quick", "brown", "foxes", "jumped", "over", "lazy", "dogs"], rng.randint(20, 120))
        rows.append((d, " ".join(w if good else w.upper() + "!!" for w in words)))
        labels.append((d, int(good)))
    rows += [(900, None), (901, ""), (None, "the"), (5, "again")]
    labels += [(900, 1), (None, 0), (7, None), (8, 5), (9999, 1)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    got = Q.quality_scores(df, lab).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300 and r.doc_id != 5]
    assert held and np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert Q.quality_scores(df, lab.limit(0)).first().score == 0.5
    assert Q.quality_scores(df.limit(0), lab).collect() == []


def test_samples_take_all_labels_in_two_passes(spark):
    rows = [(k, f"text {k % 500} {'x' * (k % 7)}", f"l{k % 90}") for k in range(4000)] + [(1, "text 1 x", "l1")] * 5
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(5)
    got = samples.per_class(df, "label", 10, 4, 2)
    assert {v for v, _ in got} == {f"l{k}" for k in range(90)} and len(got) == 900
    assert got == samples.per_class(df.repartition(2), "label", 10, 4, 2)
    assert all(len(raw) <= 8 for _, raw in got)
    assert samples.spread(b"abcdefghij", 2, 3) == b"abefij" and samples.spread(b"abc", 2, 3) == b"abc"


def test_rare_languages_long_texts_ties_and_clashing_columns(spark):
    rows = [(d, t, lang, "s", 1) for d, t, lang in table()] + [(300 + k, "xx" * (5 + k), f"z{k}", "s", 1) for k in range(70)]
    long = "der und mit über " * 60_000
    rows += [(500, long, None, "s", 1), (500, long, None, "s", 1), (501, "the and", None, "t", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int").selectExpr("*", "1 as id", "2 as label", "3 as h", "4 as held_out")
    got = L.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = [r for r in got.collect() if r.doc_id >= 500]
    assert len(got) == 3 and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 2
    # Equal probabilities go to the first language.
    same = spark.createDataFrame([(k, "abc abc", lang) for k, lang in enumerate(("b", "a") * 30)], "doc_id long, text string, lang string")
    monotone = {r.lang_pred for r in L.identify(same, sample=1).collect()}
    assert len(monotone) == 1


def test_quality_of_long_repeated_and_tied_texts(spark):
    good, bad = "the quick brown foxes jumped " * 30, "THE!! QUICK!! BROWN!! FOXES!! " * 30
    rows = [(d, (good if d % 2 else bad) + str(d), 1, "x") for d in range(200)] + [(700, good * 4000, 1, "x")] * 2 + [(701, bad * 4000, 1, "x"), (702, "", 0, "y"), (703, None, 0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, held_out string").selectExpr("*", "1 as y", "2 as id", "3 as raw", "4 as predicted")
    lab = spark.createDataFrame([(d, d % 2) for d in range(200)], "doc_id long, quality int").selectExpr("*", "1 as text", "2 as y")
    got = {}
    for r in Q.quality_scores(df, lab).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[700]) == 2 and got[700][0] == got[700][1] and got[700][0].predicted == 1 and got[701][0].predicted == 0
    assert got[702][0].score == got[703][0].score
    assert all(r.predicted == int(r.score >= 0.5) for rs in got.values() for r in rs)
    # Both classes alike: half and half is a tie, which predicts 1.
    even = Q.quality_scores(df, spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, quality int")).collect()
    assert {(r.score, r.predicted) for r in even} == {(0.5, 1)}
