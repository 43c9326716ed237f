import random
import re

from fraglens.llm.substring_dedup import substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window=13):
    """Removed word positions by definition."""
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        if d is None:
            continue
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def fixture(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    word = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [word(n) for n in (12, 13, 14, 30, 60)]
    rows = []
    for d in range(80):
        w = word(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(passages)
        rows.append((d, "".join(x + rnd.choice([" ", "\n", "\t ", "  "]) for x in w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[3][1]), (102, None), (103, ""), (104, " \n "), (None, rows[5][1]), (105, " ".join(["same"] * 40)), (106, " ".join(["same"] * 50))]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup(df, layout=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute(rows)
    for r in got:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed


def test_layout_keeps_words_and_nulls(spark):
    rows = fixture(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got), key=str) == brute(rows)
    assert [r.text for r in got if r.doc_id == 102] == [None]
    text = dict(rows)
    assert all(r.text == text[r.doc_id] for r in got if r.n_removed == 0 and r.doc_id not in (3, None))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans string")
    assert substring_dedup(df).collect() == []


def test_long_text_and_clashing_columns(spark):
    """A text of some hundred thousand words, half of it again in a later document; columns named like the operator's own."""
    words = [f"w{k}" for k in range(200_000)]
    rows = [(1, " ".join(words), "a", 1), (2, " ".join(words[100_000:] + ["end"]), "b", 2), (2, " ".join(words[100_000:] + ["end"]), "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int").selectExpr("*", "1 as block_id", "2 as c0").withColumnRenamed("spans", "kept")
    got = sorted(substring_dedup(df, layout=False, carry=("kept", "c0")).collect(), key=lambda r: (r.doc_id, r.kept))
    assert [(r.n_words, r.n_removed, list(r.spans), r.kept, r.c0) for r in got] == [(200_000, 0, [], "a", 2), (100_001, 100_000, [0, 100_000], "b", 2), (100_001, 100_000, [0, 100_000], "c", 2)]
    assert got[1].text == "end"
