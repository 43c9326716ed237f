import random
import re

from pyspark.sql import functions as F

from fraglens.llm.decontaminate import decontaminate


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for i, x in items:
            v = words(x)
            n = min(window, len(v))
            for j in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[j : j + n]:
                        hit |= set(range(p, p + n))
                        ids.add("null" if i is None else str(i))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = ["The", "é", "of", "a-b", "c", "12", "it's"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, text(rnd.choice([3, 9, 10, 11, 25]))) for k in range(25)] + [(90, ""), (91, None), (None, "only one"), (92, "...")]
    items += [(200, items[3][1])]
    docs = []
    for d in range(60):
        t = text(rnd.randint(0, 40))
        if d % 3 == 0:
            t += ", " + rnd.choice(items)[1].upper() + "! " + text(5) if (rnd.choice(items)[1] or "") else ""
        docs.append((d, t))
    docs += [(70, None), (71, ""), (0, docs[0][1]), (None, "It is only ONE."), (72, items[4][1] + " " + items[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for piece in (1 << 20, 100):
        got = decontaminate(df, bench, piece=piece).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(docs, items)
        assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_longest_match_and_locations(spark):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "x y " + " ".join(f"W{i}" for i in range(5, 27)) + " z"
    df = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    got = decontaminate(df, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in got.matches] == [("7", 5, 2, 22)]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).first().contaminated is False
    assert decontaminate(docs.limit(0), none).collect() == []


def test_long_texts_cut_items_and_clashing_columns(spark):
    """An item of several pieces, and a document of some hundred thousand words that holds all of it in the middle."""
    rnd = random.Random(6)
    item = " ".join(f"w{rnd.randint(0, 50)}" for _ in range(900))
    filler = " ".join(f"v{k}" for k in range(150_000))
    docs = [(1, f"{filler} {item} {filler}", "a", 1), (1, f"{filler} {item} {filler}", "a", 1), (2, filler, "b", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string, block_id int").selectExpr("*", "1 as n_words", "2 as item_id")
    bench = spark.createDataFrame([(7, item, 1), (8, "v5 v6 v7", 2)], "item_id long, text string, doc_id int")
    for piece in (1 << 20, 700):
        got = sorted(decontaminate(df, bench, piece=piece).collect(), key=lambda r: r.doc_id)
        assert got[0] == got[1] and got[0]["items"] == ["7", "8"] and got[0].n_hit == 906 and got[0].n_words == 300_900
        assert [tuple(m) for m in got[0].matches if m.item == "7"] == [("7", 0, 150_000, 900)]
        assert got[2]["items"] == ["8"] and got[2].n_hit == 3
    for piece in (1 << 20, 700):
        carried = decontaminate(df, bench, piece=piece, carry=("text", "block_id", "item_id")).select("doc_id", "text", "block_id", F.col("n_hit")).collect()
        assert {r.text for r in carried if r.n_hit == 3} == {filler}
    assert [r.n_items for r in decontaminate(df, bench, least=4).orderBy("doc_id").collect()] == [1, 1, 0]
