import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fraglens.llm import ppm


def test_probabilities_sum_to_one():
    """After a context seen, one seen only at lower orders, and over all 256 symbols."""
    rnd = np.random.RandomState(0)
    text = rnd.choice([65, 66, 67, 200], 3000).astype(np.uint64)
    five = sum(text[k : len(text) - 4 + k] << np.uint64(8 * (4 - k)) for k in range(5))
    seen, counts = np.unique(five, return_counts=True)
    three, n3 = np.unique(five & np.uint64(0xFFFFFF), return_counts=True)
    low = ppm.Low(three.astype(np.uint32), n3)
    for context in (seen[0] >> np.uint64(8), np.uint64(0x01414141)):
        tail = np.uint64(0xFFFFFF) & context
        near = seen[(seen >> np.uint64(8)) & np.uint64(0xFFFFFF) == tail]
        asked = np.unique(np.concatenate((near, (context << np.uint64(8)) | np.arange(256, dtype=np.uint64))))
        of = dict(zip(seen.tolist(), counts.tolist()))
        logs = ppm.log_probabilities(asked, np.array([of.get(c, 0) for c in asked.tolist()]), low)
        assert math.isclose((10.0 ** logs[asked >> np.uint64(8) == context].astype(float)).sum(), 1, abs_tol=1e-4)


def test_base_and_rows(spark):
    rnd = random.Random(5)
    rows = [(d, " ".join(rnd.choice(["the", "of", "über", "q7", "é\tx"]) for _ in range(rnd.randint(0, 30)))) for d in range(60)]
    rows += [(None, "the of zz"), (61, None), (62, ""), (3, "the the"), (63, " unseen words only ")]
    got = ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", t or ""), None] for _, t in rows]
    c = Counter(x for (d, _), ts in zip(rows, tokens) if not held(d) for x in ts)
    n, v = sum(c.values()), len(c)
    want = [(d, held(d), len(ts), sum(c[x] > 0 for x in ts), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts), 6)) for (d, _), ts in zip(rows, tokens)]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)


def test_base_folds_ascii_case_only(spark):
    """The base's words are told apart without the case of A-Z; other letters, and the model's bytes, keep theirs."""
    rows = [(0, "The THE the Über über"), (2, "tHe ÜBER"), (5, None), (3, "the the the"), (4, "THE THE THE"), (7, "the the")]
    got = {r.doc_id: r for r in ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    c = Counter(w for d, t in rows if not got[d].held_out for w in [*(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in (t or "").split()), None])
    assert not any(r.held_out for r in got.values()) and c["the"] == 12 and (c["Über"], c["über"]) == (2, 1)
    n, v = sum(c.values()), len(c)
    for d, words in ((0, ["the"] * 3 + ["Über", "über", None]), (3, ["the"] * 3 + [None]), (4, ["the"] * 3 + [None])):
        assert got[d].train_tokens == n and got[d].n_known == len(words)
        assert math.isclose(got[d].base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in words), abs_tol=1e-9)
    assert got[3].score > got[4].score


@pytest.mark.parametrize("rows", [[], [(2, "only held out")]])
def test_nothing_to_learn(spark, rows):
    got = ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string"), modulus=1, rest=0).collect()
    assert len(got) == len(rows)
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in got)


def test_scores_of_all_contexts(spark):
    """More than 64 symbols, contexts seen once: every score is the escapes' by definition over all 256 symbols."""
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,éßжщ語字🙂"
    rows = [(d, "".join(rnd.choice(letters[:6] if rnd.random() < 0.6 else letters) for _ in range(rnd.randint(0, 60)))) for d in range(40)]
    got = {r.doc_id: r for r in ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    counts = [{} for _ in range(5)]
    for d, t in rows:
        s = [255] * 4 + [*t.encode(), 255]
        for i in range(4, len(s)) if not got[d].held_out else ():
            for k in range(5):
                here = counts[k].setdefault(tuple(s[i - k : i]), Counter())
                here[s[i]] += 1

    def log_p(context, symbol):
        p, excluded = 1.0, set()
        for k in range(4, -1, -1):
            here = {s: n for s, n in counts[k].get(context[4 - k :], {}).items() if s not in excluded}
            if here:
                size = sum(here.values()) + len(here)
                if symbol in here:
                    return math.log10(p * here[symbol] / size)
                p *= len(here) / size
                excluded |= set(here)
        return math.log10(p / (256 - len(excluded)))

    for d, t in rows:
        s = [255] * 4 + [*t.encode(), 255]
        want = sum(log_p(tuple(s[i - 4 : i]), s[i]) for i in range(4, len(s)))
        assert math.isclose(got[d].score, want, rel_tol=1e-5, abs_tol=1e-4), d


def test_long_repeated_and_clashing(spark):
    long = "the of and über " * 40_000
    rows = [(0, long, "x", 1), (0, long, "x", 1), (1, "the of", "y", 2), (2, "über", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, kind int").selectExpr("*", "1 as id", "2 as block_id", "3 as held_out")
    got = sorted(ppm.ppm_scores(df).collect(), key=lambda r: r.doc_id)
    assert got[0] == got[1] and got[0].n_tokens == 160_001 and got[0].score > -10_000
    assert [r.n_tokens for r in got[2:]] == [3, 2]
