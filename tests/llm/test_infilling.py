import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fraglens.llm import infilling as I


def brute(doc_id, text, seed=1):
    """By a list of all units."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["one two", "", None, "a", "\n", "a<P>b", "<S>", "x<M", "é😀 naïve\r\n\tend", "<P", "S>", "<<S<M<P", "word " * 3000, "1234567", "x" * 10000, "\u0000 a"]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**12), st.text(st.sampled_from("ab<PSM>é \n😀"), max_size=30))
def test_one_against_brute(doc_id, text):
    assert I.infill(doc_id, text) == brute(doc_id, text)


def test_frame_against_brute_and_round_trip(spark):
    rows = [(d, TEXTS[d % len(TEXTS)], "x") for d in range(400)] + [(None, "no id here", "x"), (3, "again", "x"), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").selectExpr("*", "1 as n", "'psm' as form").repartition(3)
    got = I.fill_in_middle(df).withColumn("back", I.restored()).collect()
    want = sorted((str((d, *brute(d, t or ""), t or "")) for d, t, _ in rows))
    assert sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert I.fill_in_middle(df.limit(0)).collect() == []


def test_shares(spark):
    got = I.fill_in_middle(spark.range(5000).selectExpr("id as doc_id", "'some words of text' as text")).groupBy("form").count().collect()
    n = {r.form: r["count"] for r in got}
    assert n["plain"] == pytest.approx(500, abs=90) and n["spm"] == pytest.approx(900, abs=120)


def test_no_units_are_stored():
    """The memory that the matcher takes does not grow with the text."""
    import tracemalloc

    peaks = []
    for k in (20_000, 200_000):
        text = "ab, " * k
        tracemalloc.start()
        I.position(text, k, 2 * k)
        sum(1 for _ in I.UNIT.finditer(text))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] + 4096
