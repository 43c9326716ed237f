"""URL filters and quality rules against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fraglens.llm import line_quality as Q
from fraglens.llm import url_filter as U


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = fold(re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", re.sub("^[^/?#]*", "", rest, count=1))[0]
    fits = [(len(h + p), h + p, a) for a, h, p in U.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, action = (max(fits)[1], max(fits)[2]) if fits else (None, None)
    hit = any(re.search(p, fold(url)) for _, _, p in U.PATTERNS) if url else False
    return host, path, rule, action or ("block" if hit else "allow")


def test_urls(spark):
    urls = [
        None, "", "no scheme/x", "http://Example.ORG/en/1", "http://example.org/en/2", "http://www.example.org/es/3?x", "http://notexample.org/es/", "http://a.com/de/", "http://a.com/fr/1#t", "http://a.com",
        "https://m.free-bets.example.net/en/3", "https://x.net/login?next=/", "https://x.net/relogin", "https://casino.net/", "ftp://net/?add-to-cart=4", "http://h.net:80/a.exe", "http://cheap-pills.example.com/fr/9", "http://net?a=://b/c", "HTTP://U@X.NET/É",
    ]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[4], "x"), (3, urls[3], "x"), (3, urls[3], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df).collect()), key=str)
    assert got == sorted(((i, *brute_url(u)) for i, u, _ in rows), key=str)
    assert U.filter_urls(df.limit(0)).collect() == []


WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_quality(rows, limit):
    norm = lambda line: " ".join(WORD.findall(re.sub("[0-9]", "0", line.lower())))
    spread = defaultdict(set)
    for d, t, h in rows:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                spread[h, norm(line)].add((d, None) if d is not None else (None, t))
    out = []
    for d, t, h in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        rep = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        gone = sum(len(WORD.findall(x)) for x in lines if len(spread[h, norm(x)]) > limit)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        left = len(w) - gone
        depleted = gone > 0 and (left < Q.LEAST_WORDS or left < Q.LEAST_SHARE * len(w))
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), gone, failed, not failed and not depleted))
    return sorted(out, key=str)


def test_quality_rules(spark):
    prose = lambda k: " ".join(f"word{k}x{i} é{i}" for i in range(40))
    rows = [(k, f"Menu {k} of all\n{prose(k)}\n\x0b\n#tag <b>", f"h{k % 2}") for k in range(12)]
    rows += [(50 + k, "\n".join(f"same line {i} a b c d {k if i == 3 else ''}" for i in range(20)), "h3") for k in range(5)]
    rows += [(70, None, "h0"), (71, "", None), (72, prose(1), None), (None, prose(2), "h1"), (0, rows[0][1], "h0"), (73, "a b c " * 30, "h0"), (74, "a b c a b c d", "h0"), (75, "x\n x\nx\nx", "h9"), (76, "two words", "h0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Q.quality_rules(df, limit=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_quality(rows, 2)
    assert Q.quality_rules(df.limit(0)).collect() == []


def test_quality_rules_on_long_texts_and_clashing_columns(spark):
    many = " ".join(f"w{i}" for i in range(300_000))
    again = many + " w5 w6 w7\n" + "a b c d " * 20_000
    rows = [(1, many, "h", 1, 2), (2, again, "h", 1, 2), (2, again, "h", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, salt int").withColumnsRenamed({"n_words": "host", "salt": "id"}).selectExpr("*", "1 as line", "2 as w_", "3 as h2")
    got = sorted((r.doc_id, r.n_words, r.n_repeat_words, r.kept) for r in Q.quality_rules(df).collect())
    assert got == [(1, 300_000, 0, True), *[(2, 380_003, 80_006, True)] * 2]


def test_quality_rules_are_compiled(spark):
    """Lines are normalised without functions over arrays, which are interpreted; only texts that repeat a window are taken apart by them. Odd white space, folds and symbols."""
    rows = [
        (1, "\t a  b\tc \r\nA\x0b\x0cB  C\n \t\na b c", "h"), (2, "a b c a b c", "h"), (3, "\u039f\u0394\u039f\u03a3\n\u039f\u0394\u039f\u03a3 x1\n\u03bf\u03b4\u03bf\u03c2", "h"), (4, "\u0130 9\u00a08 \U0001f600 \u2003", "h"), (5, " ", "h"), (6, "#*$%&|<> && || x", None), (7, "one two", None),
        (8, "a b b c a b b c", "h"), (9, "\u03bf\u03b4\u03bf\u03c2\nA 1\na 2", "h"), (10, "9\u00a01 x\n\u0130 0\u00a00 \U0001f600 \u2003", "h"), (11, "x " * 9, "h"), (12, None, None), (13, "a b c\n\n\na\tb c ", "h"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((tuple(r) for r in Q.quality_rules(df, limit=1).collect()), key=str) == brute_quality(rows, 1)
    lines = Q.line_rows(df.selectExpr("doc_id as id", "text", "source as host"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in lines and "translate" not in lines


def test_urls_of_any_length_with_clashing_columns(spark):
    long = "http://net/" + "a/" * 200_000 + "login"
    df = spark.createDataFrame([(1, long, "x", "y"), (2, long[:-1], "x", "y")], "page_id long, url string, pattern string, host string").selectExpr("*", "'z' as verdict", "1 as token", "2 as low")
    assert sorted((r.page_id, r.host, r.verdict) for r in U.filter_urls(df).collect()) == [(1, "net", "block"), (2, "net", "allow")]


def test_literal_tokens(spark):
    cases = {
        r"[/.]cheap-pills\.": ["cheap", "pills"], r"^[a-z]+://[^/?#]*\bcasino\b": ["casino"], r"[/.]xxx[/.]": ["xxx"], "casino": [], "/casino": [], "/casino/": ["casino"], r"[?&]affiliate[_-]id=": ["affiliate", "id"], "/[!-~]x/": [], r"/login([/?.]|$)": [],
        r"\.exe$": ["exe"], "^http://ads": ["http"], "^https?://a/": ["a"], "/ab+c/d/": ["d"], "/a/|/b/": [], "/x{2}y/z/": ["z"], "/a(b(c))/d/": ["d"], r"/\d9/q1/": ["q1"], "/Ab/c/": ["c"],
    }
    df = spark.createDataFrame([(p,) for p in cases], "pattern string")
    got = {r.pattern: r.t for r in df.select("pattern", U.literal_tokens(F.col("pattern")).alias("t")).collect()}
    assert got == cases


def test_rules_from_a_table(spark, tmp_path):
    """Rules read from a file, with and without tokens, by exchange as by broadcast."""
    spark.createDataFrame([("pills", r"[/.]cheap-pills\.", None), ("x", r"/x[0-9]+/y", ["y"]), ("never", "/zzz/", None)], "name string, pattern string, tokens array<string>").write.parquet(str(tmp_path / "rules"))
    rules = spark.read.parquet(str(tmp_path / "rules"))
    urls = spark.createDataFrame([(u,) for u in ("http://a.cheap-pills.net/", "http://b/x12/Y", "http://b/x/y", "http://cheap/pills", None, "http://a.cheap-pills.net/")], "url string")
    for most in (10_000, 0):
        assert {(r.url, r.pattern) for r in U.blocked_urls(urls, rules, most).collect()} == {("http://a.cheap-pills.net/", "pills"), ("http://b/x12/Y", "x")}
    assert U.blocked_urls(urls, rules.limit(0)).collect() == []
    with pytest.raises(Exception, match="no literal token"):
        U.blocked_urls(urls, spark.createDataFrame([("all", ".*")], "name string, pattern string")).collect()
