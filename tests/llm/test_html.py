import pytest

from fraglens.llm import html_wrapper as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li>More</li></ul></nav><!-- ad -->
<div class="cookie-notice">We use cookies</div><article><h1>{title} &amp; co</h1>{body}<div class="comments"><p>reader {title}</p></div></article><aside>{title} side</aside><form>Name<input></form><footer>&copy; X</footer></body></html>"""


def page(k, n):
    return PAGE.format(title=f"Title {k}", body="".join(f"<p><b>Para {k}.{i}<br>\n  with&nbsp;&eacute;</b> end" for i in range(n)))


def test_blocks_fold_and_alignment():
    a, b = (H.fold(H.blocks_of(page(k, n))) for k, n in ((1, 1), (2, 5)))
    both = H.align(a, b)
    assert "(<p> # </p>)+" in H.expression(both)
    assert H.expression(H.align(both, a)) == H.expression(both)
    c = H.fold(H.blocks_of("<body><article><h1>t</h1><ul><li>x<li>y</ul></article></body>"))
    mixed = H.expression(H.align(["", "1", []], c))
    assert "?" in mixed
    assert "(<li> # </li>)+" in mixed


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_extraction(spark, monkeypatch, most):
    monkeypatch.setattr(H, "BROADCAST_BYTES", most)
    rows = [(k, f"http://h{k % 2}.example/{k}", page(k, 1 + k % 4)) for k in range(12)]
    rows += [(50, None, "plain &lt;text&gt;\n here"), (51, "http://h1.example/z", None), (52, "http://h0.example/", ""), (None, "http://h0.example/", page(3, 2)), (53, "http://only.example", "<div class=menu>m</div><div><div><p>long enough text one</p><p>two <i>in</i>line</p></div></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract_text(df).collect()}
    for k in range(12):
        assert got[k].split("\n\n") == [f"Title {k} & co", *[f"Para {k}.{i} with é end" for i in range(1 + k % 4)]]
    assert got[50] == "plain <text> here"
    assert got[51] == got[52] == ""
    assert got[53] == "long enough text one\n\ntwo inline"
    assert H.extract_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("bad", ["<p", "<<<>>>", "</div></p>", "<script>x", "<a href='", "<!-- open", "<p>a<table><tr><td>b<td>c</table>d", "&#0;&#xD800;&bogus;", "<p>" * 500 + "x"])
def test_broken_pages(bad):
    H.merge_structures([__import__("json").dumps(H.fold(H.blocks_of(bad)))])


def test_layouts_of_one_host(spark):
    """Pages without article on a host that has some, and the minority of two layouts without any."""
    plain = "<body><div class=menu>m</div><div class=text><p>Plain {0} a</p><p>plain {0} b</p></div></body>"
    rows = [(k, "http://mix.example/", page(k, 2)) for k in range(6)] + [(10 + k, "http://mix.example/", plain.format(k)) for k in range(3)]
    rows += [(20, "http://mix.example/", "no tags")]
    rows += [(30 + k, "http://two.example/", f"<body><div class=wide><p>Long {k} {'word ' * 40}</p></div></body>") for k in range(6)]
    rows += [(40, "http://two.example/", plain.format(40))]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[1].split("\n\n") == ["Title 1 & co", "Para 1.0 with é end", "Para 1.1 with é end"]
    for k, n in ((10, 0), (11, 1), (12, 2), (40, 40)):
        assert got[k] == f"Plain {n} a\n\nplain {n} b"
    assert got[20] == "no tags"
    assert got[31].startswith("Long 1 word")


def test_copies_are_not_template_text(spark):
    """Copies of a page with blocks of its own lose none; nor do blocks of an article that are alike on many pages; template text goes."""
    one = "<body><article><h1>Own</h1><blockquote>Quote</blockquote></article></body>"
    lead = "<body><article><h4>Series</h4><p>Part {0}</p></article></body>"
    rows = [(k, "http://a.example/", one) for k in range(3)] + [(10 + k, "http://a.example/", page(k, 2)) for k in range(4)]
    rows += [(20 + k, "http://b.example/", lead.format(k)) for k in range(5)]
    few = "<body><div class=box><h3>Same title</h3><p>Text {0}</p></div></body>"
    rows += [(30 + k, "http://c.example/", few.format(k)) for k in range(3)] + [(40 + k, "http://c.example/", f"<body><div class=box><p>Other {k}</p></div></body>") for k in range(6)]
    rows += [(60 + k, "http://d.example/", f"<body><div class=box><h6>Always here</h6><p>Text {k}</p></div></body>") for k in range(6)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[0] == got[2] == "Own\n\nQuote"
    assert got[21] == "Series\n\nPart 1"
    assert got[31] == "Same title\n\nText 1"
    assert got[61] == "Text 1"


def texts(spark, pages, **more):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract_text(df.selectExpr("*", "1 as host", "'x' as text", "2 as wrapper", "3 as article")).collect()}
    return [got[k] for k in range(len(pages))]


WRAPS = [
    '<body class="single has-sidebar">{}</body>', '<body><form id="aspnetForm" class="form">{}</form></body>', '<body><div class="side-by-side notice">{}</div></body>', '<body id="feedback-form" class="popular legal header"><div class="header-fixed">{}</div></body>',
    '<body class="comments-open"><div class="comments-open">{}</div></body>',
]


@pytest.mark.parametrize("wrap", WRAPS)
def test_frames_with_odd_names_rule_nothing_out(spark, wrap):
    """The class words stand on what holds the page; small, optional and repeated parts below it go all the same."""
    inner = "<div class=menu><a href=/>Home</a> <a href=/x>X</a></div><div class=content><h1>Head {0}</h1><p>First words of text {0}, and more of them {1}</p><p>second {0}</p></div><div class=sidebar><p>aside {0}</p></div>{2}<div id=footer>Imprint</div>"
    pages = [("http://w.example/", wrap.format(inner.format(k, "word " * (20 + k), "<div class=comments><p>I say {0}</p><p>so {0}</p></div>".format(k) if k % 2 else ""))) for k in range(6)]
    for k, text in enumerate(texts(spark, pages)):
        assert text == f"Head {k}\n\nFirst words of text {k}, and more of them {'word ' * (20 + k)}".strip() + f"\n\nsecond {k}"


def test_long_comment_threads_are_not_the_article(spark):
    thread = lambda k: "<div class=comments>" + "".join(f"<div class=comment><p>reader {k} {i} {'says ' * 30}</p></div>" for i in range(40)) + "</div>"
    pages = [("http://c.example/", f"<body><div class=post><h1>T {k}</h1><p>Short article {k}</p></div>{thread(k)}</body>") for k in range(5)]
    assert texts(spark, pages) == [f"T {k}\n\nShort article {k}" for k in range(5)]


def test_cards_named_article_do_not_hide_the_text(spark):
    cards = lambda k: "".join(f"<article class=card><a href=/{i}>Other {k} {i}</a></article>" for i in range(4))
    pages = [("http://k.example/", f"<body><div class=post><h1>T {k}</h1><p>Long text {k} {'word ' * 50}</p></div><div class=more>{cards(k)}</div></body>") for k in range(5)]
    assert texts(spark, pages)[3] == f"T 3\n\nLong text 3 {'word ' * 50}".strip()


def test_contents_stay_as_they_are(spark):
    body = 'a​b <math><mi>x</mi><mo>+</mo><mn>1</mn></math> 3 < 5 &amp; 7 > 2 <svg><title>icon</title><style>p{}</style><text>drawn</text></svg> <canvas>no canvas</canvas><object>fallback</object>'
    pages = [
        ("http://a.example/", f"<body><article><p>{body}</p><textarea>typed</textarea></article></body>"), ("http://b.example/", '<body><article><p title="it>next</p><p class="x">then</p></article></body>'),
        ("http://b.example/", "<body><article><p title='it>next</p><p>then</p></article></body>"), ("http://e.example/", "<title>never closed <p>text</p>"),
        ("http://f.example/", "<body><main><p>a<unknown-tag>b</unknown-tag><odd>c</odd></p></main></body>"),
    ]
    assert texts(spark, pages) == ["a​b x+1 3 < 5 & 7 > 2 drawn no canvasfallback", "next\n\nthen", "next\n\nthen", "never closed\n\ntext", "a\n\nb\n\nc"]


def test_deep_long_and_repeated_pages(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 4)
    deep = "<div>" * 10_000 + "deep" + "</div>" * 9_000 + "<p>less deep</p>"
    long = "<body><article>" + "".join(f"<h2>h {i}</h2><p>p {i} {'x' * 40}</p>" for i in range(20_000)) + "</article></body>"
    hot = [("http://hot.example/", "<body><article>" + "".join(f"<{t}>{t} {k}</{t}>" for i, t in enumerate(("h1", "p", "h2", "pre", "ul", "blockquote")) if k >> i & 1 or i == 1) + "</article><footer>f</footer></body>") for k in range(60)]
    got = texts(spark, [("http://d.example/", deep), ("http://l.example/", long), ("http://l.example/", long), *hot])
    assert got[0] == "deep\n\nless deep"
    assert got[1] == got[2] == "\n\n".join(f"h {i}\n\np {i} {'x' * 40}" for i in range(20_000))
    for k, text in enumerate(got[3:]):
        assert text == "\n\n".join(f"{t} {k}" for i, t in enumerate(("h1", "p", "h2", "pre", "ul", "blockquote")) if k >> i & 1 or i == 1)
