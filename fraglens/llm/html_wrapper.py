"""Main text of HTML pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a page's block structure: a
tree of elements and text slots, each once, optional (?), repeated (+) or both
(*). A page is folded first: adjacent siblings of the same kind become one
repeated element (of more than ``WIDE`` siblings, all of one kind do). Same-host
pages are then aligned with the wrapper so far, level by level along the longest
common run of siblings; what only one side has becomes optional, and what matches
is merged. Equal folded structures count once; a host of more than ``FAN`` of them
is merged as a tree, ``FAN`` at a time in tasks of their own, so that a host with a
third of all pages is a few small rows by the time its wrapper is made.

For every text slot, the pages of the host are counted, with its characters, the
characters within links, and whether its text is always the same. A slot is
template text if it is outside ``article`` and ``main``, and three or more different
page texts and half of the host's have it once, all alike, while others vary; a
slot is a list of links if most of its characters are. The article is chosen among
a page's own other slots, by the counts of its host. The slots within ``article`` or
``main`` are taken if they hold a quarter of the varying text; else the smallest
element that holds most of it, with the headline before it.

Roles, element names and class words such as ``header`` or ``sidebar`` are hints: what
stands below such an element is left out, unless the counts say that the element is
a frame of the page. It is one if an article, a main part or a varying headline
stands in it, or if, once on every page, it holds ``BULK`` of the varying text. So
a class of ``body`` or a form around the page rules nothing out, while comments,
adverts and notices, which are optional, repeated or small, go.

Text: character references are decoded, white space within a block becomes one
space, blocks are joined by an empty line. Elements that are not of block kind
(``svg``, ``math``, unknown ones) leave their text in place; the contents of scripts,
styles, templates, frames, page titles and text fields are none. A quote that is
never closed ends with its tag.

Special cases: null or empty html gives ""; html without any tag is one block;
pages of any length and depth are read whole, but elements more than ``DEPTH`` deep
count to the one they stand in; a null or schemeless url has the host ""; repeated
rows get a row each; an empty table gives an empty result; extra columns, whatever
their names, are not carried.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .blocks import cut, lean
from .url_filter import host_and_path

SLICE_BYTES = 4 << 20
#: Structures that are merged in one task, for a host in one step.
FAN = 64
#: Siblings that are told apart by place, and depth to which elements are told apart.
WIDE, DEPTH = 64, 64
BROADCAST_BYTES = 8 << 20
SALTS = 256
#: Least number and share of a host's different page texts that have a slot of template text.
FIXED_PAGES, FIXED_SHARE = 3, 0.5
#: Shares of the varying text: what makes a hinted element a frame, and an article or main part the article; of characters in links, for a list of links.
BULK, MAIN_SHARE, LINKED = 0.8, 0.25, 0.7

_ATTRIBUTES = r"((?:[^>\"']+|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+)(?:>|\Z)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*){_ATTRIBUTES}|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Element names of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html"
    " legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end an open paragraph, and what ends an open item.
LEAF = {"p", *HEADINGS, "dt", "dd", "li", "td", "th", "tr", "option"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "nav", "header", "footer", "aside", "form", "select", "blockquote"}
#: Elements and roles that hint at other things than an article.
AWAY = {"nav", "header", "footer", "aside", "form", "button", "select", "head", "menu", "dialog", "fieldset", "search"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
#: Class and id words that do.
AWAY_WORDS = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs pagination toolbar sidebar aside widget"
    " header footer copyright disclaimer notice notices cookie cookies consent share social newsletter signup login search popup modal related".split()
)
#: Of these, those that no share of the text makes a frame: readers' part of a page may be longer than the article.
READERS = {"comment", "comments", "commentlist", "replies", "respond", "discussion", "disqus"}
NUMBERED = re.compile(r"[0-9a-f]*[0-9][0-9a-f]*")
SPACE_RUN = re.compile(r"\s+")


def element_key(tag: str, attributes: str) -> str:
    """The tag with its role, id and class words; numbers in them, which tell single items apart, are 0."""
    if "=" not in attributes:
        return tag
    marks = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            marks.setdefault(name, a or b or c)
    words = [NUMBERED.sub("0", w) for n in ("id", "class") for w in marks.get(n, "").lower().replace("/", " ").replace(".", " ").replace("@", " ").split()]
    role = marks.get("role", "").lower().split()
    return tag + (f"@{role[0].replace('/', '').replace('.', '')}" if role else "") + "".join("." + w for w in dict.fromkeys(words))


def key_parts(key: str) -> tuple[str, str, set[str]]:
    """(tag, role, class and id words with their parts)"""
    tag, _, rest = key.partition(".")
    tag, _, role = tag.partition("@")
    return tag, role, {part for w in rest.split(".") if w for part in (w, *re.split("[-_]+", w))}


@lru_cache(1 << 16)
def hint(key: str) -> int:
    """2 for a hint at something that is never a frame by its share of the text, 1 for any other hint, else 0."""
    tag, role, words = key_parts(key)
    if tag in ("body", "html") or is_main(key):
        return 0
    if tag in ("nav", "footer", "aside", "head") or words & READERS:
        return 2
    return int(tag in AWAY or role in AWAY_ROLES or bool(words & AWAY_WORDS))


@lru_cache(1 << 16)
def is_main(key: str) -> bool:
    tag, role, _ = key_parts(key)
    return tag in ("article", "main") or role in ("article", "main")


def tag_of(key: str) -> str:
    return key.partition(".")[0].partition("@")[0]


@lru_cache(64)
def end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I)


def blocks_of(page: str) -> list[tuple[str, str, int]]:
    """(path, text, characters in links) of every text block, in page order; the path has the keys of open elements."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []
    is_open: Counter[str] = Counter()
    held: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = SPACE_RUN.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append(("/".join(k for _, k in stack[:DEPTH]), text, min(linked, len(text))))
            held.clear()
        linked = 0

    def close(tag: str, scope: bool) -> None:
        if not is_open[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                flush()
                for t, _ in stack[i:]:
                    is_open[t] -= 1
                del stack[i:]
                return
            if scope and stack[i][0] in SCOPE:
                return

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            held.append(page[at:end])
            if in_link:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag, attributes = (m[1], m[2]) if m[1] else (m[3], m[4])
        if tag is None:
            if m[0].startswith("<![CDATA["):
                held.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        opening = page[m.start() + 1] != "/"
        empty = attributes.endswith("/")
        if tag in RAW:
            if opening and not empty:
                stop = end_of(tag).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in ("script", "style"):
                    at = size
        elif tag in VOID:
            if tag == "hr":
                flush()
            else:
                held.append(" ")
        elif tag not in BLOCK and "-" not in tag:
            if tag == "a":
                in_link = int(opening)
        elif opening:
            flush()
            for t in CLOSES.get(tag, ("p",)):
                close(t, True)
            if not empty:
                stack.append((tag, element_key(tag, attributes)))
                is_open[tag] += 1
        else:
            close(tag, False)
            flush()
    flush()
    return out


# -- wrappers: [key, multiplicity, children]; a text slot has the key "#" ----


def fold(blocks: list[tuple[str, str, int]]) -> list:
    """The page's structure; adjacent siblings of one kind are one repeated element."""
    root = ["", "1", []]
    last: list[str] = []
    trail = [root]
    for path, _, _ in blocks:
        keys = path.split("/") if path else []
        same = 0
        while same < min(len(keys), len(last)) and keys[same] == last[same]:
            same += 1
        if same == len(keys) and last == keys and trail[-1][2] and trail[-1][2][-1][0] == "#":
            # The same path again is another element of the innermost kind.
            trail[-1][1] = "+"
        del trail[same + 1 :]
        for k in keys[same:]:
            siblings = trail[-1][2]
            if siblings and siblings[-1][0] == k:
                siblings[-1][1] = "+"
            else:
                siblings.append([k, "1", []])
            trail.append(siblings[-1])
        if not trail[-1][2] or trail[-1][2][-1][0] != "#":
            trail[-1][2].append(["#", "1", []])
        last = keys
    return settle(root)


def settle(node: list) -> list:
    """Folds equal neighbours that merging has brought together."""
    out: list = []
    for child in map(settle, node[2]):
        if out and out[-1][0] == child[0] != "#":
            merged = align(out[-1], child)
            merged[1] = "*" if "?" in (out[-1][1], child[1]) and "1" not in (out[-1][1], child[1]) and "+" not in (out[-1][1], child[1]) else "+"
            out[-1] = merged
        elif not (out and out[-1][0] == child[0] == "#"):
            out.append(child)
    if len(out) > WIDE:
        kinds: dict[str, list] = {}
        for child in out:
            seen = kinds.get(child[0])
            kinds[child[0]] = child if seen is None else [child[0], "*" if "?" in seen[1] + child[1] or "*" in seen[1] + child[1] else "+", align(seen, child)[2]]
        out = list(kinds.values())
    return [node[0], node[1], out]


def both(a: str, b: str) -> str:
    """The multiplicity that covers both."""
    many, none = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return ("*" if none else "+") if many else ("?" if none else "1")


def align(a: list, b: list) -> list:
    """One wrapper for both: the longest common run of children is merged, the others become optional."""
    x, y = a[2], b[2]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][0] == y[j][0]:
            out.append(align(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j >= len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append([x[i][0], both(x[i][1], "?"), x[i][2]])
            i += 1
        else:
            out.append([y[j][0], both(y[j][1], "?"), y[j][2]])
            j += 1
    return settle([a[0], both(a[1], b[1]), out])


def expression(w: list) -> str:
    """The wrapper written as a regular expression over elements and text slots."""
    inner = " ".join(expression(c) for c in w[2])
    if w[0] == "#":
        return "#" + w[1].replace("1", "")
    if not w[0]:
        return inner
    return f"(<{w[0]}> {inner} </{w[0].partition('.')[0].partition('@')[0]}>){w[1].replace('1', '')}"


def slot_paths(w: list, path: tuple[str, ...] = (), times: str = "") -> Iterator[tuple[str, str]]:
    """(path, multiplicity of each element on it) of every text slot."""
    here, times = ((*path, w[0]), times + w[1]) if w[0] and w[0] != "#" else (path, times)
    if w[0] == "#":
        yield "/".join(here), times
    for c in w[2]:
        yield from slot_paths(c, here, times)


def free_slots(wrapper: list, slots: dict[str, dict], n_texts: int) -> dict[str, tuple[int, bool, str]]:
    """(characters on the whole host, whether mostly links, multiplicities) of the wrapper's slots that are not template text."""
    paths: dict[str, str] = {}
    for p, times in slot_paths(wrapper):
        paths[p] = "".join(map(both, paths[p], times)) if p in paths else times
    fixed = {p for p, s in slots.items() if s["texts"] >= max(FIXED_PAGES, FIXED_SHARE * n_texts) and s["low"] == s["high"] and s["pages"] == s["n"]}
    if all(p in fixed or any(map(hint, p.split("/"))) for p in paths):
        fixed = set()
    links = {p for p, s in slots.items() if s["chars"] and s["linked"] > LINKED * s["chars"]}
    return {p: (slots.get(p, {"chars": 0})["chars"], p in links, times) for p, times in paths.items() if p not in fixed}


def hinted_away(free: list[str], slots: dict[str, tuple[int, bool, str]]) -> set[str]:
    """Slots below an element with a hint that is no frame of the page."""
    keys = {p: p.split("/") for p in free}
    size = {p: 0 if slots[p][1] else slots[p][0] for p in free}
    total = sum(size.values())
    away: set[str] = set()
    below: dict[tuple[str, ...], list[str]] = {}
    for p in free:
        for i, k in enumerate(keys[p]):
            # Within an article, a header may hold its title.
            if hint(k) and not (tag_of(k) == "header" and any(map(is_main, keys[p][:i]))):
                below.setdefault(tuple(keys[p][: i + 1]), []).append(p)
    for e, mine in sorted(below.items(), key=lambda x: len(x[0])):
        rest = {p: keys[p][len(e) :] for p in mine}
        tag = tag_of(e[-1])
        frame = tag not in ("nav", "footer", "aside", "head") and any(any(map(is_main, r)) or (r and tag_of(r[-1]) == "h1" and not any(map(hint, r)) and not slots[p][1]) for p, r in rest.items())
        frame = frame or (hint(e[-1]) == 1 and slots[mine[0]][2][: len(e)].strip("1") == "" and sum(size[p] for p in mine) >= BULK * total > 0)
        if not frame:
            away.update(mine)
    return away


def article_slots(own: Iterable[str], slots: dict[str, tuple[int, bool, str]]) -> frozenset[str]:
    """Of a page's own slots, those that hold its article: a host may have pages of several layouts."""
    free = [p for p in sorted(own) if p in slots]
    away = hinted_away(free, slots)
    free = [p for p in free if p not in away]
    size = {p: 0 if slots[p][1] else slots[p][0] for p in free}
    total = sum(size.values())
    inside = [p for p in free if any(map(is_main, p.split("/")))]
    if inside and sum(size[p] for p in inside) >= MAIN_SHARE * total:
        return frozenset(inside)
    kept = [p for p in free if not slots[p][1]] or free
    root: tuple[str, ...] = ()
    while True:
        under: dict[tuple[str, ...], int] = {}
        for p in kept:
            keys = tuple(p.split("/")) if p else ()
            if len(keys) > len(root) and keys[: len(root)] == root and tag_of(keys[len(root)]) not in LEAF:
                under[keys[: len(root) + 1]] = under.get(keys[: len(root) + 1], 0) + size[p]
        heavy = [k for k, n in under.items() if n > 0.6 * total]
        if not heavy:
            break
        root = heavy[0]
    within = frozenset(p for p in kept if (tuple(p.split("/")) if p else ())[: len(root)] == root)
    if not any(tag_of(p.rsplit("/", 1)[-1]) == "h1" for p in within):
        within |= {p for p in kept if tag_of(p.rsplit("/", 1)[-1]) == "h1"}
    return within


@lru_cache(1 << 16)
def may_be_fixed(path: str) -> bool:
    """Slots whose different page texts are counted: not those of articles, nor those that no count lets in."""
    keys = path.split("/")
    return not any(map(is_main, keys)) and not any(tag_of(k) in ("nav", "footer", "aside", "head") for k in keys)


# -- Spark ------------------------------------------------------------------


def page_facts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, structure, n) and (host, path, pages, chars, linked, low, high, n, texts) of all pages (host, html).

    ``texts``: different page texts with the slot, where it can be template text; without a path, all of the host.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "html", SLICE_BYTES):
                structures: dict[tuple[str, str], int] = {}
                slots: dict[tuple[str, str], list] = {}
                seen_in: set[tuple[str, str | None, int]] = set()
                for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    blocks = blocks_of(page or "")
                    if not blocks:
                        continue
                    key = host, json.dumps(fold(blocks), separators=(",", ":"))
                    structures[key] = structures.get(key, 0) + 1
                    seen = set()
                    whole = xxhash.xxh64_intdigest("\0".join(t for _, t, _ in blocks).encode("utf-8", "replace")) - (1 << 63)
                    seen_in.add((host, None, whole))
                    for path, text, linked in blocks:
                        h = zlib.crc32(text.encode("utf-8", "replace"))
                        s = slots.setdefault((host, path), [0, 0, 0, h, h, 0])
                        s[0] += path not in seen
                        s[1] += len(text)
                        s[2] += linked
                        s[3], s[4] = min(s[3], h), max(s[4], h)
                        s[5] += 1
                        seen.add(path)
                    seen_in.update((host, p, whole) for p in seen if may_be_fixed(p))
                rows = [{"host": h, "structure": s, "path": None, "whole": None, "n": n, "pages": None, "chars": None, "linked": None, "low": None, "high": None} for (h, s), n in structures.items()]
                rows += [{"host": h, "structure": None, "path": p, "whole": None, "n": s[5], "pages": s[0], "chars": s[1], "linked": s[2], "low": s[3], "high": s[4]} for (h, p), s in slots.items()]
                rows += [{"host": h, "structure": None, "path": p, "whole": w} for h, p, w in seen_in]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("host", pa.string()), ("structure", pa.string()), ("path", pa.string()), *[(c, pa.int64()) for c in ("whole", "n", "pages", "chars", "linked", "low", "high")]]))

    facts = pages.select("host", "html").mapInArrow(run, "host string, structure string, path string, whole long, n long, pages long, chars long, linked long, low long, high long")
    facts = cut(facts.groupBy("host", "structure", "path", "whole").agg(*[F.sum(c).alias(c) for c in ("n", "pages", "chars", "linked")], F.min("low").alias("low"), F.max("high").alias("high")))
    counts = [F.sum(c).alias(c) for c in ("n", "pages", "chars", "linked")]
    slots = facts.filter("structure is null").groupBy("host", "path").agg(*counts, F.min("low").alias("low"), F.max("high").alias("high"), F.count("whole").alias("texts"))
    return facts.filter("structure is not null").select("host", "structure", "n"), slots


def merge_structures(texts: list[str]) -> list:
    """The wrapper of sorted distinct structures."""
    wrapper: list | None = None
    for t in texts:
        w = json.loads(t)
        wrapper = w if wrapper is None else align(wrapper, w)
    return wrapper or ["", "1", []]


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, article): for each host of pages (host, html) the expression and the JSON of its free slots."""
    structures, slots = page_facts(pages)
    packed = "host string, structure string"

    def first(table: pa.Table) -> pa.Table:
        return pa.table({"host": table.column("host")[:1], "structure": pa.array([json.dumps(merge_structures(sorted(table.column("structure").to_pylist())), separators=(",", ":"))])})

    merged, few = structures.select("host", "structure"), None
    while True:
        many = merged.groupBy("host").agg(F.count("*").alias("k")).filter(F.col("k") > FAN)
        if not many.limit(1).count():
            break
        rest = merged.join(many, "host", "left_anti")
        few = rest if few is None else few.unionByName(rest)
        part = F.pmod(F.xxhash64("structure"), F.ceil(F.col("k") / FAN)).cast("int")
        merged = cut(merged.join(many, "host").select("host", "structure", part.alias("part")).groupBy("host", "part").applyInArrow(lambda t: first(t), packed))
    merged = merged if few is None else few.unionByName(merged)

    def second(table: pa.Table) -> pa.Table:
        wrapper = merge_structures(sorted(x for x in table.column("structure").to_pylist() if x is not None))
        rows = [r for r in table.to_pylist() if r["path"] is not None]
        n_texts = max((x for x, p in zip(table.column("texts").to_pylist(), table.column("path").to_pylist(), strict=True) if x is not None and p is None), default=0)
        article = free_slots(wrapper, {r["path"]: r for r in rows}, n_texts)
        return pa.table({"host": table.column("host")[:1], "wrapper": pa.array([expression(wrapper)]), "article": pa.array([json.dumps(article)])})

    nulls = [F.lit(None).cast("long").alias(c) for c in ("n", "pages", "chars", "linked", "low", "high", "texts")]
    union = merged.select("host", "structure", F.lit(None).cast("string").alias("path"), *nulls).unionByName(slots.withColumn("structure", F.lit(None).cast("string")))
    return union.groupBy("host").applyInArrow(second, "host string, wrapper string, article string")


def with_wrapper(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Each page with its host's wrapper: broadcast if all wrappers are few bytes, else joined on host and salt, so that a hot host's pages are dealt out."""
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("article") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wrappers), "host", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
    return salted.join(wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left").drop("salt")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, wrapper)"""
    host, _ = host_and_path("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host)
    wrappers = cut(infer_wrappers(rows))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[dict, dict]] = {}
        for batch in batches:
            for part in T.slices(batch, "html", SLICE_BYTES):
                texts = []
                for page, article in zip(part.column("html").to_pylist(), part.column("article").to_pylist(), strict=True):
                    if not page or article is None:
                        texts.append("")
                        continue
                    if article not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[article] = json.loads(article), {}
                    free, chosen = known[article]
                    blocks = blocks_of(page)
                    own = frozenset(p for p, _, _ in blocks)
                    if own not in chosen:
                        if len(chosen) > 10_000:
                            chosen.clear()
                        chosen[own] = article_slots(own, free)
                    texts.append("\n\n".join(t for p, t, _ in blocks if p in chosen[own]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), part.column("wrapper")], names=["page_id", "url", "text", "wrapper"])

    return with_wrapper(rows, wrappers).select("page_id", "url", "html", "wrapper", "article").mapInArrow(run, "page_id bigint, url string, text string, wrapper string")
