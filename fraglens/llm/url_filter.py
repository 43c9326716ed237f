"""URL filters: pattern rules behind an index of their rarest literal tokens.

A block rule is a regular expression with the literal tokens (runs of a-z, 0-9)
that any URL it matches must have as whole tokens; ``literal_tokens`` finds them in
an expression. Rules are a list or a table of any size (name, pattern and, if
given, tokens). Each rule is filed under the one of its tokens that is the rarest
among all URLs. A URL's own tokens fetch candidate rules by an equi-join, and only
candidates run their regular expression. Rules without such a token are an error,
since every URL would have to run them. Host rules (allow or block a host and its
subdomains below a path, the longest rule wins) take precedence over that verdict.

All of it is DataFrame functions. The verdict depends on the URL alone, so each
distinct URL is judged once. URLs give their tokens once: those that some rule has
are kept, counted for the index, and joined with it. Blocked URLs, which are few,
are joined back; a hot URL is split by the skew join. Rules are broadcast only while
their number is at most ``broadcast_rules``; beyond, the joins are by exchange.

Special cases: a null or schemeless URL has an empty host and path, no rule, and
is allowed unless a pattern matches it (null: allowed); URLs of any length are
matched whole; tokens are compared in lower case; of several matching patterns the
first name is given; repeated rows get a row each; an empty table or no rule gives
no block; extra columns, whatever their names, are kept if named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import cut

#: Host rules of the query: action, host, path.
HOST_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Block patterns: name, literal tokens, regular expression over the URL with A-Z lower-cased.
PATTERNS = [
    ("cheap goods", ["cheap", "pills"], r"[/.]cheap-pills\."),
    ("bets", ["free", "bets"], r"[/.]free-bets\."),
    ("link farms", ["spam", "farm"], r"[/.]spam-farm\."),
    ("casinos", ["casino"], r"^[a-z]+://[^/?#]*\bcasino\b"),
    ("adult", ["porn"], r"^[a-z]+://[^/?#]*\bporn\b"),
    ("adult sections", ["xxx"], r"[/.]xxx[/.]"),
    ("advert scripts", ["adserver"], r"[/.]adserver[/.?]"),
    ("trackers", ["doubleclick"], r"[/.]doubleclick\."),
    ("affiliate links", ["affiliate", "id"], r"[?&]affiliate[_-]id="),
    ("session links", ["phpsessid"], r"[?&;]phpsessid="),
    ("log-in pages", ["login"], r"/login([/?.]|$)"),
    ("shop baskets", ["add", "to", "cart"], r"[/?&]add-to-cart="),
    ("executables", ["exe"], r"\.exe([?#]|$)"),
]


def host_and_path(url: str) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/``, ``?``, ``#``, A-Z lower-cased; the path up to ``?``, ``#``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.expr(f"substring(coalesce({url}, ''), locate('://', coalesce({url}, '')) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def lowered(url: str) -> Column:
    return F.translate(F.col(url), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matching_host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, action), else null."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def literal_tokens(pattern: Column) -> Column:
    """Whole tokens that every match of a regular expression has: runs of lower-case letters and digits with a literal sign, a word border or an anchor on either side.

    What stands in classes or groups, what a quantifier repeats or leaves out, and expressions with alternatives count for nothing.
    """
    open_ = "\u0001"  # stands for what is not known
    steps = [
        (r"\\b", "/"), (r"\\[^a-zA-Z0-9]", "/"), (r"\\[a-zA-Z0-9]", open_), (r"\[-?[^\]^a-zA-Z0-9\x01-]*-?\]", "/"), (r"\[[^\]]*\]", open_), (r"\([^()]*\)", open_), (r"\([^()]*\)", open_),
        (r".(?:[?*+]|\{[^}]*\})", open_), (r"[.A-Z]", open_), (r"^(?!\^)", open_), (r"(?<!\$)$", open_),
    ]
    bare = pattern
    for find, put in steps:
        bare = F.regexp_replace(bare, find, put)
    whole = F.filter(F.split(bare, r"[^a-z0-9\x01]+"), lambda t: (t != "") & ~t.contains(open_))
    return F.when(bare.rlike(r"[|()\[\]]"), F.array().cast("array<string>")).otherwise(F.array_distinct(whole))


def rule_table(rules: DataFrame) -> DataFrame:
    """(name, token, pattern) of a table of rules (name, pattern and, if given, tokens); patterns without any token are an error."""
    tokens = F.coalesce("tokens", literal_tokens(F.col("pattern"))) if "tokens" in rules.columns else literal_tokens(F.col("pattern"))
    some = F.when(F.size(tokens) > 0, tokens).otherwise(F.raise_error(F.concat(F.lit("no literal token in rule "), "name")).cast("array<string>"))
    return rules.select("name", F.explode(some).alias("token"), "pattern")


def blocked_urls(urls: DataFrame, patterns: list[tuple[str, list[str], str]] | DataFrame, broadcast_rules: int = 10_000) -> DataFrame:
    """(url, pattern): distinct URLs with a matching pattern, and the first such name."""
    spark = urls.sparkSession
    given = patterns if isinstance(patterns, DataFrame) else spark.createDataFrame(patterns, "name string, tokens array<string>, pattern string")
    # A count that stops beyond the bound tells whether the rules are few.
    few = given.limit(broadcast_rules + 1).count() <= broadcast_rules
    small = F.broadcast if few else lambda df: df
    rules = rule_table(given)
    low = urls.select("url").filter("url is not null").distinct().withColumn("low", lowered("url"))
    tokens = low.select("url", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), 0))).alias("token"))
    held = cut(tokens.join(small(rules.select("token").distinct()), "token", "left_semi"))
    # How often each rule token occurs; a token that no URL has is the rarest.
    seen = held.groupBy("token").agg(F.count("*").alias("n"))
    index = rules.join(seen, "token", "left").groupBy("name", "pattern").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    hits = held.join(small(index), "token").filter(F.expr("low rlike pattern"))
    return hits.groupBy("url").agg(F.min("name").alias("pattern"))


def filter_urls(pages: DataFrame, url_col: str = "url", carry: tuple[str, ...] = ("page_id",), host_rules: list[tuple[str, str, str]] = HOST_RULES, patterns: list[tuple[str, list[str], str]] | DataFrame = PATTERNS) -> DataFrame:
    """The columns ``carry``, host, path, rule, verdict, and the block pattern if one matched."""
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(carry)], F.col(url_col).cast("string").alias("url"))
    hits = blocked_urls(rows, patterns)
    host, path = host_and_path("url")
    judged = rows.join(hits, "url", "left").withColumns({"host": host, "path": path})
    judged = judged.withColumn("found", matching_host_rule(F.col("host"), F.col("path"), host_rules))
    verdict = F.coalesce("found.action", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)], "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "pattern")
