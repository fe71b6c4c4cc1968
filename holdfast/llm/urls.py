"""URL filters: pattern rules behind an index of literal tokens.

A rule is a regular expression over host + path (or the whole url) that names the literal tokens
any matching url must contain as whole tokens. Each rule is filed under the one of its tokens that
is rarest in the corpus; the tokens of a url fetch the rules filed under them, and only those run
their expression. Matches are folded per distinct url before they meet the table again.

Cases: a null url, or one without `://`, has an empty host and path and fits no rule; a port or
user name stays part of the host; equal rule lengths cannot tie, as equal rules are one rule;
repeated urls get the same answer; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import LOWER, UPPER

TOKEN = "[a-z0-9]+"
ADDED = ("host", "path", "rule", "verdict")  # replace columns of these names


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # Java regular expression over host + path, or over the url in lower case
    tokens: tuple[str, ...]
    anchored: bool  # host/path rules win over the others, the longest first


def site_rule(verdict: str, site: str) -> Rule:
    """`example.com/en/`: the host, its subdomains, and paths that start so."""
    host, path = site.split("/", 1)
    pattern = rf"^(?:[^/]*\.)?{escape(host)}/{escape(path)}"
    # a path's last piece may go on; the others and the host's labels are whole tokens
    whole = path.lower().split("/")[:-1] if "/" in path else []
    tokens = tuple(t for t in (*host.split("."), *whole) if t.isascii() and t.isalnum())
    return Rule(site, verdict, pattern, tokens, True)


def word_rule(verdict: str, name: str, *words: str) -> Rule:
    """The words one after another as whole tokens, anywhere in the url."""
    joined = "[^a-z0-9]+".join(words)
    return Rule(name, verdict, rf"(?:^|[^a-z0-9]){joined}(?:[^a-z0-9]|$)", words, False)


# The site list of the filter.
SITES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
# Word rules of the filter's own.
WORDS = (("spam-farm",), ("adult",), ("porn",), ("casino",), ("viagra",), ("xxx",),
         ("wp", "login"), ("click", "bait"))


def default_rules() -> list[Rule]:
    return [*(site_rule(v, s) for v, s in SITES),
            *(word_rule("block", "-".join(w), *[p for x in w for p in x.split("-")])
              for w in WORDS)]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER),
                                                 F.lit(f"({TOKEN})"), 1))


def judge(pages: DataFrame, rules: Sequence[Rule] | None = None, url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """Add host, path, rule (the winning site rule, or null) and verdict to every row."""
    rules = default_rules() if rules is None else list(rules)
    spark = pages.sparkSession
    parsed = pages.select(
        F.struct(*[c for c in pages.columns if c not in ADDED]).alias("row"), pages[url_col].cast("string").alias("url"),
        host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    if not rules:
        return parsed.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"),
                             F.lit(default).alias("verdict"))
    urls = parsed.where(F.col("host") != "").groupBy("url", "host", "path").agg(
        F.count(F.lit(1)).alias("n"))
    tokens = urls.select("*", F.explode(_tokens(F.col("url"))).alias("token"))
    listed = spark.createDataFrame(
        [(n, t) for n, r in enumerate(rules) for t in dict.fromkeys(r.tokens)],
        "rule_no int, token string")
    # how common each literal is: one row per literal, summed on the map side
    common = tokens.join(F.broadcast(listed.select("token").distinct()), "token").groupBy(
        "token").agg(
        F.sum("n").alias("uses"))
    filed = listed.join(common, "token", "left").groupBy("rule_no").agg(
        F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token")).alias("rarest"))
    bodies = spark.createDataFrame(
        [(n, r.name, r.verdict, r.pattern, r.anchored) for n, r in enumerate(rules)],
        "rule_no int, name string, says string, pattern string, anchored boolean")
    index = bodies.join(filed, "rule_no", "left").select(
        "name", "says", "pattern", "anchored", F.col("rarest.token").alias("token"))
    # both rule tables are as large as the list of rules the caller holds
    fetched = tokens.join(F.broadcast(index.where(F.col("token").isNotNull())), "token")
    if any(not r.tokens for r in rules):  # rules without a literal have to be tried everywhere
        bare = [F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("says"),
                         F.lit(r.pattern).alias("pattern"), F.lit(r.anchored).alias("anchored"))
                for r in rules if not r.tokens]
        fetched = fetched.select("url", "host", "path", "name", "says", "pattern", "anchored"
                                 ).unionByName(urls.select(
                                     "url", "host", "path",
                                     F.inline(F.array(*bare))))
    hits = fetched.where(F.expr("regexp(IF(anchored, concat(host, path), "
                                f"translate(url, '{UPPER}', '{LOWER}')), pattern)"))
    site = F.when(F.col("anchored"), F.struct(F.length("name").alias("size"), "name", "says"))
    found = hits.groupBy("url").agg(
        F.max(site).alias("site"),
        F.max(F.when(~F.col("anchored") & (F.col("says") == "block"), 1)).alias("blocks"),
        F.max(F.when(~F.col("anchored") & (F.col("says") == "allow"), 1)).alias("allows"))
    verdict = F.coalesce(F.col("site.says"), F.when(F.col("allows") == 1, "allow").when(
        F.col("blocks") == 1, "block"), F.lit(default))
    return parsed.join(found, "url", "left").select(
        "row.*", "host", "path", F.col("site.name").alias("rule"), verdict.alias("verdict"))
