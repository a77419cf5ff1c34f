"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` plus the literal tokens that every match must hold. Each rule
is filed under that one of its tokens which the fewest URLs hold (counted over the whole table, for the rules'
tokens only). A URL's tokens look up candidate rules, and only those run their expressions. Everything happens
within a row: no join and no shuffle, so a host with a third of all rows costs no more than its rows.

The rule list is configuration. Its most frequent tokens' rules travel as one literal of at most INDEX_BYTES. What goes
beyond is a written table which those URL tokens join that a filter finds among its own, and the best rule of each row
comes back to it; rules of hot tokens stay within the row, so no hot key is shuffled.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule, and the default verdict;
repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, measured_side, numbered, read_table
from .decontaminate import Tokens

#: Bytes of the rule index that are shipped with each task; rules beyond are joined.
INDEX_BYTES = 16 << 20


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is matched against host + path; ``tokens`` must stand whole in every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0
    named: bool = field(default=True)


def _tokens(text: str) -> list[str]:
    return [t for t in re.split("[^0-9A-Za-z]+", text) if t]


def prefix_rule(host: str, path: str, verdict: str) -> UrlRule:
    """Fits the host and its subdomains where the path starts with ``path``; the longest rule wins."""
    whole = re.match(r"(?s)(.*[^0-9A-Za-z])?", path)[0]  # a last token may go on in the URL
    return UrlRule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(_tokens(host) + _tokens(whole)), len(host + path))


def word_rule(words: str, verdict: str) -> UrlRule:
    """Fits where the words stand in the host as a run of whole words joined by one ``.``, ``-`` or ``_`` each."""
    parts = _tokens(words)
    return UrlRule(words, verdict, r"^(?:[^/]*[^0-9a-z/])?" + "[-._]".join(parts) + "(?![0-9a-z])", tuple(parts), len(words), named=False)


#: Fixed rules of the query.
BASE_RULES = (
    prefix_rule("com", "/", "allow"),
    prefix_rule("example.com", "/en/", "block"),
    prefix_rule("www.example.com", "/en/", "allow"),
    prefix_rule("net", "/es/", "block"),
    prefix_rule("net", "/fr/", "block"),
)

#: The method's own rules: they judge what no rule above fits.
OWN_RULES = tuple(word_rule(w, "block") for w in ("spam farm", "cheap pills", "casino", "click bait", "free money", "porn", "xxx"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as strings that are never null."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("url")))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rarest_token_index(rules: list[UrlRule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Files each rule under its rarest token (ties: the longer, then the smaller token); under "" if it has none."""
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=""), []).append(i)
    return index


def token_counts(urls: DataFrame, subject: Column, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; at most one row for each such token reaches the driver."""
    if not tokens:
        return {}
    held = urls.select(F.explode(F.array_distinct(F.split(subject, "[^0-9A-Za-z]+"))).alias("t")).where(F.col("t").isin(sorted(tokens)))
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


RULE = "struct<named:boolean,rank:int,name:string,verdict:string,pattern:string>"


def _row_of(rule: UrlRule) -> dict:
    return {"named": rule.named, "rank": rule.rank, "name": rule.name, "verdict": rule.verdict, "pattern": rule.pattern}


def _url_tokens(subject: Column) -> Column:
    """The distinct tokens of a URL and "", under which rules without a token are filed."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(subject, "[^0-9A-Za-z]+")))


def _split(urls: DataFrame, key: str, url: str, *more: Column) -> DataFrame:
    """(page_id, host, path, s) and more columns; s is what rules are matched against."""
    given = urls.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), *more)
    host, path = split_url(F.col("url"))
    parts = given.select("*", host.alias("host"), path.alias("path")).drop("url")
    return parts.select("*", F.concat("host", "path").alias("s"))


def _fits(rule: Column) -> Column:
    return F.expr("host != ''") & F.rlike(F.col("s"), rule["pattern"])


def _in_row(split: DataFrame, buckets: list[list[dict]]) -> DataFrame:
    """split with n (candidates) and b, the best rule that fits: the index is a literal, looked up within the row."""
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<t:string,r:array<{RULE}>>>>")
    slot = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(len(buckets))).cast("int")
    filed = F.flatten(F.transform(_url_tokens(F.col("s")), lambda t: F.filter(F.get(table, slot(t)), lambda e: e["t"] == t)))
    candidates = split.select("*", F.flatten(F.transform(filed, lambda e: e["r"])).alias("c"))
    return candidates.select("*", F.size("c").alias("n"), F.array_max(F.filter(F.col("c"), _fits)).alias("b")).drop("c")


def _joined(split: DataFrame, entries: list[dict]) -> DataFrame:
    """(_row, n, b) of the rows that hold tokens of the entries: the written rules are joined by those tokens alone."""
    rules = materialize(split.sparkSession.createDataFrame([(e["t"], r) for e in entries for r in e["r"]], f"t string, r {RULE}"), "rules")
    known = Tokens(materialize(rules.select(F.col("t").alias("token"), F.lit(1).alias("size")).distinct(), "rule-tokens"))
    width = F.octet_length("t") + F.octet_length("r.name") + F.octet_length("r.pattern") + F.octet_length("r.verdict") + 48
    tokens = split.select("_row", "host", "s", F.explode(F.filter(_url_tokens(F.col("s")), lambda t: known(t, 1))).alias("t"))
    found = tokens.join(measured_side(rules, width), "t").select("_row", F.when(_fits(F.col("r")), F.col("r")).alias("r"))
    return found.groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("r").alias("b"))


def judge_urls(urls: DataFrame, rules: list[UrlRule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Returns key, host, path, rule (null if no named rule fits), verdict and n_candidates for every row of urls."""
    split = _split(urls, key, url)
    counts = token_counts(split, F.col("s"), {t for r in rules for t in r.tokens})
    entries = [{"t": t, "r": [_row_of(rules[i]) for i in filed]} for t, filed in rarest_token_index(rules, counts).items()]
    entries.sort(key=lambda e: (e["t"] != "", -counts.get(e["t"], 0), e["t"]))  # the most frequent tokens stay within the row
    ends = list(accumulate(len(json.dumps(e)) + 8 for e in entries))
    fit = bisect_right(ends, INDEX_BYTES)
    buckets: list[list[dict]] = [[] for _ in range(max(1, 2 * fit))]
    for e in entries[:fit]:
        buckets[_bucket(e["t"], len(buckets))].append(e)
    if fit == len(entries):
        judged = _in_row(split, buckets)
    else:
        rows, row = numbered(urls)
        split = _split(rows, key, url, F.col(row).alias("_row"))
        more = _joined(split, entries[fit:]).select("_row", F.col("n").alias("n2"), F.col("b").alias("b2"))
        judged = _in_row(split, buckets).join(more, "_row", "left")
        judged = judged.select("page_id", "host", "path", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("b", "b2").alias("b"))
    return judged.select("page_id", "host", "path", F.when(F.col("b.named"), F.col("b.name")).alias("rule"), F.coalesce(F.col("b.verdict"), F.lit(default)).alias("verdict"), F.col("n").alias("n_candidates"))


def _bucket(token: str, n: int) -> int:
    import zlib

    return zlib.crc32(token.encode()) % n


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judge_urls(pages, [*BASE_RULES, *OWN_RULES]).select("page_id", "host", "path", "rule", "verdict")


_OWN_SQL = " OR ".join(f"regexp_matches(host, '(^|[^0-9a-z]){w.name.replace(' ', '[-._]')}($|[^0-9a-z])')" for w in OWN_RULES)

OP1_SQL = f"""
WITH s AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s
), r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT p.*, (SELECT max({{'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': rverdict}}) FROM r
               WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS b FROM p
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, CASE WHEN {_OWN_SQL} THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""
