"""Operator 6: URL filtering by host rules and by pattern rules indexed by their rarest literal token. DataFrame functions only.

Rules are tables. A pattern rule stands in the index under that of its literal tokens which fewest urls hold; a url's tokens are looked
up there by a hash join, and only the fetched rules run their expressions. Host rules are found likewise, by the url's host suffixes and
those prefixes of its path whose lengths the host's rules have. So the work for a url does not grow with the number of rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise


class HostRule(NamedTuple):
    """Fits a host and its subdomains where the path starts with `path`; the longest fitting rule decides."""

    host: str
    path: str
    verdict: str


class PatternRule(NamedTuple):
    """A regular expression over the lower-case url; `tokens` are literal tokens that every match contains whole."""

    name: str
    tokens: tuple[str, ...]
    pattern: str


HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)
#: Block lists of this kind name shops, farms, trackers and binaries by whole tokens of a url.
PATTERN_RULES = (
    PatternRule("pills", ("cheap", "pills"), r"://([^/?#]*[.])?cheap-pills[.]"),
    PatternRule("spam farm", ("spam", "farm"), r"://([^/?#]*[.])?spam-farm[.]"),
    PatternRule("casino", ("casino",), r"[./-]casino[./-]"),
    PatternRule("adult", ("xxx",), r"[./-]xxx[./-]"),
    PatternRule("tracker", ("utm", "source", "spam"), r"[?&]utm_source=spam(&|#|$)"),
    PatternRule("binary", ("exe",), r"[.]exe([?#]|$)"),
)
#: Bytes of a rule table, or of the decided urls, up to which they are broadcast; beyond it both sides of a lookup shuffle.
BROADCAST_BYTES = 32 << 20
HOST_SCHEMA, PATTERN_SCHEMA = "host string, path string, verdict string", "name string, tokens array<string>, pattern string"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def as_table(spark: SparkSession, rules: Iterable[NamedTuple] | DataFrame, schema: str) -> DataFrame:
    """Rules as a DataFrame; a list of them goes in as one literal."""
    if isinstance(rules, DataFrame):
        return rules.select(*(c.split()[0] for c in schema.split(", ")))
    text = json.dumps([r._asdict() for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def lookup(rules: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its measured size allows that."""
    size = rules.select(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rules.columns)))), F.lit(0))).first()[0]
    return F.broadcast(rules) if size <= BROADCAST_BYTES else rules


def index_of(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """token, name, pattern: each rule (name, tokens, pattern) under that of its tokens which fewest rows of urls (url) hold (ties: the
    lesser token)."""
    named = rules.select("name", "pattern", F.explode(F.array_distinct("tokens")).alias("token"))
    asked = lookup(named.select("token").distinct())
    seen = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(asked, "token").groupBy("token").agg(F.count("*").alias("n"))
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")
    return named.join(seen, "token", "left").groupBy("name", "pattern").agg(F.min(place)["token"].alias("token")).select("token", "name", "pattern")


def matching_patterns(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, name: the pattern rules that match each row of urls (url)."""
    index = lookup(materialise(index_of(urls, rules)))
    asked = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    return asked.join(index, "token").where(F.regexp_like(F.lower("url"), F.col("pattern"))).select("url", "name")


def fitting_hosts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, host, path, verdict (of the rule): the host rules that fit each row of urls (url)."""
    rules = rules.select(F.col("host").alias("of"), F.col("path").alias("prefix"), "verdict")
    deepest = rules.select(F.coalesce(F.max(F.size(F.split("of", "[.]"))), F.lit(0))).first()[0]
    if not deepest:
        return urls.select("url", F.lit("").alias("host"), F.lit("").alias("path"), F.lit("").alias("verdict")).where("false")
    hosts = rules.groupBy("of").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # as many as rules' paths have characters
    suffixes = F.expr(f"transform(sequence(1, least(size(labels), {deepest})), d -> array_join(slice(labels, -d, d), '.'))")
    parts = urls.select("url", path_of(F.col("url")).alias("path"), F.split(host_of(F.col("url")), "[.]").alias("labels"))
    found = parts.select("url", "path", F.explode(suffixes).alias("of")).join(lookup(hosts), "of")
    prefixes = F.expr("transform(filter(lengths, n -> n <= length(path)), n -> substring(path, 1, n))")
    return found.select("url", "of", F.explode(prefixes).alias("prefix")).join(lookup(rules), ["of", "prefix"]).select("url", F.col("of").alias("host"), F.col("prefix").alias("path"), "verdict")


def judge(pages: DataFrame, host_rules: Iterable[HostRule] | DataFrame = HOST_RULES, pattern_rules: Iterable[PatternRule] | DataFrame = PATTERN_RULES) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, pattern.

    rule: the longest fitting host rule as host + path (of two of one length the one with the longer host, of two with one host and
    path the blocking one), else null. verdict: that rule's; else block if a pattern rule matches (pattern: the least of their
    names), else allow. Null urls and those without :// have empty host and path, fit no rule and are allowed unless a pattern
    matches. Repeated rows stay, an empty table gives no rows. Rules, of any number, are lists or tables of the fields of HostRule and
    PatternRule; a pattern rule without tokens can't be indexed and raises. No Python workers. Urls are decided once each, with
    partial results before the shuffle, so a url that a third of all rows have costs one row a task.
    """
    spark = pages.sparkSession
    urls = pages.select("url").where("url is not null")
    hosts, patterns = as_table(spark, host_rules, HOST_SCHEMA), as_table(spark, pattern_rules, PATTERN_SCHEMA)
    if not patterns.where("tokens is null or size(tokens) = 0").isEmpty():
        raise ValueError("a pattern rule names no literal token")
    rule = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("of_host"), "verdict", F.concat("host", "path").alias("rule"))
    none = lambda x: F.lit(None).cast(x)
    by_host = fitting_hosts(urls, hosts).groupBy("url").agg(F.max(rule).alias("best")).withColumn("pattern", none("string"))
    by_pattern = matching_patterns(urls, patterns).groupBy("url").agg(F.min("name").alias("pattern"))
    both = by_host.unionByName(by_pattern.select("url", none("struct<n:int,of_host:int,verdict:string,rule:string>").alias("best"), "pattern"))
    decided = materialise(both.groupBy("url").agg(F.max("best").alias("best"), F.min("pattern").alias("pattern")))
    decided = lookup(decided)
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    out = pages.select("page_id", "url").join(decided, "url", "left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"), "pattern")


def judge_sql(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> str:
    """The same in DuckDB SQL, each pattern run over every url."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    by_length = sorted(host_rules, key=lambda r: (-len(r.host + r.path), -len(r.host)))
    fit = lambda r: f"(host = {q(r.host)} OR host LIKE {q('%.' + r.host)}) AND starts_with(path, {q(r.path)})"
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN {q(r.host + r.path)}" for r in by_length) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fit(r)} THEN {q(r.verdict)}" for r in by_length) + " WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END"
    pattern = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), {q(r.pattern)}) THEN {q(r.name)}" for r in sorted(pattern_rules)) + " END"
    return f"""
WITH parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages), matched AS (SELECT *, {pattern} AS pattern FROM parts)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, pattern FROM matched"""


def check_rules(rules=PATTERN_RULES) -> None:
    """Every pattern must compile and name at least one token."""
    for r in rules:
        re.compile(r.pattern)
        if not r.tokens:
            raise ValueError(r.name)
