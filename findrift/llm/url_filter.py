"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over the canonical url (lower-cased host
followed by the path) plus the whole tokens that any url it matches must
contain.  A rule is filed under the one of its tokens that the fewest urls
hold; the tokens of a url fetch the rules filed under them, and only those
rules run their regular expression.  Everything is DataFrame code.

Defined cases: a null url, or one without ``://``, has empty host and path and
meets no rule that needs a token; repeated rows and null ids are judged row by
row; an empty table gives an empty result; other columns of ``pages`` pass by
untouched unless the caller selects them.  Among host/path rules the longest
wins (then the larger text); among pattern rules the highest priority wins,
then block before allow, then the smallest id.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = "[^0-9a-z]+"
_RULE_SCHEMA = "rule_id string, kind string, pattern string, tokens array<string>, verdict string, priority int"

#: Host words that the default pattern rules block (whole words of the host).
BLOCKED_WORDS = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(_SPLIT, text.lower()) if t]


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() else "\\x{%x}" % ord(c) for c in text)


def host_rule(host: str, path: str, verdict: str) -> tuple:
    """A host (with all its subdomains) and a path prefix."""
    # the last token of a path that does not end in a separator may go on in the url
    whole = re.sub(r"[0-9A-Za-z]+$", "", path)
    pattern = r"^(?:[^/]*\.)?" + _quote(host.lower()) + (_quote(path) if path else "(?:/|$)")
    return (host + path, "host", pattern, _tokens(host) + _tokens(whole), verdict, len(host + path))


def word_rule(word: str, verdict: str, priority: int = 0) -> tuple:
    """A run of whole words anywhere in host or path."""
    return (word, "pattern", "(?:^|[^0-9a-z])" + _quote(word) + "(?:[^0-9a-z]|$)", _tokens(word), verdict, priority)


def pattern_rule(rule_id: str, pattern: str, tokens: Iterable[str], verdict: str, priority: int = 0) -> tuple:
    """Any regular expression, with whole tokens that a match must contain (maybe none)."""
    return (rule_id, "pattern", pattern, [t for x in tokens for t in _tokens(x)], verdict, priority)


def default_patterns() -> list[tuple]:
    return [word_rule(w, "block") for w in BLOCKED_WORDS]


def rules_table(spark: SparkSession, rules: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rules), _RULE_SCHEMA)


def split_url(url) -> tuple:
    """(host, path) columns of a url column."""
    u = F.coalesce(url, F.lit(""))
    parts = "://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, parts, 1), UPPER, LOWER), F.regexp_extract(u, parts, 2)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row: ``id_col``, host, path, rule, pattern, verdict.

    ``rule`` is the host/path rule that decided, ``pattern`` the pattern rule
    that decided where no host/path rule fits, verdict ``allow`` without either.

    Each distinct url is judged once, so a url that holds a third of all rows
    costs one judgement; the way back is one equi-join on the url.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"),
                        host.alias("_host"), path.alias("_path"))
    urls = (rows.select(F.concat("_host", "_path").alias("_key")).distinct()
            .withColumn("_token", F.explode(F.array_union(
                F.array(F.lit("")), F.split(F.translate("_key", UPPER, LOWER), _SPLIT)))))

    # where each rule is filed: its token in the fewest urls ('' if it has none)
    wanted = rules.select("rule_id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens"))
                                               .otherwise(F.array(F.lit("")))).alias("_token"))
    held = urls.join(wanted.select("_token").distinct(), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_n"))
    filed = (wanted.join(held, "_token", "left").fillna(0, ["_n"])
             .groupBy("rule_id").agg(F.min(F.struct("_n", "_token"))["_token"].alias("_token")))
    index = rules.join(filed, "rule_id")

    best = (urls.join(index, "_token").where(F.expr("_key rlike pattern"))
            .groupBy("_key")
            .agg(F.max(F.when(F.col("kind") == "host", F.struct("priority", "rule_id", "verdict"))).alias("_rule"),
                 F.min(F.when(F.col("kind") == "pattern", F.struct(
                     (-F.col("priority")).alias("p"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("o"),
                     F.col("rule_id"), F.col("verdict")))).alias("_pattern")))
    keyed = rows.withColumn("_key", F.concat("_host", "_path"))
    return (keyed.join(best, "_key", "left")
            .select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                    F.col("_rule.rule_id").alias("rule"),
                    F.when(F.col("_rule").isNull(), F.col("_pattern.rule_id")).alias("pattern"),
                    F.coalesce("_rule.verdict", "_pattern.verdict", F.lit("allow")).alias("verdict")))
