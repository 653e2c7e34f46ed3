"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` with the literal tokens that each of its matches must hold.
Token frequencies are counted over the URLs themselves; a rule is filed under its rarest token. A URL is split into
tokens, the tokens fetch candidate rules by an equi-join, and only those candidates run their expression. Distinct
URLs are judged once and the verdict is joined back to the rows, so a URL that holds a third of the rows costs one
evaluation. DataFrame functions only.

Edge cases: a null URL or one without ``://`` has an empty host and path and gets the default verdict; repeated rows
each get a row; an empty table gives an empty result; further columns of the input are ignored; a rule without any
literal token is filed under the empty token, which every URL carries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import read, register

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATOR = "[^0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """``pattern``: Java regular expression searched in host + path. ``tokens``: literal tokens (runs of ASCII letters
    and digits, bounded by other characters) of every match. ``name`` is reported when the rule decides. Among the
    matching rules the highest ``rank`` decides; at equal ranks a block."""

    pattern: str
    action: str
    tokens: tuple[str, ...]
    rank: int
    name: str | None = None


def host_rule(action: str, host: str, path: str) -> Rule:
    """Rule for a host with its subdomains and a path prefix. Tokens of the path count only where a separator ends
    them inside the prefix, since the prefix may stop within a token of the URL."""
    whole = re.sub(r"[0-9A-Za-z]+$", "", host + path) if path else host
    pattern = r"^(?:[^/]*\.)?" + _quote(host) + ("(?![^/])" if not path else _quote(path))
    return Rule(pattern, action, tuple(t for t in re.split(_SEPARATOR, whole) if t), len(host + path), host + path)


def word_rule(action: str, word: str) -> Rule:
    """Rule for a token anywhere in host or path; ranks below every host rule."""
    return Rule(f"(?<![0-9A-Za-z]){_quote(word)}(?![0-9A-Za-z])", action, (word,), 0)


def _quote(literal: str) -> str:
    return re.sub(r"([^0-9A-Za-z/_])", r"\\\1", literal)


# The contract's rules (action, host, path).
CONTRACT = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
            ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Words that mark adult, gambling, pill and malware addresses.
BLOCKED_WORDS = ("adult", "casino", "escort", "malware", "phishing", "pills", "poker", "porn", "sex", "torrent",
                 "viagra", "warez", "xxx")
RULES = tuple(host_rule(*r) for r in CONTRACT) + tuple(word_rule("block", w) for w in BLOCKED_WORDS)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("rule_id"), F.lit(r.pattern).alias("pattern"), F.lit(r.action).alias("action"),
                     F.array(*[F.lit(t) for t in (r.tokens or ("",))]).alias("tokens"),
                     F.lit(r.rank).alias("rank"), F.lit(r.name).cast("string").alias("name"))
            for i, r in enumerate(rules)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def index_by_rarest(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, rule...): each rule under the literal token that the fewest URLs hold. ``tokens``: one row for each
    distinct token of a URL."""
    literal = rules.select("rule_id", F.explode("tokens").alias("token"))
    held = (tokens.join(literal.select("token").distinct(), "token", "left_semi")
            .groupBy("token").agg(F.count("*").alias("urls")))
    rarest = (literal.join(held, "token", "left")
              .groupBy("rule_id").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("r")))
    return rules.join(rarest, "rule_id").select("r.token", "rule_id", "pattern", "action", "rank", "name")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``url`` (distinct, not null) with host, path, rule, verdict."""
    urls = (pages.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
            .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    target = F.concat("host", "path")
    tokens = urls.select("url", "host", "path", F.explode(
        F.array_union(F.split(target, _SEPARATOR), F.array(F.lit("")))).alias("token"))
    table = rule_table(pages.sparkSession, rules)
    index = index_by_rarest(table, tokens.select("token"))
    # the index is joined by token: Spark broadcasts it only below its size threshold and splits hot tokens beyond
    hits = (tokens.join(index, "token").where(F.expr("concat(host, path) rlike pattern"))
            .groupBy("url").agg(F.max(F.struct("rank", (F.col("action") == "block").alias("blocks"), "rule_id", "name",
                                               "action")).alias("best")))
    return urls.join(hits, "url", "left").select(
        "url", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: its id, host, path, the deciding rule's name and the verdict."""
    judged = judge_urls(pages, rules, url_col, default)
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"))
    return rows.join(judged, "url", "left").select(
        id_col, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))


_FITS = "\n".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{a} {h}{p}'"
    for a, h, p in sorted(CONTRACT, key=lambda r: -len(r[1] + r[2])))
ORACLE = f"""
WITH split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE {_FITS} END AS hit FROM split
)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule,
  coalesce(split_part(hit, ' ', 1),
    CASE WHEN list_has_any(regexp_split_to_array(host || path, '{_SEPARATOR}'), {list(BLOCKED_WORDS)})
         THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""


@register("op1_url_filters", ORACLE)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` under the contract's rules, else the word rules, else allowed."""
    return filter_urls(read(spark, sf_dir, "pages"))
