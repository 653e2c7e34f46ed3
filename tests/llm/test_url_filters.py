from collections import Counter

import pytest

from causeway.llm import url_filters as U
from tests_llm_help import duck_rows, rows

CASES = [
    (1, "https://Shop.COM/a?b#c"), (2, "http://www.example.com/en/1"), (3, "http://m.example.com/en/1#x"),
    (4, "http://example.com/EN/1"), (5, "ftp://a.net/es/"), (6, "ftp://a.net/es"), (7, "ftp://a.net"), (8, None),
    (9, "no scheme"), (10, ""), (11, "http://notexample.com/en/x"), (12, "x://y.org/casino/q"), (13, "x://y.org/casinos"),
    (14, "http://é.NET/fr/à"), (None, "http://a.net/fr/"), (15, "http://www.example.com/en/1"), (1, "https://Shop.COM/a?b#c"),
    (16, "x://y.org/" + "a/" * 50_000 + "porn"), (17, "http://com/"), (18, "http://xcom/"), (19, "://net/fr/?x://com/"),
]


def expected(page_id, url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), a, h + p) for a, h, p in U.CONTRACT
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, action, rule = max(fits)
        return page_id, host, path, rule, action
    words = set("".join(c if c.isascii() and c.isalnum() else " " for c in host + path).split())
    return page_id, host, path, None, "block" if words & set(U.BLOCKED_WORDS) else "allow"


def test_cases_match_a_plain_reading_of_the_rules(spark):
    df = spark.createDataFrame(CASES, "page_id long, url string").selectExpr("*", "1 AS host", "'x' AS token")
    got = Counter(map(tuple, U.filter_urls(df).collect()))
    assert got == Counter(expected(*c) for c in CASES)


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([("www",)] * 9 + [("example",)] * 3 + [("com",)] * 20 + [("en",)] * 4, "token string")
    index = U.index_by_rarest(U.rule_table(spark, U.RULES), tokens)
    by_name = {r["name"]: r["token"] for r in index.collect() if r["name"]}
    assert by_name["www.example.com/en/"] == "example" and by_name["com/"] == "com"


def test_rule_without_tokens_and_unfinished_prefix(spark):
    rules = (U.Rule(r"\d{4}$", "block", (), 5, "digits"), U.host_rule("block", "a.org", "/pre"))
    df = spark.createDataFrame([(1, "x://b/1234"), (2, "x://a.org/prefix"), (3, "x://a.org/p")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(df, rules).collect()} == {
        1: ("digits", "block"), 2: ("a.org/pre", "block"), 3: (None, "allow")}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_duckdb(spark, sf):
    assert rows(spark, "op1_url_filters", sf) == duck_rows("op1_url_filters", sf)
