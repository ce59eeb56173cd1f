import pytest

from rosterlake.llm import urls


def judged(spark, rows, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    return {r.page_id: r for r in urls.judge(pages, **kw).collect()}


def test_places_rules_and_vocabulary(spark):
    rows = [
        (1, None, "?"), (2, "", "?"), (3, "no scheme/casino/bet", "?"), (4, "HTTP://A.Example.ORG/es/x?y#z", "?"), (5, "http://example.org/en/12", "?"),
        (6, "http://x.org", "?"), (7, "https://notexample.org/en/1", "?"), (8, "http://s.com/de/1", "?"), (9, "http://s.com/fr/porn", "?"),
        (10, "http://s.net/PORN-1", "?"), (11, "http://s.net/pornography", "?"), (12, "http://s.net/bet/bet", "?"), (13, "http://s.net/bet/Casino", "?"),
        (14, "http://a://b/c", "?"), (15, "http://host?q=/es/", "?"),
    ]
    got = judged(spark, rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert got[2].verdict == "allow" and got[3].host == "" and got[3].verdict == "block" and got[3].soft_hits == ["bet", "casino"]
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[5].rule == "example.org/en/1" and got[6].rule is None and got[6].path == "" and got[7].rule == "org/"
    assert got[8].verdict == "block" and got[9].verdict == "allow" and got[9].strict_hits == ["porn"]
    assert got[10].verdict == "block" and got[11].verdict == "allow" and got[12].verdict == "allow" and got[13].verdict == "block"
    assert (got[14].host, got[14].path) == ("a:", "//b/c") and (got[15].host, got[15].path) == ("host", "")


def test_very_long_repeated_and_empty(spark):
    long = "http://s.net/" + "a" * 200_000 + "/xxx"
    rows = [(1, long, None), (1, long, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    assert [r.verdict for r in urls.judge(pages).collect()] == ["block", "block"]
    assert urls.judge(pages.limit(0)).collect() == []


@pytest.mark.parametrize("term", ["xxx", "bet"])
def test_touching_characters(term):
    assert sum(map(len, urls.hits(f"a.{term}.b", urls.STRICT, urls.SOFT))) == 1
    assert not any(urls.hits(f"a{term}.b{term}9", urls.STRICT, urls.SOFT))


def test_vocabulary_is_a_set_of_plain_terms():
    terms = urls.STRICT + urls.SOFT
    assert len(set(terms)) == len(terms) and all(t.isascii() and t.isalpha() and t == t.lower() for t in terms)


@pytest.mark.parametrize("url, verdict", [
    ("https://m.casino-win.example.net/en/1", "block"), ("http://free-bets.example.net/de/2", "block"), ("http://www.spam-farm.example.net/x", "block"),
    ("https://farm.example.net/win", "block"), ("https://farm.example.net/en/1?ref=x", "allow"), ("https://free.example.net/free/free", "allow"), ("https://winfree.example.net", "allow"),
])
def test_distinct_soft_hits(spark, url, verdict):
    assert judged(spark, [(1, url, None)])[1].verdict == verdict


def test_columns_of_other_names_stay(spark):
    pages = spark.createDataFrame([(1, "http://s.net/a", 2, "h", 3)], "page_id long, url string, _by_rule int, host string, extra int")
    found = urls.judge(pages)
    assert set(found.columns) >= {"page_id", "url", "host", "path", "rule", "verdict", "extra"} and found.first().host == "s.net"
