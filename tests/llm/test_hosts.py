from collections import Counter

import pytest
from pyspark.sql import functions as F

from handprint.llm.queries import QUERIES
from handprint.llm.hosts import RULES, judge_urls, reputations, strength, suffix_of

URLS = ["http://A.Example.NET/en/x?q#f", "https://example.com/de/", "http://example.com/DE/",
        "http://org/fr/", "http://x.org/fr", "http://notexample.com/de/", "http://net", "net/", "",
        None, "http://net?x/", "http://b.net/#/", "ftp://a://b/c", "http://example.net/en",
        "http://example.net/en/", "http://shop.co.uk/a\nb?c", "://", "http:///x"]


def brute(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, None
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    tail = rest[at:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(r), r, v) for v, r in RULES
           if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
           and path.startswith(r[r.index("/"):])]
    return (host, path, *max(fit, default=(0, None, None))[1:])


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0]), (None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string").withColumns(
        {c: F.lit("clash") for c in ("id", "host", "n", "bad", "of", "rate", "verdict")})


def test_parts_and_rules(spark, pages):
    outcomes = spark.createDataFrame([(1, True), (1, None), (None, True), (99, False)],
                                     "doc_id bigint, bad boolean")
    got = judge_urls(pages, outcomes).collect()
    rows = [(r.page_id, r.url) for r in pages.collect()]
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter(
        (i, *brute(u)[:3]) for i, u in rows)
    for r in got:
        want = [brute(u)[3] for i, u in rows if i == r.page_id and brute(u)[:2] == (r.host, r.path)]
        if want[0]:
            assert r.verdict == want[0]


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.example.org", True)] * 60 + [("good.example.org", False)] * 60
    rows += [("one.example.org", True), ("new.example.org", None)]
    rows += [(f"h{i}.other.com", i % 10 == 0) for i in range(200)]
    got = {r.host: r for r in reputations(
        spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.example.org"].bound > 0.5 > got["good.example.org"].rate
    assert got["one.example.org"].rate < got["bad.example.org"].rate
    assert got["one.example.org"].bound < 0.5 and got["new.example.org"].bound < 0.5
    assert got["bad.example.org"].domain == "example.org"
    assert all(0 <= r.bound <= r.rate <= 1 for r in got.values())


def test_strength_follows_the_spread(spark):
    def of(rates, n=200):
        return strength(spark.createDataFrame(
            [(n, round(n * r)) for r in rates], "n bigint, bad bigint"))
    assert of([0.1, 0.1, 0.1]) == 1000.0
    assert of([0.0, 1.0, 0.0, 1.0]) == 1.0
    assert 1.0 < of([0.05, 0.3, 0.1, 0.2]) < 100.0
    assert of([0.5]) == 1000.0


def test_hosts_above_the_overall_rate_are_blocked(spark):
    """The limit follows the labels: a host stands out against the others, not against a number."""
    for bad, good in ((0.6, 0.2), (0.12, 0.02)):
        urls = [(i, f"http://{'bad' if i < 100 else f'h{i % 9}'}.com/{i}") for i in range(1000)]
        urls += [(None, "http://bad.com/x"), (5000, "http://bad.com/y"), (5001, "http://new.org/")]
        outcomes = [(i, (i % 100) < 100 * (bad if i < 100 else good)) for i in range(1000)]
        got = judge_urls(spark.createDataFrame(urls, "page_id bigint, url string"),
                         spark.createDataFrame(outcomes, "doc_id bigint, bad boolean")).collect()
        assert {r.verdict for r in got if r.host == "bad.com"} == {"block"}
        assert {r.verdict for r in got if r.host != "bad.com"} == {"allow"}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_reputation_decides_on_the_given_pages(spark, sf):
    verdicts = Counter((r.rule is None, r.verdict) for r in
                       QUERIES["op8_hosts"](spark, f"/root/testdata/{sf}").collect())
    assert verdicts[True, "block"] > 0 and verdicts[True, "allow"] > 0


def test_very_long_url(spark):
    path = "/de/" + "x" * 300_000
    pages = spark.createDataFrame([(1, "http://example.com" + path), (2, "http://" + "a." * 9000 + "net/")],
                                  "page_id bigint, url string")
    none = spark.createDataFrame([], "doc_id bigint, bad boolean")
    got = {r.page_id: r for r in judge_urls(pages, none).collect()}
    assert (got[1].path, got[1].rule, got[1].verdict) == (path, "example.com/de/", "block")
    assert (got[2].rule, got[2].verdict) == ("net/", "block")


def test_suffixes(spark):
    frame = spark.createDataFrame([("a.b.co.uk",), ("a.com",), ("co.uk",), ("x",), ("",)], "host string")
    assert [r[0] for r in frame.select(suffix_of(F.col("host"))).collect()] == [
        "co.uk", "com", "co.uk", "x", ""]


def test_empty(spark, pages):
    none = spark.createDataFrame([], "doc_id bigint, bad boolean")
    assert judge_urls(pages.where("false"), none).count() == 0
    got = judge_urls(pages, none).where("rule is null").collect()
    assert {r.verdict for r in got} == {"allow"}
