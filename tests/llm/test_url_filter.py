import pytest
from pyspark.sql import functions as F

from seamark.llm import url_filter as U

PAGES = "page_id bigint, url string, html string, host string, rule string"


@pytest.mark.parametrize(("url", "host", "path"), [
    ("HTTP://WWW.Ex.Com/A/b?x#y", "www.ex.com", "/A/b"), ("x://É.com?q/", "É.com", ""), ("no scheme/x", "", ""), (None, "", ""), ("a://b#c/d", "b", ""), ("a://", "", ""), ("a://b://c/d", "b:", "//c/d"),
])
def test_parse(spark, url, host, path):
    h, p = U.host_and_path(F.col("url"))
    assert tuple(spark.createDataFrame([(url,)], "url string").select(h, p).first()) == (host, path)


@pytest.mark.parametrize(("url", "rule"), [
    ("h://example.com/en/1", "example.com/en/"), ("h://www.example.com/en/1", "www.example.com/en/"), ("h://a.www.example.com/en/", "www.example.com/en/"), ("h://m.example.com/en/", "example.com/en/"),
    ("h://notexample.com/en/", "com/"), ("h://example.com", None), ("h://x.net/es/1", "net/es/"), ("h://x.net/de/1", None), ("h://net/fr/", "net/fr/"),
])
def test_rules(spark, url, rule):
    pages = spark.createDataFrame([(1, url)], "page_id bigint, url string")
    row = U.filter_urls(pages, spark.createDataFrame([], "host string, n bigint, bad bigint")).first()
    assert row.rule == rule and row.verdict == (dict(U.RULES)[rule] if rule else row.verdict)


def test_reputation_shrinks(spark):
    hosts = [("bad.org", 200, 190), *((f"h{i}.org", 50, 2) for i in range(20)), ("one.org", 1, 1), ("new.bad.org", 0, 0), ("new.org", 0, 0)]
    got = {r.host: r for r in U.host_reputation(spark.createDataFrame(hosts, "host string, n bigint, bad bigint")).collect()}
    assert got["bad.org"].bad_bound > 0.5 > got["one.org"].bad_bound  # one outcome proves little
    assert got["new.bad.org"].bad_rate > got["new.org"].bad_rate  # a host without outcomes takes after its domain
    assert all(0 <= r.bad_rate <= 1 for r in got.values())


def test_reputation_blocks(spark):
    pages = spark.createDataFrame([(1, "h://a.bad.org/x"), (2, "h://new.bad.org/x"), (3, "h://good.org/x"), (4, "h://www.bad.com/x")], "page_id bigint, url string")
    outcomes = [("a.bad.org", 300, 280), ("b.bad.org", 300, 290), *((f"h{i}.org", 50, 1) for i in range(30)), ("good.org", 300, 3), ("www.bad.com", 300, 300)]
    got = {r.page_id: r for r in U.filter_urls(pages, spark.createDataFrame(outcomes, "host string, n bigint, bad bigint")).collect()}
    assert [got[k].verdict for k in (1, 2, 3, 4)] == ["block", "allow", "allow", "allow"]  # nothing is known of new.bad.org itself; a rule allows com/
    assert got[2].bad_rate > 3 * got[3].bad_rate and all(0 <= r.bad_bound <= r.bad_rate <= 1 for r in got.values())


def test_suffix_rules(spark):
    rules = (*U.SUFFIXES, "*.ck", "!www.ck", "k12.ca.us")
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "x.com.cn": ("com.cn", "x.com.cn"), "me.github.io": ("github.io", "me.github.io"), "a.me.github.io": ("github.io", "me.github.io"), "github.io": ("github.io", "github.io"),
        "a.b.org.ck": ("org.ck", "b.org.ck"), "x.www.ck": ("ck", "www.ck"), "a.x.k12.ca.us": ("k12.ca.us", "x.k12.ca.us"), "a.example.org": ("org", "example.org"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    got = U.with_domains(spark.createDataFrame([(h,) for h in want], "host string"), rules).collect()
    assert {r.host: (r.suffix, r.domain) for r in got} == want


def test_odd_rows(spark):
    rows = [(1, None), (None, "h://a.org/x"), (2, ""), (2, ""), (3, "h://a.org/x"), (4, "h://a.co.uk/en/5")]
    pages = spark.createDataFrame([(*r, None, "clash", "clash") for r in rows], PAGES)
    labels = spark.createDataFrame([(5, None, 1, "x"), (None, 1, 1, "x"), (5, 1, None, "x")], "doc_id bigint, quality int, toxic int, host string")
    got = U.filter_urls(pages, U.outcomes_of(pages, labels)).collect()
    assert len(got) == 6 and all(r.verdict in ("allow", "block") for r in got)
    assert U.filter_urls(pages.limit(0), U.outcomes_of(pages.limit(0), labels)).count() == 0
    assert U.filter_urls(pages, U.outcomes_of(pages, labels.limit(0))).count() == 6
