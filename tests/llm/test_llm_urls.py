"""Host reputation and rules."""

import pytest

from plantpulse.llm.url_reputation import Policy, judge, reputations

PAGES = "page_id bigint, url string, verdict string"
OUTCOMES = "page_id bigint, bad boolean"


def verdicts(spark, urls, outcomes=(), policy=Policy()):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES)
    rows = judge(pages, spark.createDataFrame(list(outcomes), OUTCOMES), policy).collect()
    return {r["page_id"]: r for r in rows}


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.example.net/en", "a.example.net", "/en", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://net/", "net", "/", "net/", "block"),
        ("http://magnet/", "magnet", "/", None, "allow"),
        ("http://b.example.com/de/x", "b.example.com", "/de/x", "example.com/de/", "block"),
        ("http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
        ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.org?u=http://y.net/", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://ÀB\n/p\nq#f", "Àb\n", "/p\nq", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    row = verdicts(spark, [url])[0]
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_bad_host_is_blocked_by_its_bound(spark):
    urls = [f"http://bad.com/{i}" for i in range(40)] + [f"http://good.com/{i}" for i in range(40)] + ["http://new.com/"]
    labels = [(i, i < 40) for i in range(80)] + [(80, True)]
    got = verdicts(spark, urls, labels)
    assert got[0]["verdict"] == "block" and got[40]["verdict"] == "allow"
    assert got[40]["bad_rate"] < got[80]["bad_rate"] < got[0]["bad_rate"]
    assert all(r["bad_bound"] <= r["bad_rate"] for r in got.values())


def test_host_without_labels_takes_its_domain(spark):
    rows = [("a.x.com", True)] * 20 + [("a.y.com", False)] * 20 + [("b.x.com", None), ("b.y.com", None)]
    got = {r["host"]: r for r in reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["b.x.com"]["rate"] > got["b.y.com"]["rate"]
    assert got["b.x.com"]["n"] == 0


def test_suffixes_of_two_labels(spark):
    rows = [("a.x.co.uk", True), ("b.x.co.uk", None), ("c.y.co.uk", False)] * 10
    got = {r["host"]: r["rate"] for r in reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["b.x.co.uk"] > got["c.y.co.uk"]


def test_repeats_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a.com/", "x"), (1, "http://a.com/", "x"), (1, "http://a.com/", "x")], PAGES)
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (2, None)], OUTCOMES)
    rows = judge(pages, labels).collect()
    assert len(rows) == 3 and {r["n_labels"] for r in rows} == {2}
    assert judge(pages.limit(0), labels).count() == 0
    assert {r["bad_rate"] for r in judge(pages, labels.limit(0)).collect()} == {0.5}


def test_plan_does_not_nest_levels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "x")], PAGES)
    plan = judge(pages, spark.createDataFrame([(1, True)], OUTCOMES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 60
