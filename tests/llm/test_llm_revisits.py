"""Revisit records."""

import random

import pytest
from pyspark.sql import functions as F

from plantpulse.llm.revisits import canonical_url, resolve_revisits

FIELDS = "record_id bigint, uri string, captured_at bigint, kind string, headers map<string,string>, payload_digest string, state string"


def full(i, at, uri="http://a.com/x", digest=None, **headers):
    return (i, uri, at, "response", {k.replace("_", "-"): v for k, v in headers.items()}, digest or f"d{i}", "")


def again(i, at, uri="http://a.com/x", **headers):
    return (i, uri, at, "revisit", {k.replace("_", "-"): v for k, v in headers.items()}, None, "")


def resolved(spark, rows, **options):
    return {r["record_id"]: r for r in resolve_revisits(spark.createDataFrame(rows, FIELDS), **options).collect()}


@pytest.mark.parametrize(
    "a, b",
    [
        ("HTTP://WWW.A.com:80/x/#f", "https://a.com/x"),
        ("http://a.com/?b=2&a=1&utm_source=q", "http://a.com?a=1&b=2"),
        ("http://a.com?utm_x=1", "http://a.com/"),
    ],
)
def test_same_page(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(canonical_url(F.col("a")), canonical_url(F.col("b")))
    assert row.first()[0] == row.first()[1] is not None


def test_latest_earlier_response(spark):
    rows = [full(1, 10, etag='"a"'), full(2, 20, etag='"b"'), again(3, 20, etag='"a"'), again(4, 21, etag='W/"b"'), again(5, 22, etag='"a"')]
    got = resolved(spark, rows)
    assert (got[3]["state"], got[3]["refers_to"]) == ("resolved", 1)
    assert (got[4]["state"], got[4]["refers_to"], got[4]["payload_digest"]) == ("resolved", 2, "d2")
    assert (got[5]["state"], got[5]["refers_to"], got[5]["headers"]) == ("validator_mismatch", None, None)


def test_validators(spark):
    rows = [
        full(1, 1, uri="http://d.com/", last_modified="m"), again(2, 2, uri="http://d.com/", last_modified="m"),
        again(3, 2, uri="http://d.com/", last_modified="n"), again(4, 2, uri="http://d.com/"),
        full(5, 1, uri="http://e.com/"), again(6, 2, uri="http://e.com/"), again(7, 2, uri="http://f.com/"),
    ]
    got = {i: r["state"] for i, r in resolved(spark, rows).items()}
    assert got == {2: "resolved", 3: "validator_mismatch", 4: "validator_mismatch", 6: "resolved", 7: "orphan"}


def test_headers_merge(spark):
    rows = [full(1, 1, ETag='"a"', Content_Length="9", Age="1", X="1"), again(2, 2, etag='"a"', content_length="0", age="2", Y="3")]
    assert resolved(spark, rows)[2]["headers"] == {"etag": '"a"', "content-length": "9", "age": "2", "x": "1", "y": "3"}


def test_nulls_repeats_and_empty_table(spark):
    rows = [
        (1, None, 1, "response", None, "d", ""), (2, None, 2, "revisit", None, None, ""), (3, "http://a.com/", None, "revisit", None, None, ""),
        (None, "http://a.com/", 1, "revisit", None, None, ""), (4, "http://a.com/", 5, "other", None, None, ""),
        (5, "http://a.com/", 5, "response", None, "d", ""), (5, "http://a.com/", 5, "response", None, "d", ""),
        (6, "http://a.com/", 6, "revisit", None, None, ""), (6, "http://a.com/", 6, "revisit", None, None, ""),
    ]
    got = resolved(spark, rows)
    assert {i: r["state"] for i, r in got.items()} == {2: "orphan", 3: "orphan", 6: "resolved"}
    assert resolve_revisits(spark.createDataFrame([], FIELDS)).count() == 0


@pytest.mark.parametrize("slot", [1, 7, 10_000])
def test_against_brute_force(spark, slot):
    rng = random.Random(slot)
    rows = [
        (full if rng.random() < 0.5 else again)(i, rng.randrange(60), uri=f"http://{rng.choice('aab')}.com/", etag=f'"{rng.choice("xy")}"')
        for i in range(150)
    ]
    got = resolved(spark, rows, slot_seconds=slot)
    for i, uri, at, kind, headers, _, _ in rows:
        if kind == "revisit":
            earlier = [(r[2], r[0], r[4]) for r in rows if r[3] == "response" and r[1] == uri and r[2] < at]
            best = max(earlier, key=lambda r: r[:2], default=None)
            want = "orphan" if best is None else "resolved" if best[2]["etag"] == headers["etag"] else "validator_mismatch"
            assert got[i]["state"] == want
            assert got[i]["refers_to"] == (best[1] if want == "resolved" else None)
