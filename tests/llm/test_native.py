"""Exact copies and url judgements against plain Python."""

import hashlib
from collections import defaultdict

from conftest import az
from pyspark.sql import functions as F

from tabulon.llm.exact_dedup import drop_exact_copies, exact_groups
from tabulon.llm.url_filter import host_of, host_reputation, judge_urls, path_of


def test_exact_groups(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[az(t)].append(i)
    got = exact_groups(awkward).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        ids = groups[az(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(az(t).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_same_digest_different_text(awkward, monkeypatch):
    """Were two texts to share a digest, they would still be told apart."""
    want = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_groups(awkward).collect()}
    real = F.sha2
    monkeypatch.setattr(F, "sha2", lambda c, bits: F.substring(real(c, bits), 1, 2))
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_groups(awkward).collect()} == want


def test_drop_exact_copies(awkward, nothing):
    kept = drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    texts = [az(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {az(r["text"]) for r in awkward.collect()}
    # Of "twice" and "TWICE" the larger id stays.
    assert [r["doc_id"] for r in kept.filter("doc_id >= 500").collect()] == [501]
    assert exact_groups(nothing).count() == 0 and drop_exact_copies(nothing).count() == 0


def test_one_row_of_equal_texts_stays(spark):
    """Repeated ids, rows without id, and one id whose other text is another group's."""
    rows = [(5, "same"), (5, "same"), (5, "SAME"), (3, "same"), (None, "same"), (None, "q"), (None, "q"), (None, "Q"), (5, "other"), (7, "OTHER"), (7, "other"), (8, "alone"), (9, None), (9, ""), (2, "")]
    df = spark.createDataFrame([(*r, f"n{i}") for i, r in enumerate(rows)], "doc_id long, text string, mark string").repartition(4)
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, az(r["text"])) for r in kept.collect()) == [(0, "q"), (5, "same"), (7, "other"), (8, "alone"), (9, "")]
    assert drop_exact_copies(df.filter("doc_id = 5 and mark in ('n0', 'n1')")).count() == 1


URLS = [
    ("http://A.Example.org/es/1?x#y", "a.example.org", "/es/1"), ("https://example.org", "example.org", ""),
    ("x://h?q/p", "h", ""), ("x://h#f/p", "h", ""), ("://", "", ""), ("no scheme/p", "", ""), (None, "", ""),
    ("http://u://v/w", "u:", "//v/w"), ("http://ÄB.com/fr/", "Äb.com", "/fr/"),
]


def test_host_and_path(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URLS], "u string")
    got = df.select(host_of(F.col("u")), path_of(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(h, p) for _, h, p in URLS]


def test_rules_and_reputation(spark):
    urls = ["http://example.org/es/a", "http://b.example.org/en/12", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/", "http://badorg/", None]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)] + [(None, None, None)], "page_id long, url string, host string")
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")],
        "host string, path string, verdict string",
    )
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, rules, none).collect()}
    assert got[0] == ("example.org/es/", "block") and got[1] == ("example.org/en/1", "block") and got[2] == ("org/", "allow")
    assert got[3] == ("com/fr/", "allow") and got[4] == ("com/de/", "block") and got[5] == (None, "allow") and got[6] == (None, "allow")
    assert len(got) == 9 and got[7] == (None, "allow")
    assert judge_urls(pages.limit(0), rules, none).count() == 0


def test_reputation_shrinks(spark):
    hosts = spark.createDataFrame([("a.good.com",), ("b.good.com",), ("new.bad.net",), ("x.bad.net",), ("one.org",)], "host string")
    outcomes = [("a.good.com", 0)] * 40 + [("b.good.com", 1)] + [("x.bad.net", 1)] * 60 + [("one.org", 1)]
    got = {r["host"]: r for r in host_reputation(hosts, spark.createDataFrame([*outcomes, (None, 1), ("one.org", None)], "host string, bad int")).collect()}
    # One bad page of a good domain says less than sixty of another, and a new host takes after its domain.
    assert got["a.good.com"]["mean"] < got["b.good.com"]["mean"] < got["x.bad.net"]["mean"]
    assert got["new.bad.net"]["mean"] > 0.8 and got["x.bad.net"]["low"] > 0.5 > got["b.good.com"]["low"]
    assert all(0 < r["mean"] < 1 and r["low"] < r["mean"] < r["high"] for r in got.values())
