"""Addresses of any length, windows that all share, and names that differ in case only."""

import pytest

from verdance.llm import url_filter

LEARNT = [("http://a.org/fr/eins", "allow"), ("http://b.org/fr/zwei\U0001f600", "allow"), ("http://c.net/drei", "block"), ("http://d.net/vier/é", "block")]


def scores(spark, urls, order=4):
    df = spark.createDataFrame([(u, l, 1) for u, l in urls], "url string, label string, n long")
    return {r["url"]: r["score"] for r in url_filter.language_model_scores(df, order).collect()}


def test_a_very_long_address(spark):
    """What repeats 40,000 times scores as its one period does, but for the ends: 200,000 characters."""
    long = "abcé\U0001f600" * 40_000
    got = scores(spark, [*LEARNT, (long, None), (long[:5000], None)])
    assert got[long] == pytest.approx(got[long[:5000]], abs=1e-2) and len(got) == 6


def test_frequent_windows_score_like_rare_ones(spark, monkeypatch):
    urls = [*LEARNT, ("http://e.com/", None), ("", None), ("x", None)]
    want = scores(spark, urls)
    for share in (1, 10, 10**6):
        monkeypatch.setattr(url_filter, "_FREQUENT", share)
        assert scores(spark, urls) == {u: pytest.approx(s) for u, s in want.items()}


def test_pages_with_a_long_address_and_clashing_names(spark):
    long = "http://e.com/" + "q" * 200_000
    rows = [(k, u, "mine") for k, (u, _) in enumerate(LEARNT)] + [(9, long, "mine")]
    out = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, Host string"))
    assert [c.lower() for c in out.columns].count("host") == 1
    got = {r["page_id"]: r for r in out.select("page_id", "host", "path", "verdict").collect()}
    assert got[9]["host"] == "e.com" and len(got[9]["path"]) == 200_001 and len(got) == 5
