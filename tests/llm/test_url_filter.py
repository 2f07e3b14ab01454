from __future__ import annotations

import re

import pytest

from rowferry.llm import url_filter

URLS = [
    "http://a.net/x", "https://WWW.Example.NET/en/1?q=/de/", "http://example.net/enx", "http://example.net/en/", "http://a.example.com/de/5",
    "http://notexample.com/de/", "http://b.org/fr/#x", "http://b.org", "http://net", "http://net/", "http://x.net?a/b", "no scheme", "", None,
    "http://", "a://b://c/d", "http://ÄÖ.example.com/DE/", "http://h/p\nq?r", "ftp://u:p@host.net:80/p;x#y", "http://" + "a" * 20000 + ".com/x",
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for says, rule in url_filter.RULES:
        domain, rest = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, says))
    _, rule, says = max(fits, default=(0, None, None))
    return host, path, rule, says


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.fit(url_filter.default_labels(spark))


def test_parts_and_rules(spark, model):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, verdict string")
    rows = url_filter.judge_urls(df, model).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule, says = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (says or ("block" if r["score"] >= 0.5 else "allow"))


def test_pages(spark, folder, model):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = url_filter.judge_urls(pages, model).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == brute(urls[r["page_id"]])[:3]


def test_unseen_names_are_told_apart(spark, model):
    bad = ["mega-casino", "bets-online", "buy-meds", "spam-bots", "lottery-money"]
    good = ["rivers", "bakery", "cooking", "orchard", "harbour", "thornbury", "lantern"]
    rows = [(i, f"https://www.{name}.example.com/en/{i}") for i, name in enumerate(bad + good)]
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), model).collect()
    scores = [r["score"] for r in sorted(found)]
    assert min(scores[: len(bad)]) > max(scores[len(bad) :])
    assert sum(s >= 0.5 for s in scores[: len(bad)]) >= 4 and not any(s >= 0.5 for s in scores[len(bad) :])


def test_the_plan_is_native(spark, folder, model):
    df = url_filter.judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), model)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "html" not in plan


def test_empty_and_unusable_labels(spark, model):
    nothing = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judge_urls(nothing, model).count() == 0
    with pytest.raises(ValueError):
        url_filter.fit(spark.createDataFrame([("http://a/", 1.0)], "url string, blocked double"))
