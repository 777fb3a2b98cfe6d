"""Rules against a plain statement; trees on URLs that a feature separates."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, urls

SF = "/root/testdata/sf0.001"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def longest(host, path):
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme.org/", "http://", "http://A.Example.ORG/es/x", "https://example.org/en/12?q#f", "https://example.org/en/2", "http://org/", "http://org",
    "http://xorg/", "http://a.com/fr/", "http://a.com/FR/", "http://com/de/1", "http://b.net/fr/#://x.org/", "ftp://u@h.org:80/es/", "http://example.org?x=/es/",
    "http://é.org/a b\nc", "http://" + "a." * 3000 + "com/fr/" + "x" * 20_000, "http://ÀB.org/",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "old", 1.0) for i, u in enumerate(URLS * 2)], "page_id long, url string, Rule string, share double")
    made = urls.judge(pages, queries.RULES, urls.Trees(-1.0))
    assert made.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    rows = made.collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path) == parts(r.url)
        rule = longest(r.host, r.path)
        assert (r.rule, r.verdict) == ((rule.text, rule.verdict) if rule else (None, urls.ALLOW))


def test_query(spark):
    want = {r.page_id: parts(r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.Q["op4_urls"](spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        rule = longest(*want[r.page_id])
        assert (r.host, r.path) == want[r.page_id] and r.rule == (rule.text if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in (urls.ALLOW, urls.BLOCK)


def made_up(spark, n):
    bad = F.col("id") % 3 == 0
    url = F.concat(F.lit("http://"), F.when(bad, "win-big-777").otherwise("news"), F.col("id").cast("string"),
                   F.when(F.col("id") % 2 == 0, ".net").otherwise(".info"), F.lit("/a/b"), F.when(bad, "?x=1&y=2&z=3").otherwise(""))
    return spark.range(n).select("id", url.alias("url"), bad.cast("int").alias("blocked"))


def test_trees_learn(spark):
    model = urls.fit(made_up(spark, 600), trees=4, depth=2, max_rows=400)
    again = urls.fit(made_up(spark, 600).repartition(5), trees=4, depth=2, max_rows=400)
    assert model.trees and model.trees == again.trees
    rows = urls.judge(made_up(spark, 900).filter("id >= 600"), [], model).collect()
    assert all((r.verdict == urls.BLOCK) == (r.blocked == 1) and 0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("label,verdict", [(0, urls.ALLOW), (1, urls.BLOCK)])
def test_one_label(spark, label, verdict):
    labelled = spark.createDataFrame([("http://a.b/c", label), (None, 1 - label), ("http://x.y", None), ("http://x.y", label)], "url string, blocked int")
    rows = urls.judge(labelled, [], urls.fit(labelled)).collect()
    assert {r.verdict for r in rows} == {verdict}


def test_empty(spark):
    nothing = made_up(spark, 0)
    model = urls.fit(nothing)
    assert urls.judge(nothing, queries.RULES, model).collect() == []
    assert urls.judge(made_up(spark, 1), [], model).first().verdict == urls.ALLOW
