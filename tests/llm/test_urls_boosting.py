"""Boosting against a plain row-by-row statement, unseen suffixes, and accuracy on labels kept aside."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, urls
from millrace.session import stage

SF = "/root/testdata/sf0.1"


def plain_boost(rows, bounds, start, trees, depth, rate, smooth, least_gain):
    """rows: feature dicts with ``blocked``. Returns the margin of each row."""
    margin, label = [start] * len(rows), [r["blocked"] for r in rows]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [y - q for y, q in zip(label, p)], [q * (1 - q) for q in p]

        def gain(x, y, among):
            a, b = sum(g[i] for i in among), sum(h[i] for i in among)
            return x**2 / (y + smooth) + (a - x) ** 2 / (b - y + smooth) - a**2 / (b + smooth)

        groups = [list(range(len(rows)))]
        for level in range(depth):
            split = []
            for among in groups:
                best, cut = least_gain, None
                for f in urls.FEATURES:
                    known = [i for i in among if rows[i][f] is not None]
                    nulls = [i for i in among if rows[i][f] is None]
                    steps = sorted({b for b in (next((c for c in bounds[f] if rows[i][f] <= c), math.inf) for i in known)})
                    for b in steps:
                        low = [i for i in known if rows[i][f] <= b]
                        ways = ([low + nulls] if b != steps[-1] else []) + [low] if nulls else [low] if b != steps[-1] else []
                        for way in ways:
                            found = round(gain(sum(g[i] for i in way), sum(h[i] for i in way), among), 6)
                            if found > best:
                                best, cut = found, set(way)
                split += [among] if cut is None else [[i for i in among if i in cut], [i for i in among if i not in cut]]
            if len(split) == len(groups):
                break
            groups = split
        if len(groups) == 1:
            break
        for among in groups:
            value = round(rate * sum(g[i] for i in among) / (sum(h[i] for i in among) + smooth), 6)
            for i in among:
                margin[i] += value
    return margin


def features(spark, n):
    """Rows whose label follows two features and chance, some without suffix statistics."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000
    made = spark.range(n).select("id", *[F.round(draw(f) * 8, 1).alias(f) for f in urls.FEATURES])
    bad = (F.col("depth") + F.col("suffix_seen") + 6 * draw("noise") > 11).cast("int")
    made = made.withColumn("blocked", bad)
    return made.withColumns({f: F.when(draw("null") > 0.2, F.col(f)) for f in ("suffix_seen", "suffix_blocked")})


@pytest.mark.parametrize("bins,depth", [(4, 2), (8, 3)])
def test_trees_are_those_of_plain_boosting(spark, bins, depth):
    rows = stage(features(spark, 400), "rows")
    options = dict(trees=3, depth=depth, rate=0.4, smooth=1.0, least_gain=1e-3)
    trees = urls.boost(rows, -0.3, bins=bins, **options)
    got = {r["id"]: r["m"] for r in rows.select("id", urls.Trees(-0.3, trees=trees).margin().alias("m")).collect()}
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = rows.agg(*[F.percentile_approx(f, at).alias(f) for f in urls.FEATURES]).first()
    held = [r.asDict() for r in rows.collect()]
    want = plain_boost(held, {f: sorted(set(cuts[f])) for f in urls.FEATURES}, -0.3, **options)
    assert len(trees) == 3 and [got[r["id"]] for r in held] == pytest.approx(want, abs=1e-4)


def test_labels_kept_aside(spark):
    """Each fifth of the labelled URLs, by hash, judged by trees of the other four: better than the majority."""
    parts = urls.with_parts(spark.read.parquet(f"{SF}/pages.parquet").select("url"), "url")
    verdict = urls.rule_columns(queries.RULES, F.col("host"), F.col("path"))[1]
    known = stage(parts.select("url", (verdict == urls.BLOCK).cast("int").alias("blocked"), F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(5)).alias("fold"))
                  .filter("blocked IS NOT NULL"), "known")
    right = n = bad = 0
    for fold in range(5):
        model = urls.fit(known.filter(F.col("fold") != fold))
        made = urls.judge(known.filter(F.col("fold") == fold), [], model)
        agrees = ((F.col("verdict") == urls.BLOCK).cast("int") == F.col("blocked")).cast("int")
        row = made.agg(F.sum(agrees).alias("right"), F.count("*").alias("n"), F.sum("blocked").alias("bad")).first()
        right, n, bad = right + row["right"], n + row["n"], bad + row["bad"]
    print("kept aside:", right, "right of", n, "majority", n - bad)
    assert right > n - bad


def test_unseen_suffix_is_no_number(spark):
    """A suffix without labels goes where rows without statistics went, not beside the rare ones."""
    rare = F.col("id") % 5 == 0
    labelled = spark.range(500).select(
        F.concat(F.lit("http://h"), F.col("id").cast("string"), F.when(rare, ".bad").otherwise(".good"), F.lit("/x")).alias("url"), rare.cast("int").alias("blocked"))
    model = urls.fit(labelled)
    pages = spark.createDataFrame([(f"http://h{i}.{s}/x",) for i in range(9) for s in ("bad", "good", "new")], "url string")
    got = {r.url.split("/")[2].split(".")[1]: r.verdict for r in urls.judge(pages, [], model).collect()}
    assert got == {"bad": urls.BLOCK, "good": urls.ALLOW, "new": urls.ALLOW}
