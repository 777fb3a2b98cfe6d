"""URL filter: rules first, then gradient-boosted trees over lexical features, in SQL functions only.

A rule is a host and a path and fits the host with all its subdomains if the URL's path starts with its
own; the longest fitting rule decides. Other URLs are judged by trees trained from labelled URLs. Their
features are lengths, path depth, digit ratios, entropy of the characters, parameter counts, and of
the host's last label how many labelled URLs it has and how many of these are blocked (smoothed).

A host label that no labelled URL has says nothing: its two statistics are null, and each split has a side
for nulls, learned with it. So that there are nulls to learn from, the statistics of one labelled URL in
``hide`` are hidden in training, by hash.

Training uses a sample of about ``max_rows`` labelled URLs, chosen by hash. Features are cut into at most
``bins`` bins at quantiles, and rows that agree in all bins and the label are counted once. Each level
of a tree is one aggregation of gradients by leaf, feature and bin; only these sums reach the driver,
which picks the splits. The finished trees are a CASE expression.

A null URL, or one without ``://``, has an empty host and path; no rule fits, and the trees judge its
features like any other's, however long it is. Without labelled URLs, or with one label only, the smoothed
share of blocked URLs decides. Repeated rows and null ids are judged row by row; empty tables give no rows.
Columns named like a result are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import lower_ascii, without
from millrace.session import stage

ALLOW, BLOCK = "allow", "block"
RESULTS = ("host", "path", "rule", "verdict", "score")
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens", "parameters",
    "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "suffix_seen", "suffix_blocked",
)
BROADCAST_SUFFIXES = 10_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds host, path and the rest of the URL behind the path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    found = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    return found.withColumns({
        "host": lower_ascii(F.regexp_extract("_rest", r"^([^/?#]*)", 1)),
        "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1),
    })


def rule_columns(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(text, verdict) of the longest fitting rule."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _count(text: Column, character: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(character)))).cast("double")


def _ratio(text: Column, found: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, found, ""))) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Adds suffix and the features that need no statistics, to rows with_parts."""
    whole, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)
    return df.withColumns({
        "suffix": F.substring_index(host, ".", -1),
        "url_length": F.length(whole).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "query_length": F.length(query).cast("double"),
        "depth": _count(path, "/"), "labels": _count(host, ".") + 1, "hyphens": _count(host, "-"),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0.0),
        "digit_ratio": _ratio(whole, "[0-9]"), "host_digit_ratio": _ratio(host, "[0-9]"),
        "entropy": _entropy(whole), "host_entropy": _entropy(host),
    })


@dataclass
class Trees:
    start: float
    suffixes: DataFrame | None = None
    prior: float = 0.5
    trees: list = field(default_factory=list)  #: ("leaf", value) or (feature, bound, nulls go low, low, high)

    def margin(self) -> Column:
        def value(node) -> Column:
            if node[0] == "leaf":
                return F.lit(node[1])
            return F.when(_goes_low(*node[:3]), value(node[3])).otherwise(value(node[4]))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + value(tree)
        return total

    def score(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))

    def with_suffixes(self, df: DataFrame, hidden: Column | None = None) -> DataFrame:
        """Adds the statistics of the host's last label; null where it is unknown or ``hidden``."""
        if self.suffixes is None:
            return df.withColumns({"suffix_seen": F.lit(None).cast("double"), "suffix_blocked": F.lit(None).cast("double")})
        shown = F.lit(True) if hidden is None else ~hidden
        found = df.join(self.suffixes, "suffix", "left")
        return found.withColumns({"suffix_seen": F.when(shown, F.log1p("n")), "suffix_blocked": F.when(shown, F.col("share"))})


def _goes_low(name: str, bound, nulls_low: bool) -> Column:
    return F.coalesce(F.col(name) <= bound, F.lit(nulls_low))


def train(labelled: DataFrame, max_rows: int = 100_000, hide: int = 5, **options) -> Trees:
    """``labelled``: lexical rows with ``url`` and ``blocked`` (0 or 1). The options are those of ``boost``."""
    n, bad = labelled.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    prior = (bad + 1.0) / (n + 2.0)
    model = Trees(math.log(prior / (1 - prior)))
    if not 0 < bad < n:
        return model
    number = F.pmod(F.xxhash64("url"), F.lit(1 << 30))
    sample = labelled if n <= max_rows else labelled.filter(number < int((1 << 30) * max_rows / n))
    share = (F.sum("blocked") + 10 * prior) / (F.count("*") + 10)
    model.suffixes = stage(labelled.groupBy("suffix").agg(F.count("*").cast("double").alias("n"), share.alias("share")), "suffixes")
    if model.suffixes.count() <= BROADCAST_SUFFIXES:
        model.suffixes = F.broadcast(model.suffixes)
    hidden = F.pmod(F.xxhash64("url", F.lit("hidden")), F.lit(hide)) == 0
    model.trees = boost(stage(model.with_suffixes(sample, hidden).select(*FEATURES, "blocked"), "features"), model.start, **options)
    return model


def boost(rows: DataFrame, start: float, trees: int = 10, depth: int = 3, bins: int = 16, rate: float = 0.4, smooth: float = 1.0,
          least_gain: float = 1e-3) -> list:
    """The trees, from a stored table of features and ``blocked``."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = rows.agg(*[F.percentile_approx(f, at).alias(f) for f in FEATURES]).first()
    bounds = {f: sorted(set(cuts[f] or ())) for f in FEATURES}
    binned = {f: sum(((F.col(f) > b).cast("int") for b in bounds[f]), F.lit(0)).alias(f) for f in FEATURES}
    # rows that no split can tell apart; a bin stands for its upper bound
    train_rows = stage(rows.select("blocked", *binned.values()).groupBy("blocked", *FEATURES).agg(F.count("*").alias("w")), "binned")

    def leaf_of(node, path=""):
        if node is None:
            return F.lit(path)
        return F.when(_goes_low(*node[:3]), leaf_of(node[3], path + "l")).otherwise(leaf_of(node[4], path + "h"))

    def grown(node, path, splits):
        if node is None:
            return (*splits[path], None, None) if path in splits else None
        return (*node[:3], grown(node[3], path + "l", splits), grown(node[4], path + "h", splits))

    def leaves(node, path, values):
        if node is None:
            return ("leaf", values.get(path, 0.0))
        return (*node[:3], leaves(node[3], path + "l", values), leaves(node[4], path + "h", values))

    binned_trees: list = []
    for _ in range(trees):
        p = 1.0 / (1.0 + F.exp(-Trees(start, trees=binned_trees).margin()))
        graded = train_rows.withColumns({"g": F.col("w") * (F.col("blocked") - p), "h": F.col("w") * p * (1 - p)})
        node = None
        for _ in range(depth):
            pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])
            sums = graded.select(leaf_of(node).alias("leaf"), "g", "h", F.inline(pairs))
            found = sums.groupBy("leaf", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            splits = best_splits(found, smooth, least_gain)
            if not splits:
                break
            node = grown(node, "", splits)
        if node is None:
            break
        totals = graded.groupBy(leaf_of(node).alias("leaf")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        values = {r["leaf"]: round(rate * r["g"] / (r["h"] + smooth), 6) for r in totals}
        binned_trees.append(leaves(node, "", values))
    return [_unbinned(t, bounds) for t in binned_trees]


def best_splits(sums, smooth: float, least_gain: float) -> dict[str, tuple[str, int, bool]]:
    """For each leaf the feature, bin and side of nulls with the largest gain; rounded, so that the order
    in which sums were added does not decide. Without nulls in a leaf they join the larger side."""
    found: dict[str, dict[str, list]] = {}
    for r in sums:
        found.setdefault(r["leaf"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
    out = {}
    for leaf, features in found.items():
        best = (least_gain, None)
        for f in FEATURES:
            known = sorted(r for r in features[f] if r[0] is not None)
            nulls = [r for r in features[f] if r[0] is None]
            null_g, null_h = (nulls[0][1], nulls[0][2]) if nulls else (0.0, 0.0)
            g, h = sum(r[1] for r in features[f]), sum(r[2] for r in features[f])
            left_g = left_h = 0.0
            for i, (b, x, y) in enumerate(known):
                left_g, left_h = left_g + x, left_h + y
                last = i == len(known) - 1  # then only the nulls can go high
                sides = ([True] if not last else []) + [False] if nulls else [] if last else [round(2 * left_h - h, 9) >= 0]
                for low in sides:
                    a, c = (left_g + null_g, left_h + null_h) if low else (left_g, left_h)
                    gain = a**2 / (c + smooth) + (g - a) ** 2 / (h - c + smooth) - g**2 / (h + smooth)
                    if round(gain, 6) > best[0]:
                        best = (round(gain, 6), (f, b, low))
        if best[1]:
            out[leaf] = best[1]
    return out


def _unbinned(node, bounds):
    """Bin b holds values up to its bound, so 'bin at most b' is 'value at most bounds[b]'; the last has none."""
    if node[0] == "leaf":
        return node
    cuts = bounds[node[0]]
    bound = float(cuts[node[1]]) if node[1] < len(cuts) else math.inf
    return (node[0], bound, node[2], _unbinned(node[3], bounds), _unbinned(node[4], bounds))


def fit(labelled: DataFrame, url: str = "url", blocked: str = "blocked", **options) -> Trees:
    """From a table of URLs and labels (1: block)."""
    rows = labelled.filter(F.col(url).isNotNull() & F.col(blocked).isNotNull()).select(F.col(url).alias("url"), F.col(blocked).cast("int").alias("blocked"))
    return train(lexical(with_parts(rows, "url"), "url"), **options)


def judge(pages: DataFrame, rules: list[Rule], model: Trees, url: str = "url") -> DataFrame:
    """Rows with host, path, rule, verdict and score (of the trees, 0 to 1 for block)."""
    pages = without(pages, *RESULTS, *FEATURES, "suffix", "_rest", "n", "share")
    ready = model.with_suffixes(lexical(with_parts(pages, url), url))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    scored = ready.withColumns({"rule": rule, "verdict": verdict, "score": model.score()})
    own = F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(*pages.columns, "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
