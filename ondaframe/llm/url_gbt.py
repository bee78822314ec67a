"""URL verdicts by rules and by gradient-boosted trees on lexical features.

Everything is DataFrame expressions.  URLs that a rule decides are the
labelled ones; trees are fitted to a bounded sample of them and judge the
rest.  Features: lengths, path depth, digit ratio, character entropy,
parameter and label counts, and the smoothed blocking rates of the host's
suffixes, the path's file suffix and its leading segment.

Features are cut into bins once; the sample collapses to distinct bin vectors
with counts, and each level of a tree is one small aggregation of gradients by
(leaf, feature, bin).  The fitted trees are one CASE expression, so scoring is
a projection over the scan with four joins to small tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_out

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NUMERIC = ["url_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens"]
_KINDS = ["suffix1", "suffix2", "file_suffix", "leading"]


@dataclass(frozen=True)
class Settings:
    #: Most distinct labelled URLs that training reads, smallest hash first.
    max_rows: int = 20_000
    bins: int = 8
    trees: int = 12
    depth: int = 2
    rate: float = 0.5
    l2: float = 1.0
    #: A suffix or segment seen less often gets the overall rate.
    least: int = 20
    threshold: float = 0.5


@dataclass
class Model:
    bias: float
    prior: float
    rates: DataFrame | None
    cuts: dict[str, list[float]] = field(default_factory=dict)
    trees: list = field(default_factory=list)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for URLs without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(df: DataFrame) -> DataFrame:
    """df (url, host, path) with lexical features; null URLs count as empty."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    letters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / n
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    last = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)
    return (
        df.withColumn("url_length", F.length(url).cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("depth", F.length(F.regexp_replace("path", "[^/]", "")).cast("double"))
        .withColumn("digit_ratio", F.length(F.regexp_replace(url, "[^0-9]", "")) / n)
        .withColumn("entropy", F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))))
        .withColumn("parameters", F.when(query == "", 0.0).otherwise(F.length(F.regexp_replace(query, "[^&]", "")) + 1.0))
        .withColumn("host_labels", F.size(labels).cast("double"))
        .withColumn("hyphens", F.length(F.regexp_replace(url, "[^-]", "")).cast("double"))
        .withColumn("suffix1", F.substring_index("host", ".", -1))
        .withColumn("suffix2", F.substring_index("host", ".", -2))
        .withColumn("file_suffix", F.lower(last))
        .withColumn("leading", F.regexp_extract("path", r"^/([^/]*)", 1))
    )


def _with_rates(df: DataFrame, model: Model) -> DataFrame:
    """A column <kind>_rate for each kind; values without a rate get the overall one."""
    for kind in _KINDS:
        if model.rates is None:
            df = df.withColumn(f"{kind}_rate", F.lit(model.prior))
        else:
            mine = model.rates.where(F.col("kind") == kind).select(F.col("value").alias(kind), F.col("rate").alias(f"{kind}_rate"))
            # at most max_rows / least rows: each value occurs that often in the bounded sample
            df = df.join(F.broadcast(mine), kind, "left").withColumn(f"{kind}_rate", F.coalesce(f"{kind}_rate", F.lit(model.prior)))
    return df


def _tree(tree, value) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, k, low, high = tree
    return F.when(value(feature, k), _tree(high, value)).otherwise(_tree(low, value))


def fit(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """labelled: url, host, path, y (1: block).  No row, or one class only, gives a model without trees.

    A URL that is repeated counts once.  URLs are thinned by hash to about twice
    the sample before they are made distinct and ordered.
    """
    known = labelled.select("url", "host", "path", F.col("y").cast("double").alias("y"), F.xxhash64("url").alias("_h"))
    share = min(1.0, 2 * s.max_rows / max(1, known.agg(F.approx_count_distinct("_h")).first()[0]))
    thin = known.where(F.col("_h") <= int(-(2**63) + share * (2**64 - 1025))).distinct()
    few = thin.orderBy("_h", "url", "y").limit(s.max_rows).drop("_h")
    sample = stage_out(features(few), "url-sample")
    size, blocked = sample.agg(F.count("*"), F.sum("y")).first()
    if not size:
        return Model(0.0, 0.5, None)
    prior = float(blocked) / size
    stacked = sample.select("y", F.explode(F.map_from_arrays(F.array(*map(F.lit, _KINDS)), F.array(*_KINDS))).alias("kind", "value"))
    rate = (F.sum("y") + prior * s.least) / (F.count("*") + s.least)
    rates = stage_out(stacked.groupBy("kind", "value").agg(F.count("*").alias("n"), rate.alias("rate")).where(F.col("n") >= s.least).drop("n"), "url-rates")
    names = [*_NUMERIC, *(f"{k}_rate" for k in _KINDS)]
    model = Model(0.0, prior, rates)
    rated = stage_out(_with_rates(sample, model).select("y", *names), "url-rated")
    shares = [(k + 1) / s.bins for k in range(s.bins - 1)]
    cuts = rated.agg(*[F.percentile_approx(n, shares, 2000).alias(n) for n in names]).first()
    model.cuts = {n: sorted(set(cuts[n])) for n in names}
    binned = lambda n: sum((F.when(F.col(n) > c, 1).otherwise(0) for c in model.cuts[n]), F.lit(0))
    table = stage_out(rated.select("y", *[binned(n).alias(n) for n in names]).groupBy("y", *names).agg(F.count("*").cast("double").alias("n")).coalesce(1), "url-bins").coalesce(1)  # one partition: levels need no exchange
    p = min(max(prior, 1e-6), 1 - 1e-6)
    model.bias = math.log(p / (1 - p))
    value = lambda n, k: F.col(n) > k
    for _ in range(s.trees):
        margin = sum((_tree(t, value) for t in model.trees), F.lit(model.bias))
        chance = 1 / (1 + F.exp(-margin))
        graded = table.select(*names, (F.col("n") * (F.col("y") - chance)).alias("g"), (F.col("n") * chance * (1 - chance)).alias("h"))
        model.trees.append(_grow(graded, names, s))
    return model


def _grow(graded: DataFrame, names: list[str], s: Settings):
    """A tree of nested (feature, bin, low, high); leaves are steps.  One aggregation a level."""
    root: dict = {}
    leaves: list[tuple[Column, dict]] = [(F.lit(True), root)]
    for level in range(s.depth + 1):
        at = F.coalesce(*[F.when(where, k) for k, (where, _) in enumerate(leaves)])
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names]))
        got = graded.select("g", "h", at.alias("leaf"), pairs.alias("p")).groupBy("leaf", "p.f", "p.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        below: list[tuple[Column, dict]] = []
        for k, (where, node) in enumerate(leaves):
            mine = [r for r in got if r["leaf"] == k]
            total_g, total_h = (sum(r[c] for r in mine if r["f"] == names[0]) for c in ("g", "h"))
            node["step"] = s.rate * total_g / (total_h + s.l2)
            best = None
            for n in names if level < s.depth else []:
                bins = sorted((r["b"], r["g"], r["h"]) for r in mine if r["f"] == n)
                g = h = 0.0
                for b, x, y in bins[:-1]:
                    g, h = g + x, h + y
                    gain = g * g / (h + s.l2) + (total_g - g) ** 2 / (total_h - h + s.l2) - total_g**2 / (total_h + s.l2)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = gain, n, b
            if best:
                _, n, b = best
                node.update(split=(n, b), low={}, high={})
                below += [(where & (F.col(n) <= b), node["low"]), (where & (F.col(n) > b), node["high"])]
        leaves = below
        if not leaves:
            break

    def shape(node: dict):
        if "split" not in node:
            return node["step"]
        return (*node["split"], shape(node["low"]), shape(node["high"]))

    return shape(root)


def score(df: DataFrame, model: Model) -> DataFrame:
    """df (url, host, path, ...) with score: the chance that the URL is to be blocked."""
    value = lambda n, k: F.col(n) > model.cuts[n][k]
    margin = sum((_tree(t, value) for t in model.trees), F.lit(model.bias))
    keep = df.columns
    return _with_rates(features(df), model).select(*keep, (1 / (1 + F.exp(-margin))).alias("score"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], s: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page.

    Rules decide where one fits; the trees decide the rest: block from
    `threshold` on, allow below and where nothing could be learnt.  Null and
    malformed URLs have empty hosts and paths.  Repeated rows stay; other
    columns are not read; an empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    labelled = cut.where(F.col("r").isNotNull()).select("url", "host", "path", (F.col("r.verdict") == "block").cast("int").alias("y"))
    scored = score(cut, fit(labelled, s))
    guess = F.when(F.col("score") >= s.threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", guess).alias("verdict"), "score")
