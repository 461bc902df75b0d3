"""URL filters: rules first, then gradient-boosted trees on lexical features. DataFrame operations alone.

The trees learn from the URLs that a rule judges. Features fall into a few bins each, the labelled sample is summed up by its
bins, and each level of a tree is one aggregation of gradients by node, feature and bin. A tree becomes a column expression, so
judging is one scan without a shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by its features;
ties between rules of equal length go to the first; repeated rows give repeated results; with no labelled URLs, or with those
of one verdict only, that verdict (else allow) holds for all; an empty table gives an empty result; html is not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules become one expression; more than so many are refused.
MOST_RULES = 1000
#: The bounds of the labelled sample, and of the suffixes that have statistics.
LABELLED, SUFFIXES = 50_000, 500
TREES, DEPTH, RATE, LEAST_WEIGHT, L2 = 12, 2, 0.4, 20.0, 1.0
#: Upper ends of each feature's bins.
BINS = {
    "length": (20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 100, 150),
    "host_length": (8, 12, 16, 18, 20, 22, 25, 30, 40),
    "depth": (0, 1, 2, 3, 4, 6, 8),
    "labels": (1, 2, 3, 4, 5, 7),
    "digit_ratio": (0.0, 0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5),
    "entropy": (1.0, 2.0, 2.5, 3.0, 3.2, 3.4, 3.6, 3.8, 4.0, 4.2),
    "parameters": (0, 1, 2, 3, 5, 8),
    "hyphens": (0, 1, 2, 4),
    "suffix_block": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95),
    "segment_block": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda x: len(x[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character, over a-z, 0-9 and all others as one."""
    low, n = F.translate(text, UPPER, LOWER), F.greatest(F.length(text), F.lit(1)).cast("double")
    counts = [(F.length(low) - F.length(F.translate(low, c, ""))) / n for c in LOWER + "0123456789"]
    counts.append(F.length(F.translate(low, LOWER + "0123456789", "")) / n)
    return reduce(lambda a, b: a + b, [F.when(c > 0, -c * F.log2(c)).otherwise(F.lit(0.0)) for c in counts])


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, url's parts and its features but for the statistics."""
    host, path = host_and_path(F.col("url"))
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", url.alias("_url"), host.alias("host"), path.alias("path"))
    digits = F.length("_url") - F.length(F.translate("_url", "0123456789", ""))
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    return rows.select(
        "page_id", "host", "path",
        F.length("_url").alias("length"),
        F.length("host").alias("host_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).alias("depth"),
        F.size(F.filter(F.split("host", r"\."), lambda x: x != "")).alias("labels"),
        (digits / F.greatest(F.length("_url"), F.lit(1))).alias("digit_ratio"),
        entropy(F.col("_url")).alias("entropy"),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).alias("parameters"),
        (F.length("host") - F.length(F.translate("host", "-", ""))).alias("hyphens"),
        F.substring_index("host", ".", -1).alias("_suffix"),
        F.lower(F.split_part(F.concat(F.col("path"), F.lit("//")), F.lit("/"), F.lit(2))).alias("_segment"),
        *(c.alias(n) for c, n in zip(rule_of(F.col("host"), F.col("path")), ("rule", "_said"), strict=True)),
    )


def block_rates(labelled: DataFrame, column: str, prior: float) -> dict[str, float]:
    """Share of blocked URLs, shrunk to the prior, for the SUFFIXES most frequent values."""
    counts = labelled.groupBy(column).agg(F.count("*").alias("n"), F.sum("_y").alias("k")).orderBy(F.desc("n"), column).limit(SUFFIXES)
    return {x[column]: (x["k"] + 5 * prior) / (x["n"] + 5) for x in counts.collect() if x[column] is not None}


def looked_up(column: str, rates: dict[str, float], prior: float) -> Column:
    if not rates:
        return F.lit(prior)
    table = F.create_map(*(F.lit(x) for kv in sorted(rates.items()) for x in kv))
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(prior))


def binned(name: str) -> Column:
    out = F.lit(len(BINS[name]))
    for k, end in reversed(list(enumerate(BINS[name]))):
        out = F.when(F.col(name) <= end, k).otherwise(out)
    return out


def grow(sums: DataFrame, score: Column, depth: int = DEPTH) -> Column:
    """One tree: the column of what it adds to the log-odds of block. ``sums``: bins, _n rows and _k blocked."""
    p = 1 / (1 + F.exp(-score))
    rows = sums.select(*BINS, (F.col("_n") * p - F.col("_k")).alias("_g"), (F.col("_n") * p * (1 - p)).alias("_h"))
    splits: dict[int, tuple[str, int]] = {}
    totals: dict[int, tuple[float, float]] = {}
    pairs = ", ".join(f"'{n}', {n}" for n in BINS)

    def node(upto: int) -> Column:
        """Node numbers at a level: the children of i are 2i and 2i + 1."""
        at = F.lit(1)
        for _ in range(upto):
            step = at * 2
            out = F.lit(0)  # a node that wasn't split keeps nothing below
            for i, (name, end) in splits.items():
                out = F.when(at == i, step + (F.col(name) > end).cast("int")).otherwise(out)
            at = out
        return at

    for level in range(depth):
        stacked = rows.withColumn("_node", node(level)).where("_node > 0").selectExpr("_node", "_g", "_h", f"stack({len(BINS)}, {pairs}) as (_f, _b)")
        found = stacked.groupBy("_node", "_f", "_b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
        by: dict[int, dict[str, list]] = {}
        for x in found:
            by.setdefault(x["_node"], {}).setdefault(x["_f"], []).append((x["_b"], x["g"], x["h"]))
        for i, features in sorted(by.items()):
            g, h = (sum(x[k] for x in next(iter(features.values()))) for k in (1, 2))
            totals[i] = (g, h)
            best = (1e-6, "", 0, 0.0, 0.0)
            for name in BINS:
                lg = lh = 0.0
                for b, dg, dh in sorted(features.get(name, [])):
                    lg, lh = lg + dg, lh + dh
                    if min(lh, h - lh) * 4 >= LEAST_WEIGHT:
                        gain = lg**2 / (lh + L2) + (g - lg) ** 2 / (h - lh + L2) - g**2 / (h + L2)
                        if gain > best[0] + 1e-9:
                            best = (gain, name, b, lg, lh)
            if best[1]:
                splits[i] = best[1:3]
                totals[2 * i], totals[2 * i + 1] = best[3:], (g - best[3], h - best[4])

    def leaf(i: int) -> Column:
        if i in splits:
            name, end = splits[i]
            return F.when(F.col(name) <= end, leaf(2 * i)).otherwise(leaf(2 * i + 1))
        g, h = totals.get(i, (0.0, 0.0))
        return F.lit(round(-RATE * g / (h + L2), 9))

    return leaf(1)


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log-odds of block by the trees)."""
    rows = lexical(pages)
    sample = common.least(rows.where("_said is not null"), F.xxhash64("host", "path"), LABELLED, "page_id")
    sample = common.materialise(sample.withColumn("_y", (F.col("_said") == "block").cast("int")), "labelled-urls")
    n, k = sample.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    prior = (k + 1) / (n + 2)
    rates = {c: block_rates(sample, c, prior) for c in ("_suffix", "_segment")} if n else {"_suffix": {}, "_segment": {}}

    def with_bins(df: DataFrame, *keep: str) -> DataFrame:
        df = df.withColumn("suffix_block", looked_up("_suffix", rates["_suffix"], prior)).withColumn("segment_block", looked_up("_segment", rates["_segment"], prior))
        return df.select(*keep, *(binned(x).alias(x) for x in BINS))

    from math import log

    score = F.lit(round(log(prior / (1 - prior)), 9))
    if 0 < k < n:
        sums = with_bins(sample, "_y").groupBy(*BINS).agg(F.count("*").alias("_n"), F.sum("_y").alias("_k"))
        sums = common.materialise(sums.coalesce(1), "url-bins")
        for _ in range(TREES):
            score = score + grow(sums, score)
    else:
        score = F.lit(1.0 if k else -1.0)
    judged = with_bins(rows, "page_id", "host", "path", "rule", "_said")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
