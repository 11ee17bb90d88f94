"""URL filters (operator 1), in DataFrame functions only: rules by host and path, and gradient-boosted trees for the rest.

The labelled URLs are those that a rule decides; the trees learn from them to judge the URLs that none does. Features are lexical: length
of URL, host and path, depth, host labels, digit and letter ratios, entropy, parameters, hyphens, and suffix statistics: how often the host's
last one and last two labels, and the path's first segment and its extension, are blocked among all different labelled URLs, smoothed by the
overall rate. The trees are fitted to SAMPLE different labelled URLs, half of each class, those with the smallest hashes, weighed as their class is among all; so that they do not read a URL's own label from its
statistics, these are counted, for a URL of the sample, over the labelled URLs of other folds. The fitted trees become one
column expression, so every URL is judged inside generated code, without a Python worker. ``audit`` tells how well they rank held-out labelled URLs.

Cases: a null URL, or one without ://, has empty host and path and goes to the trees; repeated rows are judged alike and kept; an empty
table gives no rows; without labelled URLs the verdict is allow, with labels of one class it is that class; extra columns pass through,
but those named as results are replaced; a URL of any length is read whole."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import smallest, stage

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SAMPLE = 8192
TREES = 20
DEPTH = 4
SMOOTH = 10.0
FOLDS = 5
SUFFIXES = ("host_suffix1", "host_suffix2", "path_head", "path_extension")
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "letter_ratio", "entropy", "parameters", "hyphens")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only), and path."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(action, rule) of the longest rule that fits, or null. rules: a short list, given as a parameter."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/") if "/" in rule else len(rule)
        of_host = (host == rule[:at]) | host.endswith("." + rule[:at])
        fits = of_host & path.startswith(rule[at:]) if rule[at:] else of_host
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(F.length(whole) > 0, F.length(part) / F.length(whole)).otherwise(0.0)


def with_features(df: DataFrame, url: str) -> DataFrame:
    """df(..., host, path) with the lexical features."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    chars = F.split(u, "")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    share = lambda c: (F.length(u) - F.length(F.replace(u, c))).cast("double") / n
    entropy = F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    labels = F.split("host", r"\.")
    features = {
        "url_length": F.length(u),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.regexp_count("path", F.lit("/+[^/]")),
        "labels": F.size(labels),
        "digit_ratio": _ratio(F.regexp_replace(u, "[^0-9]", ""), u),
        "letter_ratio": _ratio(F.regexp_replace(u, "[^A-Za-z]", ""), u),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("[^&;]+"))),
        "hyphens": F.length(u) - F.length(F.replace(u, F.lit("-"))),
    }
    return df.withColumns({k: v.cast("double") for k, v in features.items()})


def with_suffixes(df: DataFrame) -> DataFrame:
    """df(..., host, path) with the suffixes."""
    return df.withColumns({"host_suffix1": F.substring_index("host", ".", -1), "host_suffix2": F.substring_index("host", ".", -2), "path_head": F.regexp_extract("path", "^/*([^/]*)", 1), "path_extension": F.regexp_extract("path", r"\.([A-Za-z0-9]+)/*$", 1)})


def _tree(node, columns: Sequence[str]) -> Column:
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    below = F.col(columns[split.featureIndex()]) <= float(split.threshold())
    return F.when(below, _tree(node.leftChild(), columns)).otherwise(_tree(node.rightChild(), columns))


@dataclass(frozen=True)
class Model:
    margin: Column  # of the columns that with_rates() and with_features() add
    stats: list[DataFrame]
    rate: float


def with_rates(df: DataFrame, stats: list[DataFrame], rate: float, fold: Column | None = None) -> DataFrame:
    """df with the suffixes' rates, those of other folds than the one given. The tables of suffixes are as large as the URLs make them; Spark sends the small
    ones to every task, by their size, and exchanges the others."""
    for name, table in zip(SUFFIXES, stats, strict=True):
        less = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - (F.get(c, fold) if fold is not None else 0), F.lit(0))  # noqa: E731, B023
        smooth = (less(F.col("_blocks")) + SMOOTH * rate) / (less(F.col("_urls")) + SMOOTH)
        df = df.join(table, name, "left").withColumn(f"{name}_rate", smooth).drop("_blocks", "_urls")
    return df


def train(labelled: DataFrame, url: str, label: str, sample: int = SAMPLE) -> Model | bool | None:
    """labelled(url, label: 1 blocks). With one class only: whether it blocks; None without rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    different = labelled.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.max(label).cast("long").alias("block"))
    host, path = split_url(F.col("url"))
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")
    every = stage(with_suffixes(different.withColumns({"host": host, "path": path, "fold": fold})))
    n, blocks = every.agg(F.count("*"), F.sum("block")).first()
    if not n or blocks in (0, n):
        return bool(blocks) if n else None
    rate = blocks / n
    in_fold = lambda c: F.array(*(F.sum(F.when(F.col("fold") == k, c).otherwise(0)) for k in range(FOLDS)))
    stats = [stage(every.groupBy(s).agg(in_fold(F.col("block")).alias("_blocks"), in_fold(F.lit(1).cast("long")).alias("_urls"))) for s in SUFFIXES]
    columns = [*LEXICAL, *(f"{s}_rate" for s in SUFFIXES)]
    half = lambda x: smallest(every.where(F.col("block") == x), -(-sample // 2), "url")
    chosen = stage(half(0).unionByName(half(1)))
    size = {r["block"]: r["count"] for r in chosen.groupBy("block").count().collect()}
    weight = F.when(F.col("block") == 1, blocks / size[1]).otherwise((n - blocks) / size[0])
    rows = with_features(with_rates(chosen, stats, rate, F.col("fold")), "url").select("url", *columns, F.col("block").cast("double").alias("label"), weight.alias("weight"))
    ordered = VectorAssembler(inputCols=columns, outputCol="features").transform(stage(rows).coalesce(1).sortWithinPartitions("url"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32, weightCol="weight").fit(ordered.select("features", "label", "weight"))
    margin = reduce(lambda a, b: a + b, (F.lit(float(w)) * _tree(t._java_obj.rootNode(), columns) for w, t in zip(model.treeWeights, model.trees, strict=True)))
    return Model(margin, stats, rate)


def with_score(df: DataFrame, model: Model | bool | None, url: str) -> DataFrame:
    """df(..., host, path) with score (double: the trees' probability of block)."""
    if not isinstance(model, Model):
        return df.withColumn("score", F.lit(float(bool(model))))
    ready = with_features(with_rates(with_suffixes(df), model.stats, model.rate), url)
    return ready.withColumn("score", 1 / (1 + F.exp(-2 * model.margin)))


def _ruled(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """df(url, ...) with host, path, and hit: the rule that decides."""
    host, path = split_url(F.col("url"))
    return df.withColumns({"host": host, "path": path}).withColumn("hit", match_rules(F.col("host"), F.col("path"), rules))


def _labelled(ruled: DataFrame) -> DataFrame:
    return ruled.where("hit is not null").select("url", F.when(F.col("hit.action") == "block", 1).otherwise(0).alias("block"))


def audit(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", sample: int = SAMPLE) -> float | None:
    """The area under the ROC curve of the trees' scores for a fifth of the different labelled URLs, which they did not learn from; None where either part
    lacks a class."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    labelled = _labelled(_ruled(df.select(F.col(url).alias("url")), rules)).distinct()
    out = F.pmod(F.xxhash64("url", F.lit("audit")), F.lit(5)) == 0
    model = train(labelled.where(~out), "url", "block", sample)
    host, path = split_url(F.col("url"))
    asked = labelled.where(out).withColumns({"host": host, "path": path})
    if not isinstance(model, Model) or asked.select("block").distinct().count() < 2:
        return None
    scored = stage(with_score(asked, model, "url").select("score", F.col("block").cast("double").alias("block")))
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="block").evaluate(scored)


def judge(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """df's columns, host, path, rule (string or null), verdict (allow or block), score (double: the trees' probability of block; null
    where they were not asked)."""
    names = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    ruled = _ruled(df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(names)), F.col(url).alias("url")), rules)
    scored = with_score(ruled, train(_labelled(ruled), "url", "block", sample), "url")
    own = F.when(F.col("hit").isNull(), F.col("score"))
    verdict = F.coalesce(F.col("hit.action"), F.when(own > 0.5, "block").otherwise("allow"))
    return scored.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), own.alias("score"))
