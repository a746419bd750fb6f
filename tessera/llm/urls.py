"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule covers.

A rule is ``host/path``; it fits its host and all subdomains if the url's path starts with the rule's; the longest
fitting rule wins. Few rules are one expression; more are joined with the distinct hosts by host suffix. Urls that a rule decides
are the labelled urls: on a bounded sample of them (at most ``SAMPLE`` distinct urls of each verdict, by the smallest hash)
Spark ML trains gradient-boosted trees on lexical features: lengths, depth, digit ratio, entropy, parameter counts, and
statistics of the host's suffix. The trees judge the other urls.

The features and the trees are JVM expressions. Suffix statistics (the smoothed share of blocked urls for each top-level
domain) are counted over all distinct labelled urls by ``FOLDS`` folds and written as a table, which Spark joins as its size commands. A url
of the sample gets the share of the other folds, so its own label never tells in its features; other urls get the share of all folds, and a suffix
without labels has the prior.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is judged by the trees like any
other; if the sample lacks one of the verdicts the method allows everything; repeated rows are judged each, and train as one; other
columns pass through ``judge``, whatever their names (columns named like a result column are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE = 2000
SEED = 5
TREES, DEPTH = 12, 4
#: More rules than these are joined by host suffix.
INLINE_RULES = 500
#: Weight of the prior in a suffix's statistic, in urls.
PRIOR_URLS = 4
#: A labelled url's fold is a hash of it; shares for training come from the other folds.
FOLDS = 5
#: Shares are rounded to multiples of this.
STEP = 0.05

FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_host_depth", "f_path_depth", "f_digit_ratio", "f_entropy",
    "f_params", "f_fragment", "f_https", "f_longest_label", "f_hyphens", "f_suffix_length", "f_suffix_share",
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str]], inline: int = INLINE_RULES) -> DataFrame:
    """Adds ``ruled``, a struct (rule, verdict) of the longest fitting rule or null, to urls with host and path."""
    if len(rules) <= inline:
        return urls.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    split = [(len(r), r, v, r.partition("/")[0], "/".join(["", *r.split("/")[1:]]) if "/" in r else "") for r, v in rules]
    known = urls.sparkSession.createDataFrame(split, "size int, rule string, verdict string, rule_host string, rule_path string")
    n = F.size(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(F.split("host", r"\."), n - i + 1, i), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    fitting = hosts.join(known, "rule_host").groupBy("host").agg(F.collect_list(F.struct("size", "rule", "verdict", "rule_path")).alias("fitting"))
    best = F.array_max(F.filter("fitting", lambda x: F.startswith(F.col("path"), x["rule_path"])))
    ruled = F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict"))).alias("ruled")
    return urls.join(fitting, "host", "left").select(*urls.columns, ruled)


def _entropy(text: Column) -> Column:
    """Bits per character, from the run lengths of the sorted characters."""
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))

    def closed(a: Column) -> Column:
        return a["s"] + F.when(a["n"] > 1, a["n"] * F.log2(a["n"])).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["n"] + 1.0).otherwise(1.0).alias("n"), F.when(same, a["s"]).otherwise(closed(a)).alias("s"))

    n = F.length(text)
    return F.when(n > 0, F.log2(n) - F.aggregate(F.array_sort(F.split(text, "")), start, step, closed) / n).otherwise(0.0)


def with_features(urls: DataFrame) -> DataFrame:
    """Adds host, path, suffix and the lexical features but the suffix share."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    head = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return head.select(
        "*",
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        F.length(url).cast("double").alias("f_length"),
        F.length("host").cast("double").alias("f_host_length"),
        F.length("path").cast("double").alias("f_path_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("f_host_depth"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("f_path_depth"),
        (digits / F.greatest(F.length(url), F.lit(1))).alias("f_digit_ratio"),
        _entropy(url).alias("f_entropy"),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double").alias("f_params"),
        F.contains(url, F.lit("#")).cast("double").alias("f_fragment"),
        url.startswith("https:").cast("double").alias("f_https"),
        F.array_max(F.transform(F.split("host", r"\."), F.length)).cast("double").alias("f_longest_label"),
        F.length(F.regexp_replace("host", "[^-]", "")).cast("double").alias("f_hyphens"),
        F.length(F.element_at(F.split("host", r"\."), -1)).cast("double").alias("f_suffix_length"),
    )


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + 1), "url"), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, urls, blocked): arrays of the numbers of distinct urls, and of blocked ones, in each fold."""
    suffix = F.element_at(F.split(host_of(F.col("url")), r"\."), -1).alias("suffix")
    once = labelled.groupBy("url").agg(F.max("label").alias("label")).select(suffix, _fold().alias("fold"), "label")
    each = lambda value: F.array(*(F.sum(F.when(F.col("fold") == k, value).otherwise(0)) for k in range(FOLDS)))
    return once.groupBy("suffix").agg(each(F.lit(1)).alias("urls"), each(F.col("label")).alias("blocked"))


class UrlModel:
    """Trees, the table of suffixes (``suffix_counts``) and the prior; without trees (one verdict only) it allows all."""

    def __init__(self, trees, suffixes: DataFrame, prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def features(self, urls: DataFrame, labelled: bool = False) -> DataFrame:
        """Adds the suffix share: of all folds, or for ``labelled`` urls of all but their own."""
        def counted(name: str) -> Column:
            total = F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)
            return F.coalesce(total - F.element_at(name, _fold() + 1) if labelled else total, F.lit(0))

        share = (counted("blocked") + PRIOR_URLS * self.prior) / (counted("urls") + PRIOR_URLS)
        step = F.round(share / STEP) * STEP  # what folds of one suffix differ by is chance
        return urls.join(self.suffixes, "suffix", "left").withColumn("f_suffix_share", step).drop("urls", "blocked")

    def apply(self, urls: DataFrame) -> DataFrame:
        """Adds ``p_block`` to rows that have the features."""
        if self.trees is None:
            return urls.withColumn("p_block", F.lit(0.0))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(self.features(urls))
        return self.trees.transform(vectors).withColumn("p_block", vector_to_array("probability")[1])


def _sample(labelled: DataFrame, sample: int) -> list:
    """At most ``sample`` distinct urls of each label, those with the smallest hash; only a little more than these are made distinct."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(1 << 32)) / float(1 << 32)
    rows = []
    for label, n in sorted(counts.items()):
        some = labelled.where((F.col("label") == label) & (share < min(1.0, (2 * sample + 100) / max(1, n)))).select("url", "label").distinct()
        rows += some.orderBy(share, "url").limit(sample).collect()  # bounded
    return rows


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Fits the trees; ``labelled`` has url and label (1 block, 0 allow)."""
    labelled = labelled.where("url is not null")
    rows = _sample(labelled, sample)
    suffixes = materialise(suffix_counts(labelled))
    total = lambda name: F.sum(F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x))
    urls, blocked = suffixes.agg(total("urls"), total("blocked")).first()
    prior = (blocked or 0) / max(1, urls or 0)
    model = UrlModel(None, suffixes, prior)
    if prior in (0.0, 1.0):
        return model
    sampled = with_features(labelled.sparkSession.createDataFrame(rows, "url string, label int").coalesce(1))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(model.features(sampled, labelled=True))
    trees = GBTClassifier(featuresCol="features", labelCol="label", predictionCol="predicted", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    model.trees = trees.fit(vectors.select("url", "features", F.col("label").cast("double").alias("label")).coalesce(1).sortWithinPartitions("url").select("features", "label"))
    return model


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and p_block (the trees' probability)."""
    made = ("host", "path", "rule", "verdict", "p_block")
    own = [c for c in pages.columns if c not in made]
    located = pages.select(F.col("url").alias("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = with_rules(located, rules).where("ruled is not null").select("url", (F.col("ruled.verdict") == "block").cast("int").alias("label"))
    model = train(labelled, sample)
    rows = model.apply(with_features(pages.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), "url")))
    rows = with_rules(rows, rules).select(F.col("row"), "host", "path", F.col("ruled.rule").alias("rule"), "ruled", "p_block")
    method = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return rows.select("row.*", "host", "path", "rule", F.coalesce("ruled.verdict", method).alias("verdict"), "p_block")


def op1_url_gbt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
