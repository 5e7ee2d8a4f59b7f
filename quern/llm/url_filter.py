"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions only.

Features are lexical alone, no word is known to them: lengths, depth, digit, hyphen and vowel ratios, character entropy, parameter count, host labels,
and statistics of the host's suffix (its share of blocked labels, smoothed, of every suffix among the labelled rows). The trees are trained from labelled URLs; :func:`labelled_urls`
makes a fixed set of them by rule, in which the classes differ in every feature and overlap in each, and callers may pass their own. A finished tree is a chain of CASE expressions, so scoring
stays in one projection over the scan, which reads the url column only.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees; repeated
rows come out as often as they go in; no labelled rows, or those of one class alone, give every url the share of blocked ones; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
N_LABELLED, MAX_LABELLED, ROUNDS, DEPTH, SEED = 3000, 20_000, 30, 5, 17
#: Rows and features that a tree sees.
SUBSAMPLE, SUBSET = 0.5, "0.25"
THRESHOLD = 0.5
#: A suffix's share of blocked labels is pulled to the overall share as if by so many labels.
SUFFIX_PRIOR = 20.0
FEATURES = ["length", "host_length", "depth", "digit_ratio", "host_digits", "hyphens", "vowel_ratio", "entropy", "n_params", "longest_label", "n_labels", "has_ip", "suffix_share"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host with A-Z lowered, and the path; empty where there is none."""
    # (?s) with . for any character; \z rather than $, which also stands before a last line break
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def ruled(host: Column, path: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with url, host, path) with the features but for suffix_share, and the suffix."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.length(url), F.lit(1))
    without = lambda c, chars: F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]", ""))
    alphabet = _LOWER + "0123456789-./_=&?%"
    low = F.translate(url, _UPPER, _LOWER)
    shares = [(F.length(low) - F.length(F.translate(low, c, ""))) / size for c in alphabet]
    entropy = -reduce(lambda a, b: a + b, [F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in shares])
    labels = F.split(host, r"\.")
    return urls.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        without(path, "/").cast("double").alias("depth"),
        (without(url, "0-9") / size).alias("digit_ratio"),
        without(host, "0-9").cast("double").alias("host_digits"),
        without(host, "-").cast("double").alias("hyphens"),
        (without(host, "aeiou") / F.greatest(F.length(host), F.lit(1))).alias("vowel_ratio"),
        entropy.alias("entropy"),
        (F.length(F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "[^=]", ""))).cast("double").alias("n_params"),
        F.array_max(F.transform(labels, F.length)).cast("double").alias("longest_label"),
        F.size(labels).cast("double").alias("n_labels"),
        host.rlike(r"\A\d+\.\d+\.\d+\.\d+(:\d+)?\z").cast("double").alias("has_ip"),
        F.regexp_replace(F.element_at(labels, -1), r":\d*\z", "").alias("suffix"),
    )


#: Kinds of labelled sites, the first three plain; and the chance of each part of an address by kind.
KINDS = ("home", "article", "shop", "farm", "track", "random", "cheap")
ODDS = {
    "subdomain": (0.10, 0.20, 0.20, 0.20, 0.40, 0.60, 0.30),
    "token_label": (0.00, 0.00, 0.01, 0.02, 0.10, 0.97, 0.10),
    "hyphen": (0.02, 0.03, 0.03, 0.99, 0.50, 0.50, 0.90),
    "hyphens": (0.00, 0.01, 0.01, 0.30, 0.20, 0.20, 0.40),
    "host_number": (0.01, 0.01, 0.02, 0.25, 0.30, 0.70, 0.70),
    "known_suffix": (0.75, 0.75, 0.75, 0.80, 0.60, 0.60, 0.05),
    "country": (0.98, 0.98, 0.98, 0.30, 0.10, 0.10, 0.01),
    "number_host": (0.00, 0.00, 0.00, 0.00, 0.15, 0.05, 0.00),
    "section": (0.80, 0.90, 0.70, 0.80, 0.50, 0.40, 0.60),
    "word": (0.10, 0.80, 0.40, 0.15, 0.40, 0.20, 0.30),
    "slug": (0.00, 0.80, 0.20, 0.05, 0.20, 0.10, 0.20),
    "token": (0.01, 0.03, 0.10, 0.05, 0.60, 0.50, 0.20),
    "number": (0.95, 0.90, 0.90, 0.90, 0.30, 0.40, 0.60),
    "long_number": (0.10, 0.10, 0.20, 0.50, 0.50, 0.50, 0.50),
    "query": (0.30, 0.25, 0.80, 0.30, 0.95, 0.40, 0.50),
    "affiliate": (0.01, 0.03, 0.10, 0.10, 0.97, 0.30, 0.30),
    "sub": (0.00, 0.01, 0.03, 0.05, 0.95, 0.20, 0.20),
    "further": (0.00, 0.01, 0.10, 0.02, 0.70, 0.10, 0.15),
}


def labelled_urls(spark: SparkSession, n: int = N_LABELLED) -> DataFrame:
    """url, blocked (0 or 1): plain sites (homes, articles, shops) and bulk ones (link farms, trackers, random and cheap hosts), by rule from the row number alone.

    All kinds' addresses are drawn from the same parts, each part with a chance by kind (``ODDS``): the classes differ in every feature and overlap in each.
    """
    salts = iter(range(1, 1000))
    draw = lambda below: F.pmod(F.xxhash64("id", F.lit(next(salts))), F.lit(below))
    bulk = F.col("id") % 2 == 1
    kind = F.when(bulk, draw(4) + 3).otherwise(draw(3)).cast("int")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (draw(len(words)) + 1).cast("int"))
    number = lambda below: draw(below).cast("string")
    chance = lambda part: draw(10_000) / 10_000 < F.element_at(F.array(*map(F.lit, ODDS[part])), kind + 1)
    maybe = lambda part, *then: F.when(chance(part), F.concat(*then)).otherwise(F.lit(""))
    syllables = ["th", "er", "on", "an", "re", "st", "in", "ea", "ti", "ou", "nd", "en", "mar", "lin", "sol", "ber", "casa", "news", "free", "shop"]
    word = lambda: F.concat(pick(syllables), pick(syllables), pick(["", "", *syllables]))
    token = lambda: F.substring(F.md5(F.concat(F.lit(next(salts)), F.lit("/"), F.col("id").cast("string"))), 1, 12)
    dash, slash = F.lit("-"), F.lit("/")
    suffix = F.when(chance("known_suffix"), pick([".com", ".com", ".org", ".net", ".net", ".org"])).when(chance("country"), pick([".edu", ".de", ".fr", ".es"])).otherwise(pick([".xyz", ".top", ".biz", ".click"]))
    named = F.concat(
        F.when(chance("subdomain"), F.concat(word(), F.lit("."))).otherwise(pick(["", "", "www.", "blog.", "m.", "docs."])), maybe("token_label", token(), F.lit(".")),
        word(), maybe("hyphen", dash, word()), maybe("hyphens", dash, word()), maybe("host_number", number(10_000)), pick(["", ".example", "", ".example"]), suffix,
    )
    numbered = F.concat(pick(["10.", "192.", "45."]), number(256), F.lit("."), number(256), F.lit("."), number(256))
    path = F.concat(
        slash, maybe("section", pick(["en", "fr", "de", "es", "news", "wiki", "go", "p"]), slash), maybe("word", word(), slash), maybe("slug", word(), dash, word(), dash, word(), slash), maybe("token", token(), slash),
        F.when(chance("number"), F.when(chance("long_number"), number(10_000_000)).otherwise(number(10_000))).otherwise(token()), pick(["", "", ".html", "/", ".php"]),
    )
    asked = F.concat(F.lit("?"), pick(["page=2&ref=x", "utm_source=feed", "id=7", "q=the"]), maybe("affiliate", F.lit("&aff="), number(100_000)), maybe("sub", F.lit("&sub="), token()), maybe("further", F.lit("&k="), number(1000), F.lit("&z=1")))
    url = F.concat(pick(["http://", "https://"]), F.when(chance("number_host"), numbered).otherwise(named), path, F.when(chance("query"), asked).otherwise(pick(["", "", "", "#top"])))
    return spark.range(n).select(url.alias("url"), bulk.cast("int").alias("blocked"))


def _prepared(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return lexical(urls.withColumns({"host": host, "path": path}))


#: A tree as nested tuples: (leaf value,) or (feature, threshold, low side, high side).
Tree = tuple


def trees_of(model) -> list[tuple[float, Tree]]:
    """Weight and nodes of each boosted tree."""

    def walk(node) -> Tree:
        if node.numDescendants() == 0:
            return (float(node.prediction()),)
        split = node.split()
        return FEATURES[split.featureIndex()], float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return [(float(w), walk(t._java_obj.rootNode())) for t, w in zip(model.trees, model.treeWeights)]


def tree_sum(trees: list[tuple[float, Tree]]) -> Column:
    """The boosted trees' margin as nested CASE expressions."""

    def case(node: Tree) -> Column:
        if len(node) == 1:
            return F.lit(node[0])
        feature, threshold, low, high = node
        return F.when(F.col(feature) <= threshold, case(low)).otherwise(case(high))

    return reduce(lambda a, b: a + b, [F.lit(w) * case(t) for w, t in trees])


class Judge:
    """Boosted trees and suffix statistics of labelled URLs (url, blocked), of which at most MAX_LABELLED are used (those of the smallest hashes).

    Training takes as long for any number of pages; a judge that is saved is trained once, and scores the same after :meth:`load`.
    """

    def __init__(self, labelled: DataFrame):
        rows = _prepared(labelled.where("url is not null and blocked is not null").orderBy(F.xxhash64("url"), "url", "blocked").limit(MAX_LABELLED))
        counts = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("k")).orderBy("suffix").collect()  # no more than MAX_LABELLED
        n, k = sum(r.n for r in counts), sum(r.k for r in counts)
        self.overall = k / n if n else 0.0
        self.shares = {r.suffix: (r.k + SUFFIX_PRIOR * self.overall) / (r.n + SUFFIX_PRIOR) for r in counts}
        self.trees: list[tuple[float, Tree]] = []
        self.margin, self.importance = F.lit(2.0 * self.overall - 1.0), dict.fromkeys(FEATURES, 0.0)
        if 0 < k < n:
            ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self.with_features(rows, ["blocked"])).select("features", F.col("blocked").cast("double").alias("label"))
            ready = ready.repartition(1).cache()
            model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, subsamplingRate=SUBSAMPLE, featureSubsetStrategy=SUBSET, minInstancesPerNode=5, seed=SEED).fit(ready)
            ready.unpersist()
            self.trees, self.importance = trees_of(model), dict(zip(FEATURES, model.featureImportances.toArray().tolist()))
            self.margin = tree_sum(self.trees)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write suffix statistics, importances and trees as one JSON text under ``path``, which must not exist yet."""
        kept = {"features": FEATURES, "overall": self.overall, "shares": self.shares, "importance": self.importance, "trees": self.trees}
        spark.range(1).select(F.lit(json.dumps(kept)).alias("value")).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Judge:
        """The judge that was saved under ``path``; an error if it was trained on other features."""
        kept = json.loads(spark.read.text(path, wholetext=True).where("value <> ''").first().value)
        if kept["features"] != FEATURES:
            raise ValueError(f"the judge under {path} was trained on other features: {kept['features']}")
        judge = cls.__new__(cls)
        judge.overall, judge.shares, judge.importance, judge.trees = kept["overall"], kept["shares"], kept["importance"], kept["trees"]
        judge.margin = tree_sum(judge.trees) if judge.trees else F.lit(2.0 * judge.overall - 1.0)
        return judge

    def with_features(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and FEATURES as columns of a generator of one row: each is computed once, however often the trees (or a caller's filter) name it."""
        return self.with_share(rows).select(*keep, F.inline(F.array(F.struct(*FEATURES))))

    def with_share(self, rows: DataFrame) -> DataFrame:
        known = F.from_json(F.lit(json.dumps(self.shares)), "map<string,double>")  # one literal, folded once
        return rows.withColumn("suffix_share", F.coalesce(known[F.col("suffix")], F.lit(self.overall)))

    def score(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * self.margin))


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, judge: Judge | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (of the trees: likelihood of block), by ``judge``, or one trained from ``labelled``."""
    judge = judge or Judge(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    rows = judge.with_features(_prepared(pages.select("page_id", F.col("url").cast("string").alias("url"))), ["page_id", "host", "path"])
    rule, verdict = ruled(F.col("host"), F.col("path"))
    scored = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.round(judge.score(), 9).alias("score"))
    by_trees = F.when(F.col("score") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_trees).alias("verdict"), "score")
