"""Language ID of web pages by Bayesian evidence fusion.

log posterior = log host prior + tempered log likelihood of the text + log P(declared language | language) + log P(language
segment of the address | language).

* Text: hashed byte trigrams of the visible text, whole, under one smoothed multinomial a language. They are counted over at most
  ``TRAIN_DOCS`` documents with a ``lang``, those of the smallest hashes of their ids, and ``LANGUAGE_DOCS`` of each language, so that every
  language of the documents is a possible answer. A language takes 128 KB of the model and a column of the host votes; there is no cap.
* Declared: the lang attribute of the html tag. Address: a path segment such as /fr/.
* Host prior: each page votes for languages by its own evidence; votes are summed by host in a grouped aggregation, and smoothed
  towards the host's domain, that towards its address suffix (com, de, ...), and that towards all pages. So a suffix
  speaks through what its pages are. A page's own vote is taken out of all four sums before they become its prior: its evidence counts once.
  Hosts of a large part of all pages are joined by broadcast (at most ``common.HOT_KEYS`` of them), the others by shuffle.

Defined cases: null html has no text and declares nothing; a null url has an empty host, domain and suffix; unknown declared
languages are no evidence; no labelled document at all gives null languages; repeated rows vote and come out as often as
they go in; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, join_hot, map_pieces, utf8
from .url_filter import host_and_path

TRAIN_DOCS, LANGUAGE_DOCS, BUCKETS = 4000, 200, 1 << 14
#: Trigrams overlap and depend on each other: their likelihood counts by this power.
TEMPER = 0.2
#: Chance that a page declares, or its address names, the language it is in.
TRUST_DECLARED, TRUST_ADDRESS = 0.95, 0.9
#: Votes by which a level is pulled to the one above.
PRIOR_VOTES = 5.0
DIGITS = 6

_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>")
_DECLARED = re.compile(rb"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""")


def visible(html: bytes) -> bytes:
    return _HIDDEN.sub(b" ", html)


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of all trigrams of the lowered text, in which runs of other bytes than word bytes are one space."""
    data = tc.LOWER[np.frombuffer(text, np.uint8)]
    keep = tc.IS_WORD[data]
    data = np.where(keep, data, np.uint8(32))
    shown = keep.copy()
    shown[1:] |= keep[:-1]
    data = data[shown].astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


class TextModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.copy() if len(languages) else np.zeros((BUCKETS, 0))

    def likelihood(self, text: bytes) -> np.ndarray:
        found = np.bincount(trigrams(text), minlength=BUCKETS)
        some = np.flatnonzero(found)
        return found[some] @ self.table[some]


def fitted(docs: DataFrame, rows: int = TRAIN_DOCS) -> TextModel:
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("lang")).alias("lang"), "text").where("doc_id is not null and lang is not null and text is not null")
    ids = usable.select("doc_id", "lang")
    each = ids.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("_nth") <= LANGUAGE_DOCS).drop("_nth")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(rows).unionByName(each).distinct()
    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"])

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = utf8(piece.column("text"))
        langs, whole = np.array(piece.column("lang").to_pylist(), object), data.tobytes()
        out: dict[str, np.ndarray] = {}
        for name, a, b in zip(langs, bounds[:-1].tolist(), bounds[1:].tolist()):
            got = np.bincount(trigrams(whole[a:b]), minlength=BUCKETS)
            out[name] = out[name] + got if name in out else got
        names, buckets, ns = [], [], []
        for name, got in out.items():
            some = np.flatnonzero(got)
            names += [name] * len(some)
            buckets.append(some)
            ns.append(got[some])
        flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), flat(buckets), flat(ns)], ["lang", "bucket", "n"])

    counted = map_pieces(texts, "text", count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in each.select("lang").distinct().collect())
    at = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    for r in counted.toLocalIterator() if languages else ():
        counts[at[r.lang], r.bucket] = r.n
    return TextModel(languages, counts)


def named(languages: list[str], found: str | None, trust: float) -> np.ndarray:
    """log P(the name that was found | language); zeros if it is none of the languages."""
    if found not in languages or len(languages) < 2:
        return np.zeros(len(languages))
    out = np.full(len(languages), np.log((1 - trust) / (len(languages) - 1)))
    out[languages.index(found)] = np.log(trust)
    return out


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, declared, own (log evidence of the page alone, the largest 0); map-only."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    host = F.regexp_replace(host, r":\d*\z", "")
    labels = F.split("host", r"\.")
    read = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), F.lower(F.regexp_extract(path, r"(?i)/([a-z]{2,3})(?:/|\z)", 1)).alias("segment"))
    read = read.withColumns({"domain": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."), "suffix": F.element_at(labels, -1)})

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value.languages
        data, bounds = utf8(piece.column("html"))
        whole, declared, own = data.tobytes(), [], []
        for a, b, segment in zip(bounds[:-1].tolist(), bounds[1:].tolist(), piece.column("segment").to_pylist()):
            html = whole[a:b]
            name = m[1].decode().lower() if (m := _DECLARED.search(html)) else None
            log = TEMPER * shared.value.likelihood(visible(html)) + named(known, name, TRUST_DECLARED) + named(known, segment, TRUST_ADDRESS)
            declared.append(name)
            own.append((log - log.max(initial=-np.inf)).tolist() if known else [])
        return pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("page_id", "host", "domain", "suffix")), pa.array(declared, pa.string()), pa.array(own, pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "declared", "own"])

    return map_pieces(read, "html", step, "page_id long, host string, domain string, suffix string, declared string, own array<double>")


def normal(logs: Column) -> Column:
    """Shares that sum to 1, from logs."""
    raised = F.transform(logs, F.exp)
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def host_votes(own: DataFrame, n: int) -> DataFrame:
    """host, pages, votes: sums of votes by language of the host, its domain, its suffix and all pages, as four arrays. Grouped aggregations, each of the one before."""
    votes = own.select("host", "domain", "suffix", normal(F.col("own")).alias("v"))
    hosts = votes.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(n)])
    packed = lambda letter: F.array(*[f"{letter}{i}" for i in range(n)])
    hosts = checkpointed(hosts)
    domains = checkpointed(hosts.groupBy("domain", "suffix").agg(*[F.sum(f"v{i}").alias(f"d{i}") for i in range(n)]))
    suffixes = domains.groupBy("suffix").agg(*[F.sum(f"d{i}").alias(f"s{i}") for i in range(n)])
    everywhere = domains.agg(*[F.sum(f"d{i}").alias(f"a{i}") for i in range(n)]).select(packed("a").alias("a"))  # one row
    joined = hosts.select("host", "domain", "suffix", "pages", packed("v").alias("v")).join(domains.select("domain", packed("d").alias("d")), "domain").join(suffixes.select("suffix", packed("s").alias("s")), "suffix")
    return checkpointed(joined.join(F.broadcast(everywhere), F.lit(True)).select("host", "pages", F.struct("v", "d", "s", "a").alias("votes")))


def prior(own: Column, votes: Column, n: int) -> Column:
    """A page's prior: each level's votes without its own, smoothed by the level above; all pages by one vote a language."""
    mine = normal(own)
    others = lambda level: F.zip_with(level, mine, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    smoothed = lambda level, above, weight: F.transform(F.zip_with(level, above, lambda x, p: x + weight * p), lambda x: x / (total(level) + weight))
    out = smoothed(others(votes["a"]), F.array_repeat(F.lit(1.0 / n), n), float(n))
    for level in ("s", "d", "v"):
        out = smoothed(others(votes[level]), out, PRIOR_VOTES)
    return out


def language_id(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per input row: page_id, host, declared, lang, posterior, prior_share (of the host, for that language)."""
    model = fitted(docs)
    own = checkpointed(evidence(pages, model))
    n = len(model.languages)
    if not n:
        return own.select("page_id", "host", "declared", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("double").alias("prior_share"))
    joined = join_hot(own, host_votes(own, n), ["host"], "pages").withColumn("prior", prior(F.col("own"), F.col("votes"), n))
    post = normal(F.zip_with("own", "prior", lambda e, p: e + F.log(p)))
    best = F.array_max(F.transform("post", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    names = F.array(*map(F.lit, model.languages))
    out = joined.withColumn("post", post).withColumn("best", best).withColumn("at", (F.lit(1) - F.col("best.i")).cast("int"))
    return out.select("page_id", "host", "declared", F.element_at(names, F.col("at")).alias("lang"), F.round("best.p", DIGITS).alias("posterior"), F.round(F.element_at("prior", F.col("at")), DIGITS).alias("prior_share"))
