import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language_id as li


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents")]


def brute(rows, model):
    """The fusion in plain Python over (page_id, url, html)."""
    n, own, keys = len(model.languages), [], []
    for _, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.sub(r":\d*$", "", re.match(r"[^/?#]*", rest)[0].lower())
        seg = re.search(r"/([a-z]{2,3})(?:/|$)", re.match(r"[^/?#]*([^?#]*)", rest)[1])
        name = re.search(r'<html lang="(\w+)"', html or "")
        log = li.TEMPER * model.likelihood(li.visible((html or "").encode()))
        log = log + li.named(model.languages, name and name[1], li.TRUST_DECLARED) + li.named(model.languages, seg and seg[1], li.TRUST_ADDRESS)
        own.append(log - log.max())
        keys.append((host, ".".join(host.split(".")[-2:]), host.split(".")[-1]))
    votes = [np.exp(o) / np.exp(o).sum() for o in own]
    def level(at, key, above, me):
        got = np.sum([np.zeros(n)] + [v for i, (v, k) in enumerate(zip(votes, keys)) if k[at] == key and i != me], axis=0)
        return (got + li.PRIOR_VOTES * above) / (got.sum() + li.PRIOR_VOTES)

    out = {}
    for me, ((page, _, _), o, (host, domain, suffix)) in enumerate(zip(rows, own, keys)):
        total = np.sum(votes, axis=0) - votes[me]
        top = (total + 1) / (total.sum() + n)
        prior = level(0, host, level(1, domain, level(2, suffix, top, me), me), me)
        post = np.exp(o) * prior
        out[page] = (model.languages[int(np.argmax(post))], post.max() / post.sum())
    return out


def test_against_brute_force(tables):
    pages, docs = tables
    want = brute([(r.page_id, r.url, r.html) for r in pages.collect()], li.fitted(docs))
    got = {r.page_id: (r.lang, r.posterior) for r in li.language_id(pages, docs).collect()}
    assert {p: x[0] for p, x in got.items()} == {p: x[0] for p, x in want.items()}
    assert np.allclose([got[p][1] for p in want], [want[p][1] for p in want], atol=2e-6)
    right = [r.declared == r.lang for r in li.language_id(pages, docs).collect()]
    assert sum(right) >= 0.98 * len(right)


def test_text_and_host_without_names(tables):
    pages, docs = tables
    true = F.regexp_extract("html", '<html lang="(..)"', 1)
    bare = pages.select("page_id", true.alias("true"), F.regexp_replace("html", ' lang="..?"', "").alias("html"), F.regexp_replace("url", "/(en|de|fr|es)/", "/x1/").alias("url"))
    got = li.language_id(bare, docs).join(bare.select("page_id", "true"), "page_id").collect()
    assert all(r.declared is None for r in got) and sum(r.lang == r.true for r in got) >= 0.97 * len(got)


def test_host_prior_decides_where_text_is_silent(spark, tables):
    _, docs = tables
    rows = [(i, "http://a.example.fr/x", '<html lang="fr">') for i in range(30)] + [(99, "http://a.example.fr/y", "")]
    got = {r.page_id: r.lang for r in li.language_id(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[99] == "fr"


def test_edges(spark, tables):
    _, docs = tables
    rows = [(1, None, None), (1, None, None), (None, "http://", "<"), (2, "http://H.COM:80/DE/", "<p>der die das und ist nicht</p>" * 20_000), (3, "x", '<html lang="zz">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "own", "prior", "lang", "domain")})
    got = li.language_id(pages, docs).collect()
    assert len(got) == 5 and {r.lang for r in got if r.page_id == 2} == {"de"} and all(0 < r.posterior <= 1 for r in got)
    assert li.language_id(pages.limit(0), docs).collect() == []
    assert {r.lang for r in li.language_id(pages, docs.limit(0)).collect()} == {None}


def test_rare_languages_are_possible_answers(spark):
    names = [a + b for a in "abcdefgh" for b in "pqrstuvwx"][:70]
    docs = spark.createDataFrame([(n, f"common words number {n}", "en") for n in range(300)] + [(1000 + n, f"{x}{x} {x} of {x}", x) for n, x in enumerate(names)], "doc_id long, text string, lang string")
    assert li.fitted(docs, rows=20).languages == sorted([*names, "en"])
    pages = spark.createDataFrame([(n, f"https://{x}.example.{x}/{x}/a", f'<html lang="{x}"><p>{x}{x} {x} of {x}</p></html>') for n, x in enumerate(names)], "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in li.language_id(pages, docs).collect()} == dict(enumerate(names))


def test_a_page_does_not_vote_for_itself(spark, tables):
    _, docs = tables
    rows = [(1, "http://only.example.xx/a", '<html lang="fr">')]
    (row,) = li.language_id(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert row.lang == "fr" and row.prior_share == round(1 / 4, 6)


def test_hot_hosts_join_alike(tables, monkeypatch):
    pages, docs = tables
    rows = lambda: sorted(map(str, li.language_id(pages, docs).collect()))
    want = rows()
    monkeypatch.setattr("quern.llm.common.HOT_LEAST", 5)
    assert rows() == want
