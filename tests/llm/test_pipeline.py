import hashlib
import re

import public_tokenizers
import tiktoken
from test_byte_bpe import RANKS
from test_decontaminate import WORD, split
from test_simhash import brute_components, brute_print

import corpus_pipeline as cp
from quern.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in documents.collect()}
    passed = {r.doc_id for r in quality.quality(documents, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    rows = {i: t for i, t in rows.items() if i in passed}
    component = brute_components({i: brute_print(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if component[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = split(r.text)
        windows |= {tuple(ws[i : i + 10]) for i in range(max(len(ws) - 9, 1) if ws else 0)}
    kept = {}
    for i, t in rows.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        while True:
            ms = list(WORD.finditer(low))
            hit = sorted({j for k in {len(w) for w in windows} for s in range(len(ms) - k + 1) if tuple(m[0] for m in ms[s : s + k]) in windows for j in range(s, s + k)})
            if not hit:
                break
            cuts = []
            for j in hit:
                if cuts and cuts[-1][1] == j:
                    cuts[-1][1] = j + 1
                else:
                    cuts.append([j, j + 1])
            for a, b in reversed(cuts):
                s, e = ms[a].start(), ms[b - 1].end()
                t, low = t[:s] + "\n" + t[e:], low[:s] + "\n" + low[e:]
        if ms or t == rows[i]:
            kept[i] = re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1<SECRET>"', t)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = {i: coder.encode_ordinary(t) for i, t in kept.items()}
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert {i: r.ids for i, r in got.items()} == want
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}


def test_stages_return_documents(spark, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = docs([(1, None), (2, ""), (2, ""), (3, "plain words stand here as they are"), (None, "other words stand there")])
    for name, stage in cp.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns, name
        frame = spark.createDataFrame(frame.collect(), frame.schema)
    assert cp.STAGES[-1][1](spark, frame, SF).count() == frame.count()
    for _, stage in cp.STAGES:
        assert stage(spark, docs([]), SF).collect() == []


def test_stages_keep_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    extra = {c: F.lit(c) for c in ("kept_text", "kept_text_id", "score", "fp", "key", "root", "label", "ids", "piece")}
    frame = docs([(1, "plain words stand here as they are"), (2, "plain words stand here as they are"), (None, None), (3, 'token = "0123456789abcdef0123456789abcdef01234567"')]).withColumns(extra)
    columns = frame.columns
    for name, stage in cp.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns, name
        frame = spark.createDataFrame(frame.collect(), frame.schema)
    rows = {r.doc_id: r for r in frame.collect()}
    assert set(rows) == {1, None, 3} and "<SECRET>" in rows[3].text and all(r.score == "score" and r.fp == "fp" for r in rows.values())
