"""Cases that every operator over documents has a defined result for: columns of clashing names, and a text of over 1 MB."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import byte_bpe, decontaminate, license_scan, quality, secret_scan, simhash
from quern.llm.common import table

SF = "/root/testdata/sf0.001"
#: Names that operators use on the way.
CLASHING = "doc alt at n h words gram span key item_id items label quality score predicted fingerprint component_id bits piece ids labels path n_words n_hit hit held_out token _doc _at".split()


def operators(spark):
    labels, items = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    return {
        "license": license_scan.license_scan,
        "bpe": lambda docs: byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        "simhash": simhash.near_duplicates,
        "secrets": secret_scan.secret_scan,
        "quality": lambda docs: quality.quality(docs, labels),
        "contamination": lambda docs: decontaminate.contamination(docs, items),
    }


def rows(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("name", ["license", "bpe", "simhash", "secrets", "quality", "contamination"])
def test_clashing_columns_change_nothing(spark, name):
    docs, run = table(spark, SF, "documents"), operators(spark)[name]
    want = rows(run(docs))
    assert rows(run(docs.withColumns({c: F.lit("x") for c in CLASHING if c not in docs.columns}))) == want


def test_text_of_over_a_megabyte(spark, docs):
    long = " ".join(f"word{i % 977} stone" for i in range(120_000))
    frame, run = docs([(1, long), (2, "Released under the MIT License."), (5, long)]), operators(spark)
    found = {r.doc_id: r for r in run["license"](frame).collect()}
    assert (found[1].n_words, found[1].n_base, found[2].base_labels) == (240_000, 0, "mit")
    hits = {r.doc_id: r.n_words for r in run["contamination"](frame).collect()}
    assert hits == {1: 240_000, 2: 5, 5: 240_000}
    scores = {r.doc_id: r.score for r in quality.quality(frame, spark.createDataFrame([(2, 1), (5, 0)], "doc_id long, quality int")).collect()}
    assert set(scores) == {1, 2, 5} and all(0 <= x <= 1 for x in scores.values()) and scores[1] == scores[5]
