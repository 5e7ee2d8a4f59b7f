import re

from quern.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in ls.BASE_PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(frame, rows):
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in frame.collect())
    assert got == sorted((str(i), n, b, str(f), str(x), lab) for i, t in rows for n, b, f, x, lab in [brute(t)])


def test_base_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(ls.license_scan(docs), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_edges(docs):
    rows = [
        (1, None), (2, ""), (3, "MIT License"), (3, "MIT License"), (4, "mit\nLICENSE. Apache-license cc,by CC BY"), (5, "the mit. The license"),
        (6, "Éa mit licenseé"), (None, "GNU General Public License"), (7, "cc by " * 5000), (8, "cc by nc"), (3, "no words of any"),
    ]
    check(ls.license_scan(docs(rows)), rows)
    check(ls.license_scan(docs([])), [])


def test_extra_columns(docs):
    from pyspark.sql import functions as F

    wide = docs([(1, "mit license")]).withColumns({c: F.lit("x") for c in ("n_words", "labels", "gram", "template", "copies")})
    assert [r.labels for r in ls.license_scan(wide).collect()] == ["mit"]


def test_notice_with_words_put_in_and_left_out(docs):
    text = ls.NOTICES["apache"].replace("you may not use", "you really may not ever use").replace("a copy of", "copies of")
    (row,) = ls.license_scan(docs([(1, "start " + text + " end")])).collect()
    assert set(row.labels.split(",")) == {"apache"} and 0.6 <= row.score <= 1.0
    (row,) = ls.license_scan(docs([(1, " ".join(ls.split_words(ls.NOTICES["mit"])[::-1]))])).collect()
    assert row.labels == "" and row.score == 0.0
