import json

from pyspark.sql import functions as F

from quern.operators import chunking
from quern.plans import requests


def errors(spark, *bodies, **options):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "query_id long, body string")
    return [(r.errors_text, r.question, r.user_id) for r in requests.parsed_requests(rows, **options).withColumn("errors_text", requests.error_text(F.col("errors"))).orderBy("query_id").collect()]


def test_bodies_of_every_kind(spark):
    good = [('{"question": "a"}', "a", None), ('{"question": " ", "user_id": "u", "session_id": null, "x": [1, {"question": 2}]}', " ", "u"), ('{"question": "\\u00e9\\n\\"", "user_id": null}', 'é\n"', None)]
    for (body, question, user), found in zip(good, errors(spark, *(b for b, _, _ in good))):
        assert found == ("", question, user), body
    bad = {
        None: "body:json_invalid",
        "": "body:json_invalid",
        '{"question": "a"': "body:json_invalid",
        '{"question": "a", "question": "b"}': "body:json_invalid",
        "null": "body:not_an_object",
        "[]": "body:not_an_object",
        '"question"': "body:not_an_object",
        "{}": "question:missing",
        '{"question": null}': "question:not_a_string",
        '{"question": ["a"]}': "question:not_a_string",
        '{"question": ""}': "question:too_short",
        '{"question": 1.5, "user_id": false, "session_id": {}}': "question:not_a_string,user_id:not_a_string,session_id:not_a_string",
        '{"question": "a", "session_id": 3}': "session_id:not_a_string",
    }
    for body, found in zip(bad, errors(spark, *bad)):
        assert found == (bad[body], None, None), body
    assert [e[0] for e in errors(spark, '{"question": "ééé"}', '{"question": "éééé"}', '{"question": "é"}', min_length=2, max_length=3)] == ["", "question:too_long", "question:too_short"]
    assert errors(spark) == []


def test_long_bodies_and_clashing_columns(spark):
    long = "word " * 400_000
    rows = spark.createDataFrame([(json.dumps({"question": long}), "x", "y")], "body string, question string, errors string")
    got = requests.parsed_requests(rows).collect()
    assert [(r.question, r.errors) for r in got] == [(long, [])]


def test_replies_have_a_status(spark):
    bodies = spark.createDataFrame([(1, '{"question": "one"}'), (2, "{}"), (3, '{"question": "three"}')], "query_id long, body string")
    answers = spark.createDataFrame([(1, True, "disease", 'say "so"')], "query_id long, success boolean, intent string, answer string")
    got = {r.query_id: (r.status, json.loads(r.body)) for r in requests.replies(requests.parsed_requests(bodies), answers).collect()}
    assert got == {
        1: (200, {"success": True, "intent": "disease", "answer": 'say "so"'}),
        2: (422, {"error": "invalid request", "detail": [{"field": "question", "problem": "missing"}]}),
        3: (500, {"error": "not processed"}),
    }


def test_chunks_of_one_large_file_are_numbered_over_all_ranges(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 < 2, "big").alias("source_file"), (F.col("id") % 1500).cast("int").alias("page"), F.format_string("%05d %s", "id", F.repeat(F.lit("ab "), (F.col("id") % 9).cast("int"))).alias("content"))
    rows = rows.unionByName(spark.createDataFrame([("a", None, None), ("a", 3, ""), (None, None, "one two three")], "source_file string, page int, content string"))
    got = chunking.chunked_pages(rows.repartition(7), "disease", 10, 2, chunks=chunking.window_chunks, clean=False).collect()
    want = []
    for name in ("big", None):
        n = 0
        for page, text in sorted((r.page or 0, r.content) for r in rows.where(F.col("source_file").eqNullSafe(F.lit(name))).collect()):
            for at in range(max(1, -(-(len(text) - 2) // 8))):
                want.append((f"{name or 'unknown'}_page{page}_chunk{n}", n, text[at * 8 : at * 8 + 10]))
                n += 1
    assert sorted((r.chunk_id, r.chunk_index, r.content) for r in got) == sorted(want) and {r.collection for r in got} == {"disease"}
