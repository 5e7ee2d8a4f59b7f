import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking
from quern.operators.chunking import split_recursively
from quern.plans.oracles import recursive_chunks_sql


@pytest.mark.parametrize("size,overlap", [(10, 3), (20, 0), (25, 20), (7, 6), (1500, 300)])
def test_splitter_and_its_sql_agree_on_every_separator(size, overlap):
    rng = random.Random(size)
    marks = ["a", "bb", "é", "\n", "\n\n", ". ", " ", "c" * 25]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 90)))) for i in range(200)] + [(900, "x" * 4000), (901, " ".join(["word"] * 900)), (902, " \n "), (903, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted((d, i, len(c), hashlib.md5(c.encode()).hexdigest()) for d, t in rows if t for i, c in enumerate(split_recursively(t, size, overlap)))
    assert sorted(con.execute(recursive_chunks_sql(size, overlap)).fetchall()) == want


def test_recursive_chunks_come_in_small_batches(spark):
    text = "One. Two.\n\n" + "three " * 500
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(chunking.recursive_chunks(F.col("t"), 100, 10).alias("c"))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()  # its batches are 10,000 rows of any length
    assert [r.c for r in got.collect()] == [chunking.split_recursively(text, 100, 10), [], []]
