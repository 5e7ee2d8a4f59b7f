"""What the search of neighbours reads."""

from pyspark.sql import functions as F

from quern.operators import knn


def test_texts_are_not_read_with_the_vectors(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], f"text {i}", i % 2) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, content string, kind int").write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    queries = corpus.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    seen = []
    before = knn.settled

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return before(df)

    knn.settled = noted
    try:
        found = knn.nearest(corpus, queries, 3)
    finally:
        knn.settled = before
    assert len(seen) == 1 and "content" not in seen[0] and "ReadSchema: struct<vec_id:bigint,embedding:array<double>,kind:int>" in seen[0]
    assert {r.content for r in found.where("rank = 1").collect()} == {f"text {i}" for i in range(4)}
    twice = corpus.unionByName(corpus.where("vec_id = 2").withColumn("content", F.lit("another")))
    assert sorted(r.content for r in knn.nearest(twice, queries.where("query_id = 2"), 2).collect()) == ["another", "text 2"]
