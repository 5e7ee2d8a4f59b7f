"""Question answering as one plan over a batch of questions: classify, route, retrieve, fuse, rerank, answer."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import collected_context, context_block, prompt, query_hash, system_prompt
from quern.operators import fusion, intent
from quern.operators.hybrid import smart_search
from quern.plans.stage_log import StageLog, staged
from quern.settings import DEFAULTS, Settings
from quern.sources.tables import settled


def retrieve(corpus: DataFrame, questions: DataFrame, settings: Settings = DEFAULTS, metric: str = "l2sq") -> DataFrame:
    """query_id, intent, question, collection, rank, content, source, page, score: each routed question's documents, first of each document key.

    ``corpus`` has vec_id, embedding, content, source, page and collection (disease or scheme); ``questions`` query_id, query_vec, question, intent. A
    collection is searched for the questions that go to it; the two searches do not depend on each other.
    """
    asked = questions.withColumn("target", F.explode(intent.target_collections(intent.route(F.col("intent")))))

    def one(kind: str) -> DataFrame:
        here = asked.where(F.col("target") == kind).select("query_id", "query_vec", "question")
        return smart_search(corpus.where(F.col("collection") == kind), here, settings.top_k, settings, metric)

    found = reduce(DataFrame.unionByName, [one(kind) for kind in ("disease", "scheme")])
    found = found.select("query_id", "collection", "rank", "content", "source", "page", "score")
    kept = fusion.dedup_documents(found, ["collection", "rank"], ["query_id"])
    along = Window.partitionBy("query_id", "collection").orderBy("rank")
    kept = kept.withColumn("rank", F.row_number().over(along))
    return kept.join(questions.select("query_id", "intent", "question"), "query_id")


def ranked(found: DataFrame, settings: Settings = DEFAULTS, **keywords) -> DataFrame:
    """query_id, final_rank, edge_case and the document's columns: fused (hybrid questions), reranked, deduplicated, over the threshold; else the first few."""
    k = settings.rerank_top_k
    ordered = settled(found.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("collection", "rank"))))
    if not settings.enable_reranking:
        unique = fusion.dedup_prefix(ordered, ["ord"], ["query_id"])
        last = unique.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ord")))
        return last.where(F.col("final_rank") <= k).withColumn("edge_case", F.lit(None).cast("string")).withColumn("rerank_score", F.lit(None).cast("double"))
    hybrid = ordered.where("intent = 'hybrid'")
    fused = fusion.reciprocal_rank_fusion(hybrid, 2 * k).withColumnRenamed("rrf_rank", "ord").drop("rrf_score").join(hybrid.select("query_id", "question", "intent").distinct(), "query_id")
    plain = ordered.where("intent <> 'hybrid'")
    columns = ["query_id", "intent", "question", "collection", "content", "source", "page", "score", "ord"]
    both = fusion.rerank(fused.select(*columns), 2 * k, "ord", settings, **keywords).unionByName(fusion.rerank(plain.select(*columns), k, "ord", settings, **keywords))
    kept = fusion.over_threshold(fusion.dedup_prefix(both, ["rerank_rank"], ["query_id"]), settings.min_relevance)
    kept = kept.withColumn("rerank_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rerank_rank")))
    return fusion.with_fallback(kept, ordered.select(*columns), ["ord"], k)


#: A generator takes a system prompt and a prompt to a text, or to null where it fails.
Generator = Callable[[Column, Column], Column]


def generated(rows: DataFrame, generator: Generator | None = None) -> DataFrame:
    """``rows`` (question, intent, n, context, sources) with answer, citations (an array of names) and failed.

    Without documents the answer is the reply of the intent. With them it is the generator's text for the intent's prompt, the context and the question; without a
    generator it is the context itself, which is extractive and not equivalent to a model's text.
    """
    some = F.col("n") > 0
    if generator is None:
        out = rows.withColumn("_text", F.when(some, F.col("context")))
    else:
        out = written(rows, some, lambda: generator(system_prompt(F.col("intent")), prompt(F.col("context"), F.col("question"))))
    out = out.withColumn("failed", some & F.col("_text").isNull())
    said = F.when(~some, intent.reply(intent.no_result_key(F.col("intent")))).otherwise(F.coalesce("_text", intent.reply(F.lit("failed"))))
    cited = F.when(some & ~F.col("failed"), F.filter(F.split(F.coalesce("sources", F.lit("")), "; "), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"answer": said, "citations": cited}).drop("_text")


def written(rows: DataFrame, which: Column, text: Callable[[], Column]) -> DataFrame:
    """``rows`` with _text, which a generator is asked for in some rows alone: a Python function in a CASE would be called for all."""
    rows = settled(rows)
    return rows.where(which).withColumn("_text", text()).unionByName(rows.where(~F.coalesce(which, F.lit(False))).withColumn("_text", F.lit(None).cast("string")))


def answer(
    corpus: DataFrame, questions: DataFrame, settings: Settings = DEFAULTS, classifier: Callable[[Column], Column] = intent.rule_intent, metric: str = "l2sq",
    labels: Callable[[Column], Column] | None = None, generator: Generator | None = None, log: StageLog | None = None, **keywords,
) -> DataFrame:
    """query_id, success, intent, outcome, n_sources, sources, answer: one row a question.

    ``classifier`` maps a question to an intent. ``labels`` maps it to a model's raw answer instead (null where the model failed), whose intent and
    confidence count. ``generator`` writes the answers to what was found, and asks back where a question is unclear; a question it fails on has success false and the outcome failed.
    Without it the answer is extractive: the numbered sources themselves. ``log`` takes down each stage: classify, retrieve, rank, answer.
    """
    asked = staged(log, "classify", questions, lambda rows: _classified(rows, classifier, labels))
    found = staged(log, "retrieve", asked, lambda rows: retrieve(corpus, rows, settings, metric))
    docs = staged(log, "rank", found, lambda rows: ranked(rows, settings, **keywords))
    return staged(log, "answer", docs, lambda rows: _answered(asked, rows, generator))


def _classified(questions: DataFrame, classifier: Callable[[Column], Column], labels: Callable[[Column], Column] | None) -> DataFrame:
    """``questions`` with intent and confidence."""
    if labels is None:
        return questions.withColumn("intent", classifier(F.col("question"))).withColumn("confidence", intent.rule_confidence(F.col("intent")))
    return settled(questions.withColumn("_label", intent.labelled(labels(F.col("question")))).withColumns({"intent": F.col("_label.intent"), "confidence": F.col("_label.confidence")}).drop("_label"))


def _answered(asked: DataFrame, docs: DataFrame, generator: Generator | None) -> DataFrame:
    """One row a question, from its ranked documents."""
    block = context_block(F.col("final_rank"), F.col("source"), F.col("page"), F.col("content"))
    name = F.concat(F.coalesce("source", F.lit("Unknown")), F.lit(":"), F.coalesce(F.col("page").cast("string"), F.lit("N/A")))
    gathered = docs.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("edge_case").alias("edge_case"), collected_context(F.col("final_rank"), block).alias("context"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("final_rank").alias("r"), name.alias("s")))), lambda x: x["s"]), "; ").alias("sources"),
    )
    rows = asked.select("query_id", "question", "intent", "confidence").join(gathered, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = generated(rows, generator)
    looked_up = intent.gate(F.col("confidence"), F.col("n"))
    outcome = F.when(F.col("intent") == "greeting", F.concat(F.lit("greeting:"), intent.greeting_key(F.col("question")))).when(F.col("intent") == "out_of_scope", "out_of_scope").when(F.col("failed"), "failed").otherwise(looked_up)
    rows = rows.withColumn("outcome", outcome).withColumn("_text", F.lit(None).cast("string"))
    outcome = F.col("outcome")
    if generator is not None:
        rows = written(rows.drop("_text"), outcome == "ambiguous_query", lambda: generator(system_prompt(F.lit("ambiguous")), F.col("question")))
    asked_back = F.coalesce("_text", intent.reply(outcome))
    said = F.when(F.col("intent") == "greeting", intent.reply(intent.greeting_key(F.col("question")))).when(outcome.isin("answer", "failed"), F.col("answer")).when(outcome == "ambiguous_query", asked_back).otherwise(intent.reply(outcome))
    return rows.select(
        "query_id", (~F.col("failed")).alias("success"), "intent", "outcome", F.col("n").alias("n_sources"), F.coalesce("sources", F.lit("")).alias("sources"), said.alias("answer")
    )


def answer_cached(corpus: DataFrame, questions: DataFrame, cache: DataFrame, now: datetime | None = None, settings: Settings = DEFAULTS, **options) -> tuple[DataFrame, DataFrame]:
    """(answers with was_cached, the cache after the batch); questions of one hash are answered once.

    ``cache`` has query_hash, success, intent, outcome, n_sources, sources, answer, stored_at, used_at (without the last two, all were stored now). An entry lives
    ``response_ttl_seconds`` from when it was stored, however often it is used; failed answers are not stored. Of the living the ``response_cache_size`` used last stay, of those used at once the
    smaller hashes.
    """
    now = now or datetime.now()
    hashed = questions.withColumn("query_hash", query_hash(F.col("question")))
    columns = ["success", "intent", "outcome", "n_sources", "sources", "answer"]
    at = F.lit(now).cast("timestamp")
    cache = cache.withColumns({c: at for c in ("stored_at", "used_at") if c not in cache.columns})
    alive = cache.where(F.col("stored_at") > F.lit(now - timedelta(seconds=settings.response_ttl_seconds)).cast("timestamp"))
    once = hashed.join(alive.select("query_hash"), "query_hash", "left_anti")
    once = once.withColumn("_at", F.row_number().over(Window.partitionBy("query_hash").orderBy("query_id"))).where("_at = 1")
    fresh = answer(corpus, once.select("query_id", "query_vec", "question"), settings, **options).join(once.select("query_id", "query_hash"), "query_id").select("query_hash", *columns)
    fresh = fresh.withColumns({"stored_at": at, "used_at": at, "was_cached": F.lit(False)})
    known = settled(alive.select("query_hash", *columns, "stored_at", "used_at", F.lit(True).alias("was_cached")).unionByName(fresh))
    used = known.join(hashed.select("query_hash").distinct().withColumn("_used", F.lit(True)), "query_hash", "left")
    kept = used.where("success").withColumn("used_at", F.when(F.col("_used"), at).otherwise(F.col("used_at"))).orderBy(F.desc("used_at"), "query_hash").limit(settings.response_cache_size)
    return hashed.select("query_id", "query_hash").join(known.drop("stored_at", "used_at"), "query_hash").drop("query_hash"), kept.drop("was_cached", "_used")


def as_json(answers: DataFrame) -> DataFrame:
    """query_id, body: the response as JSON."""
    return answers.select("query_id", F.to_json(F.struct("success", "intent", "answer")).alias("body"))
