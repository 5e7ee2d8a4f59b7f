"""Requests as JSON bodies: parsed and checked in columns, answered in one batch, and replied to with a status.

A body is an object with ``question`` (a string of ``min_length`` characters at least) and, where the caller likes, ``user_id`` and ``session_id`` (strings or null); other
fields are ignored. Bodies are read as variants, so a field's own JSON type decides: a number is no string. Everything is a projection over the rows; only what is accepted is embedded and answered.

Defined cases: a null or malformed body (also one that names a field twice) is ``json_invalid``; an array, string, number or null is ``not_an_object``; a question of white space alone is accepted, as it has
a length; repeated query_ids are not told apart by :func:`replies`, so each row wants its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.answer import answer
from quern.settings import DEFAULTS, Settings
from quern.sources.tables import settled

MIN_QUESTION = 1
OPTIONAL = ("user_id", "session_id")
OK, REFUSED, FAILED = 200, 422, 500


def _problem(field: str, code: str) -> Column:
    return F.array(F.struct(F.lit(field).alias("field"), F.lit(code).alias("problem")))


def parsed_requests(bodies: DataFrame, min_length: int = MIN_QUESTION, max_length: int | None = None) -> DataFrame:
    """``bodies`` (with body) with errors, and question, user_id and session_id, which are null where there are errors.

    errors is an array of (field, problem), empty for an acceptable body; problems are ``json_invalid``, ``not_an_object``, ``missing``, ``not_a_string``, ``too_short`` and ``too_long``.
    """
    names = [c for c in bodies.columns if c not in ("question", *OPTIONAL, "errors")]
    fields = ("question", *OPTIONAL)
    # one projection after the other: a body is parsed once, and each field's type found once
    read = bodies.select(*names, F.try_parse_json("body").alias("_read"))
    parts = read.select(*names, "_read", *[F.try_variant_get("_read", f"$.{field}", "variant").alias(f"_{field}") for field in fields])
    kinds = parts.select(
        *names, F.col("_read").isNull().alias("_bad"), F.schema_of_variant("_read").startswith("OBJECT").alias("_object"),
        *[F.schema_of_variant(f"_{field}").alias(f"_kind_{field}") for field in fields], *[F.try_variant_get(f"_{field}", "$", "string").alias(f"_{field}") for field in fields],
    )
    size, none = F.length("_question"), F.array().cast("array<struct<field:string,problem:string>>")
    asked = F.when(F.col("_kind_question").isNull(), _problem("question", "missing")).when(F.col("_kind_question") != "STRING", _problem("question", "not_a_string")).when(size < min_length, _problem("question", "too_short"))
    if max_length is not None:
        asked = asked.when(size > max_length, _problem("question", "too_long"))
    others = [F.when(~F.col(f"_kind_{field}").isin("STRING", "VOID"), _problem(field, "not_a_string")).otherwise(none) for field in OPTIONAL]
    found = F.when(F.col("_bad"), _problem("body", "json_invalid")).when(~F.col("_object"), _problem("body", "not_an_object")).otherwise(F.concat(asked.otherwise(none), *others))
    judged = kinds.select(*names, found.alias("errors"), *[f"_{field}" for field in fields])
    return judged.select(*names, "errors", *[F.when(F.size("errors") == 0, F.col(f"_{field}")).alias(field) for field in fields])


def error_text(errors: Column) -> Column:
    """``field:problem`` of each error, joined by commas."""
    return F.array_join(F.transform(errors, lambda x: F.concat(x["field"], F.lit(":"), x["problem"])), ",")


def replies(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, status, body: of each parsed request its answer as JSON (200), its errors (422), or, where it has no answer, a failure (500)."""
    said = F.to_json(F.struct("success", "intent", "answer"))
    refused = F.to_json(F.struct(F.lit("invalid request").alias("error"), F.col("errors").alias("detail")))
    failed = F.to_json(F.struct(F.lit("not processed").alias("error")))
    status = F.when(F.size("errors") > 0, REFUSED).when(F.col("success").isNull(), FAILED).otherwise(OK)
    joined = requests.select("query_id", "errors").join(answers.select("query_id", "success", "intent", "answer"), "query_id", "left").withColumn("status", status)
    return joined.select("query_id", "status", F.when(F.col("status") == REFUSED, refused).when(F.col("status") == FAILED, failed).otherwise(said).alias("body"))


def served(corpus: DataFrame, bodies: DataFrame, embed: Callable[[DataFrame], DataFrame], settings: Settings = DEFAULTS, max_length: int | None = None, **options) -> DataFrame:
    """query_id, status, body of every row of ``bodies`` (query_id, body). ``embed`` adds query_vec to (query_id, question); ``options`` go to :func:`quern.plans.answer.answer`."""
    requests = settled(parsed_requests(bodies.select("query_id", "body"), max_length=max_length))
    asked = embed(requests.where(F.size("errors") == 0).select("query_id", "question"))
    return replies(requests, answer(corpus, asked, settings, **options))
