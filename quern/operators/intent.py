"""Intents: offline rules, routing, reply keys, and parsing of a model's answer.

The rules stand in for a language model and are not equivalent to one; pass a classifier of your own to
:mod:`quern.plans.answer`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import stripped
from quern.operators.dictionary import cleaned_words, keyword_array

INTENTS = ("disease", "scheme", "hybrid", "greeting", "out_of_scope")

# Words of the rule classifier, and the phrases of the greeting cascade in order.
DISEASE_WORDS = ("canker", "hlb", "greening", "tristeza", "scab", "melanose", "gummosis", "rot", "anthracnose", "psyllid", "mite", "aphid", "whitefly", "disease", "pest", "symptom", "treatment", "fungicide")
SCHEME_WORDS = ("scheme", "yojana", "subsidy", "grant", "loan", "pmksy", "nhm", "pmfby", "kisan", "credit", "insurance", "government", "benefit")
GREETINGS = ("hi", "hello", "hey", "namaste", "good morning", "how are you", "thank you", "thanks", "bye", "goodbye", "who are you", "what can you do", "help me")
CASCADE = (
    ("thanks", ("thank", "thanks", "dhanyavaad", "shukriya")),
    ("goodbye", ("bye", "goodbye", "alvida", "see you")),
    ("identity", ("who are you", "what are you", "your name", "about you")),
    ("help", ("help", "what can you do", "how to use", "guide")),
    ("wellbeing", ("how are you", "how're you", "kaise ho", "kaisa hai")),
)
#: Replies of no model: what an answer says where nothing is looked up or found.
REPLIES = {
    "thanks": "You are welcome. Ask about citrus diseases, treatments or farm support schemes at any time.",
    "goodbye": "Goodbye, and a good harvest.",
    "identity": "This service answers questions on citrus diseases and on government support for farmers.",
    "help": "Ask about symptoms and treatments, about subsidies and loans, or about both at once.",
    "wellbeing": "All is well here. What would you like to know about your crop?",
    "hello": "Hello. Ask about citrus diseases or about farm support schemes.",
    "out_of_scope": "That is outside citrus farming and farm support schemes.",
    "no_documents": "Nothing relevant was found. Try other words.",
    "ambiguous_query": "Please say more: which crop part, which symptom, or which scheme?",
    "disease": "Nothing was found on that disease or pest. Describe the symptoms or name the part of the plant.",
    "scheme": "Nothing was found on that scheme. Name the scheme or the kind of support.",
    "failed": "No answer could be generated. Please ask again.",
    "other": "Nothing was found. Add details of the disease or of the support that is looked for.",
}


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(cleaned_words(text), keyword_array(words))) > 0


def rule_intent(question: Column, disease: tuple[str, ...] = DISEASE_WORDS, scheme: tuple[str, ...] = SCHEME_WORDS) -> Column:
    """A greeting phrase of at most three words; else by which of the word lists the question has words of."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    greeting = plain.isin(list(GREETINGS)) & (F.size(F.split(plain, " ")) <= 3)
    d, s = has_word(question, disease), has_word(question, scheme)
    return F.when(greeting, "greeting").when(d & s, "hybrid").when(d, "disease").when(s, "scheme").otherwise("out_of_scope")


def rule_confidence(intent: Column) -> Column:
    return F.when(intent == "out_of_scope", 0.5).otherwise(0.8)


def route(intent: Column) -> Column:
    """The branch an intent takes; anything unknown is looked up in both collections."""
    return F.when(intent.isin("greeting", "out_of_scope", "disease", "scheme"), intent).otherwise("hybrid")


def target_collections(branch: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(branch == "hybrid", F.array(F.lit("disease"), F.lit("scheme"))).when(branch.isin("disease", "scheme"), F.array(branch)).otherwise(none)


def greeting_key(question: Column) -> Column:
    """Key of the reply to a greeting: the first group of phrases that the question contains one of."""
    q = stripped(F.lower(question))
    out = F.lit("hello")
    for key, phrases in reversed(CASCADE):
        out = F.when(q.rlike("|".join(phrases)), key).otherwise(out)
    return out


def reply(key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in REPLIES.items() for x in kv]), key)


def no_result_key(intent: Column) -> Column:
    return F.when(intent.isin("disease", "scheme"), intent).otherwise("other")


def parse_label(raw: Column) -> Column:
    """struct(intent, confidence, reason) of a model's answer; the last line of each kind counts, an unknown label or a bad number does not."""
    lines = F.transform(F.split(F.trim(raw), "\n"), lambda x: F.trim(x))
    after = lambda kind: F.transform(F.filter(lines, lambda x: F.upper(x).startswith(kind)), lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", "")))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    intents = F.filter(F.transform(after("INTENT:"), F.lower), lambda x: x.isin(list(INTENTS)))
    stated = last(after("CONFIDENCE:"))
    number = F.when(stated.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), stated.cast("double"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.5))))
    return F.struct(F.coalesce(last(intents), F.lit("unknown")).alias("intent"), confidence.alias("confidence"), F.coalesce(last(after("REASON:")), F.lit("")).alias("reason"))


def labelled(raw: Column) -> Column:
    """struct(intent, confidence, reason) of a classifier's raw answer; null, where it failed, is unknown at confidence 0."""
    none = F.struct(F.lit("unknown").alias("intent"), F.lit(0.0).alias("confidence"), F.lit("classification failed").alias("reason"))
    return F.when(raw.isNull(), none).otherwise(parse_label(raw))


def label_to_intent(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.isin(*INTENTS), low).otherwise("unknown")


def gate(confidence: Column, n_docs: Column) -> Column:
    """What an answer does: ask back, say that nothing was found, or answer."""
    return F.when((confidence < 0.4) & (n_docs == 0), "ambiguous_query").when(n_docs == 0, "no_documents").otherwise("answer")
