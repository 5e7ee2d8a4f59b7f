"""Keyword dictionaries: exact and prefix matches of cleaned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import small

# The two keyword lists.
DISEASE_KEYWORDS = (
    "disease", "pest", "symptom", "treatment", "infection", "control", "prevention", "management", "spray", "application", "damage", "canker", "greening", "hlb", "tristeza", "scab",
    "melanose", "gummosis", "root rot", "foot rot", "phytophthora", "anthracnose", "sooty mold", "citrus variegated chlorosis", "cvc", "exocortis", "psyllid", "whitefly", "leafminer",
    "mite", "aphid", "scale", "thrips", "fruit fly", "borer", "nematode", "mealybug", "spider mite", "asian citrus psyllid", "acp", "citrus leaf miner", "rust mite", "yellowing",
    "lesion", "rot", "wilting", "dieback", "chlorosis", "necrosis", "leaf curl", "fruit drop", "gall", "spots", "blotch", "fungicide", "insecticide", "pesticide", "copper", "neem",
    "bordeaux", "carbendazim", "imidacloprid", "thiamethoxam", "biological control", "ipm", "integrated pest management",
)
SCHEME_KEYWORDS = (
    "scheme", "yojana", "mission", "programme", "program", "pmksy", "nhm", "rkvy", "nfsm", "pkvy", "pmfby", "kcc", "pradhan mantri", "pm kisan", "pm-kisan", "kisan credit",
    "national horticulture", "rashtriya krishi", "paramparagat", "soil health card", "shc", "nabard", "apeda", "subsidy", "grant", "loan", "credit", "insurance", "assistance",
    "financial", "benefit", "support", "compensation", "relief", "interest", "subvention", "reimbursement", "government", "central", "state", "district", "eligible", "eligibility",
    "application", "registration", "enrollment", "portal", "online", "office", "officer", "department", "farmer", "kisan", "agriculture", "horticulture", "irrigation", "drip",
    "micro irrigation", "sprinkler", "organic", "certification",
)


def cleaned_words(text: Column) -> Column:
    """Lowered words at white space, stripped of all but letters and numbers, empty ones left out."""
    plain = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(plain, lambda w: w != ""))


def keyword_array(keywords: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(k.lower()) for k in dict.fromkeys(keywords)]) if keywords else F.array().cast("array<string>")


def exact_matches(text: Column, keywords: tuple[str, ...]) -> Column:
    return F.array_intersect(cleaned_words(text), keyword_array(keywords))


def prefix_matches(text: Column, keywords: tuple[str, ...]) -> Column:
    """Keywords that some cleaned word of the text starts with; one of several words or with a hyphen never is.

    The cleaned words are joined with a space before each, once a text, and searched for " keyword": a scan of bytes a keyword.
    """
    single = tuple(k for k in keywords if k.isalnum())
    spaced = F.concat(F.lit(" "), F.array_join(cleaned_words(text), " "))
    found = F.transform(F.array(spaced), lambda s: F.filter(keyword_array(single), lambda k: F.contains(s, F.concat(F.lit(" "), k))))
    return F.when(text.isNotNull(), F.flatten(found))


def phrase_matches(text: Column, keywords: tuple[str, ...]) -> Column:
    """Keywords, of several words too, that stand in the text as whole words in order."""
    padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))
    return F.filter(keyword_array(keywords), lambda k: F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(k, "[^\\p{L}\\p{N}]+", " "), F.lit(" "))))


def prefix_matches_joined(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """doc, category, keyword for dictionaries that are too large for a literal: an equi-join on each word's prefixes.

    Prefixes are made of the lengths that keywords have, and meet the keywords where the words are if these are few enough for a broadcast; only then are rows made distinct.
    """
    wanted = keywords.select("category", F.lower("keyword").alias("keyword")).distinct()
    lengths = F.broadcast(wanted.agg(F.collect_set(F.length("keyword")).alias("lengths")))  # one row
    words = docs.select("doc", F.explode(cleaned_words(F.col("content"))).alias("word")).join(lengths, F.lit(True))
    prefixes = words.select("doc", F.explode(F.transform(F.filter("lengths", lambda n: (n > 0) & (n <= F.length("word"))), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("keyword"))
    return prefixes.join(small(wanted), "keyword").select("doc", "category", "keyword").distinct()


def keyword_overlap(query: Column, content: Column, keywords: tuple[str, ...]) -> Column:
    """How many words of the query are keywords and words of the content too (both arrays of words)."""
    return F.size(F.array_intersect(F.array_intersect(query, content), keyword_array(keywords)))


def keyword_table(spark: SparkSession, lists: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """category, keyword, ord; a keyword stands once a category."""
    lists = lists or {"disease": DISEASE_KEYWORDS, "scheme": SCHEME_KEYWORDS}
    rows = [(c, k.lower(), n) for c, ks in lists.items() for n, k in enumerate(dict.fromkeys(ks))]
    return spark.createDataFrame(rows, "category string, keyword string, ord int")


def starts_with(keywords: DataFrame, prefix: str) -> DataFrame:
    return keywords.where(F.col("keyword").startswith(prefix.lower()))
