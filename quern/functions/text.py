"""Text functions over columns. Word characters are Unicode letters, numbers and the underscore in every one of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: White space of any script, as a class that Java's and RE2's expressions read alike (their \s is ASCII only).
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(text: Column) -> Column:
    """Without white space at both ends; F.trim takes U+0020 alone."""
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def spaced(text: Column) -> Column:
    """Stripped, and every run of white space one space."""
    return F.trim(F.regexp_replace(text, rf"{WHITE}+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def clean_text(text: Column) -> Column:
    """White space collapsed, then all but words, spaces and ``.,!?-`` dropped, then trimmed."""
    return F.trim(F.regexp_replace(spaced(text), r"[^\p{L}\p{N}_\s.,!?-]", ""))


def preprocess_text(text: Column) -> Column:
    """A page's text: runs of line breaks and spaces shortened, lines of digits only emptied, then cleaned."""
    steps = [(r"\n{3,}", "\n\n"), (r" {2,}", " "), (r"(?m)^\s*\d+\s*$", "")]
    return F.trim(clean_text(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)))


def truncate_text(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut back to the last space, with dots; a shorter text as it is."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*\z", ""), F.lit("...")))


def extract_keywords(text: Column, most: int = 10) -> Column:
    """The first distinct lower-cased words at white space, in order of appearance."""
    words = F.filter(F.split(F.lower(text), rf"{WHITE}+"), lambda w: w != "")
    return F.slice(F.array_distinct(words), 1, most)


def cache_key(text: Column) -> Column:
    """Key of a text in the embedding cache: stripped and lowered; its MD5 if it is longer than 100 characters."""
    plain = F.lower(stripped(text))
    return F.when(F.length(plain) > 100, F.md5(plain)).otherwise(plain)


def query_hash(text: Column) -> Column:
    return F.md5(spaced(F.lower(text)))


def content_hash(text: Column, prefix: int = 200) -> Column:
    """MD5 of the first ``prefix`` characters of the lowered text with white space collapsed."""
    return F.md5(F.substring(spaced(F.lower(text)), 1, prefix))


def document_key(text: Column, source: Column, page: Column) -> Column:
    """source, page and 8 digits of the content hash; the whole hash where source or page is missing."""
    hashed = content_hash(text)
    known = source.isNotNull() & (source != "") & page.isNotNull()
    return F.when(known, F.concat(source, F.lit("_p"), page.cast("string"), F.lit("_"), F.substring(hashed, 1, 8))).otherwise(hashed)


def prefix_key(text: Column, prefix: int = 100) -> Column:
    """Key of prefix deduplication: the first characters, lowered and stripped."""
    return stripped(F.lower(F.substring(text, 1, prefix)))


def context_block(rank: Column, source: Column, page: Column, content: Column) -> Column:
    """A numbered source as an answer's context shows it."""
    head = F.concat(F.lit("[Source "), rank.cast("string"), F.lit(": "), F.coalesce(source, F.lit("Unknown")), F.lit(", Page "), F.coalesce(page.cast("string"), F.lit("N/A")), F.lit("]\n"))
    return F.concat(head, F.coalesce(content, F.lit("")))


def collected_context(rank: Column, block: Column) -> Column:
    """Aggregate: the blocks of a group joined in order of rank."""
    rows = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), block.alias("block"))))
    return F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n")


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


_FORM = " Answer in one paragraph of plain text, with steps numbered 1), 2), 3), and with the figures that the context gives. Say so where the context has no answer."
#: What a generator is told before the context, by intent; and where a question is unclear.
SYSTEM_PROMPTS = {
    "disease": "You advise citrus growers on diseases and pests from the numbered sources." + _FORM,
    "scheme": "You advise citrus growers on government support schemes from the numbered sources: names, amounts, who may apply and how." + _FORM,
    "hybrid": "You advise citrus growers on a disease or pest and on the support there is for it, from the numbered sources: first what to do, then which schemes help." + _FORM,
    "ambiguous": "A grower's question is unclear. Ask back in one paragraph: say what has to be known, numbered 1), 2), 3), and give three questions that could be asked.",
}


def system_prompt(intent: Column) -> Column:
    """The prompt of an intent; anything but disease and hybrid has that of schemes."""
    return F.when(intent.isin("hybrid", "disease", "ambiguous"), F.element_at(F.create_map(*[F.lit(x) for kv in SYSTEM_PROMPTS.items() for x in kv]), intent)).otherwise(SYSTEM_PROMPTS["scheme"])
