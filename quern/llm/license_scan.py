"""License scans by diagonal voting.

Rolling word k-gram hashes of every document are joined by Spark to the positions of the same grams in license
templates. A hit votes for its diagonal (document position minus template position); votes are aggregated by diagonal,
neighbouring diagonals are merged (words put in or left out shift a match sideways), and a merged span is verified by
the share of the template's grams that its own words equal.

Before the join each task keeps only grams whose hash is some template's: the templates are a fixed list, so this
exact semi-join leaves a few rows a document. Hits carry their words, and the join compares words as well as hashes.

Defined cases: a null text is empty and gives zero counts and null places; repeated rows come out as often as they go
in; rows that share a doc_id but not a text stay apart; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, map_pieces, utf8

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Further short phrases; they need every word, as the base phrases do.
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache": "apache",
    "spdx license identifier gpl": "gpl",
    "all rights reserved": "all-rights-reserved",
}

#: Notices that are matched loosely: MIN_COVER of their grams have to vote.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/""",
}
PHRASE_K, NOTICE_K = 2, 4
#: Diagonals up to so many words apart merge; a diagonal of a notice counts from so many votes on.
MERGE_GAP, MIN_VOTES, MIN_COVER = 6, 2, 0.6
#: Decimals of the score.
SCORE_DIGITS = 6

_RAW = "doc_id long, text_key string, n_words long, hits array<struct<pos:long,gram:string>>"


def split_words(text: str) -> list[str]:
    return re.findall(tc.WORD_PATTERN, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def templates() -> list[tuple[str, str, bool, int, list[str]]]:
    """(template, label, base?, k, words) for every phrase and notice."""
    out = [(p, x, True, PHRASE_K, p.split()) for p, x in BASE_PHRASES.items()]
    out += [(p, x, False, PHRASE_K, p.split()) for p, x in PHRASES.items()]
    out += [(f"notice:{x}", x, False, NOTICE_K, split_words(t)) for x, t in NOTICES.items()]
    return [(name, label, base, min(k, len(ws)), ws) for name, label, base, k, ws in out]


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, base, n_grams, at (of the gram in the template), gram. A fixed few hundred rows."""
    rows = [
        (name, label, base, len(ws) - k + 1, at, " ".join(ws[at : at + k]))
        for name, label, base, k, ws in templates()
        for at in range(len(ws) - k + 1)
    ]
    return spark.createDataFrame(rows, "template string, label string, base boolean, n_grams long, at long, gram string")


def _gram_sets() -> dict[int, tc.HashSet]:
    by_k: dict[int, set[str]] = {}
    for _, _, _, k, ws in templates():
        by_k.setdefault(k, set()).update(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = {}
    for k, grams in by_k.items():
        text = [g.encode() for g in sorted(grams)]
        data = np.frombuffer(b"".join(text), np.uint8)
        found = tc.words(data, np.cumsum([0, *map(len, text)]))
        out[k] = tc.HashSet(tc.gram_hashes(found.hashes(), k)[found.first[:-1]])
    return out


def gram_hits(docs: DataFrame) -> DataFrame:
    """One row per document with its template gram hits; map-only."""
    sets = _gram_sets()

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = tc.words(*utf8(piece.column("text")))
        hashes = found.hashes()
        at, k_of = [], []
        for k, wanted in sets.items():
            places = wanted.places(tc.gram_hashes(hashes, k))
            places = places[tc.inside_one(found, places, k)]
            at.append(places)
            k_of.append(np.full(len(places), k))
        at, k_of = np.concatenate(at), np.concatenate(k_of)
        order = np.argsort(at, kind="stable")
        at, k_of = at[order], k_of[order]
        owner = np.searchsorted(found.first, at, side="right") - 1
        grams = [found.text(i, k).decode("utf-8", "replace") for i, k in zip(at.tolist(), k_of.tolist())]
        each = pa.StructArray.from_arrays([pa.array(at - found.first[owner], pa.int64()), pa.array(grams, pa.string())], ["pos", "gram"])
        cuts = pa.array(np.searchsorted(owner, np.arange(piece.num_rows + 1)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("text_key"), pa.array(found.counts(), pa.int64()), pa.ListArray.from_arrays(cuts, each)],
            ["doc_id", "text_key", "n_words", "hits"],
        )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), F.col("text"))
    return map_pieces(read, "text", step, _RAW)


def spans(hits: DataFrame, grams: DataFrame) -> DataFrame:
    """Verified spans: doc_id, text_key, template, label, base, first_pos, last_pos, cover."""
    votes = hits.join(F.broadcast(grams), "gram").withColumn("diagonal", F.col("pos") - F.col("at"))
    key = ["doc_id", "text_key", "template"]
    by_diagonal = votes.groupBy(*key, "label", "base", "n_grams", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    loose = F.col("template").startswith("notice:")
    by_diagonal = by_diagonal.where(F.when(loose, F.size("ats") >= MIN_VOTES).otherwise(F.size("ats") == F.col("n_grams")))
    along = Window.partitionBy(*key).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    opens = F.when(loose & (gap <= MERGE_GAP), 0).otherwise(1)
    merged = (
        by_diagonal.withColumn("opens", opens)
        .withColumn("group", F.sum("opens").over(along))
        .groupBy(*key, "label", "base", "n_grams", "group")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"), F.min("lo").alias("first_pos"), F.max("hi").alias("last_pos"))
        .withColumn("cover", F.col("covered") / F.col("n_grams"))
    )
    return merged.where(F.col("cover") >= MIN_COVER).drop("group", "covered", "n_grams")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    key = ["doc_id", "text_key"]
    raw = checkpointed(gram_hits(docs).groupBy(*key).agg(F.first("n_words").alias("n_words"), F.first("hits").alias("hits"), F.count(F.lit(1)).alias("copies")))  # a row a text, read twice
    hits = raw.where(F.size("hits") > 0).select(*key, F.inline("hits"))
    found = spans(hits, template_grams(docs.sparkSession))
    base = F.col("base")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_text = found.groupBy(*key).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_pos"))).alias("first_word"),
        F.max(F.when(base, F.col("first_pos"))).alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"),
        names("label").alias("labels"),
        F.max("cover").alias("score"),
        F.count(F.lit(1)).alias("n_spans"),
    )
    left, right = raw.drop("hits").alias("l"), per_text.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key"))
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c)
    none = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c)
    out = left.join(right, same, "left").select(
        "l.doc_id", "l.n_words", zero("n_base"), "r.first_word", "r.last_word", none("base_labels"), none("labels"),
        F.round(F.coalesce("r.score", F.lit(0.0)), SCORE_DIGITS).alias("score"), zero("n_spans"), F.explode(F.sequence(F.lit(1), F.col("l.copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
