"""License scan by an exact set-similarity join; built-in functions only.

Blocks are paragraphs (runs of lines between blank lines), templates license
notices. A block matches a template if it holds at least ``threshold`` of the
template's distinct words. The join is exact:

1. one pass over the texts finds the phrases, and for each block the words
   that any template has; the rest is done without the texts;
2. the words of the templates are ordered by how many blocks of the corpus
   hold them, rarest first (a table of the templates' words, bounded by them);
3. prefix filter: a block that holds ``need`` of a template's ``n`` words
   holds one of its ``n - need + 1`` rarest. The blocks' words are joined with
   those of the templates' prefixes, so a template costs nothing where none of
   its rare words stands. The table of prefixes is broadcast if it is small,
   and otherwise exchanged by word;
4. length filter: the block has ``need`` distinct template words at least;
5. positional filter: with a shared word at place p of the template and q of
   the block, ``1 + min(n - p, size - q)`` must reach ``need``, which holds for
   the rarest shared word of every match;
6. what is left is counted.

Defined results: a null text counts as empty; a text without blank lines is
one block; a template without words matches nothing; repeated rows are judged
one by one; an empty table gives an empty result; other columns of the input
are not looked at.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import numbered, release, staged

#: Phrases whose words mark a license wherever they stand consecutively: fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public license notices, as label -> text.
TEMPLATES = {
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "apache": "licensed under the apache license version 2.0 you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under a creative commons attribution 4.0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.8
#: Words of the templates' prefixes that are broadcast at most, with their templates about 1 KB each.
MOST_PREFIXES = 20_000

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"\n[\x20\t\r]*\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _joined(text: Column) -> Column:
    """The words of a text, one space between them."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), GAP, " "))


def _n_words(joined: Column) -> Column:
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")


def _listed(words: list[str]) -> Column:
    """Words as one value, however many they are."""
    return F.split(F.lit(" ".join(words)), " ")


def word_order(blocks: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, from the word that fewest blocks (``words``) hold to the commonest."""
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    held = {r["word"]: r["n"] for r in counts}  # a row per word of the templates
    return sorted(vocabulary, key=lambda w: (held.get(w, 0), w))


def _prefixes(docs: DataFrame, sets: dict[str, list[str]], order: dict[str, int], threshold: float) -> DataFrame:
    """``word, p, label, n, need, template``: the rare words of each template, ``p`` their places in it from 1."""
    rows = []
    for label, words in sets.items():
        words = sorted(words, key=order.__getitem__)
        n = len(words)
        need = max(1, math.ceil(threshold * n - 1e-9))
        rows += [(w, p, label, n, need, words) for p, w in enumerate(words[: n - need + 1], 1)]
    table = docs.sparkSession.createDataFrame(rows, "word string, p int, label string, n int, need int, template array<string>")
    return F.broadcast(table) if len(rows) <= MOST_PREFIXES else table


def containments(blocks: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """``_tm_row, label, share``: the greatest share of a template's words in any block (``_tm_row, words``) of a row, from ``threshold`` on."""
    sets = {label: sorted(_words_of(text)) for label, text in templates.items()}
    vocabulary = word_order(blocks, sorted({w for words in sets.values() for w in words}))
    order = {w: i for i, w in enumerate(vocabulary)}
    prefixes = _prefixes(blocks, {label: words for label, words in sets.items() if words}, order, threshold)
    rare = sorted({w for words in sets.values() for w in sorted(words, key=order.__getitem__)[: len(words) - max(1, math.ceil(threshold * len(words) - 1e-9)) + 1] if words}, key=order.__getitem__)
    ordered = blocks.select("_tm_row", F.array_intersect(_listed(vocabulary), "words").alias("words"))
    offered = ordered.withColumn("word", F.explode(F.array_intersect("words", _listed(rare))))
    q = F.array_position("words", F.col("word"))
    near = offered.join(prefixes, "word").where((F.size("words") >= F.col("need")) & (1 + F.least(F.col("n") - F.col("p"), F.size("words") - q) >= F.col("need")))
    counted = near.withColumn("_count", F.size(F.array_intersect("template", "words"))).where(F.col("_count") >= F.col("need"))
    return counted.groupBy("_tm_row", "label").agg(F.max(F.col("_count") / F.col("n").cast("double")).alias("share"))


def _words_of(text: str) -> set[str]:
    return {w for w in re.split(GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``n_words``, ``phrases`` (label, places, first, last) and ``matches`` (label, share)."""
    templates = templates or TEMPLATES
    vocabulary = sorted({w for text in templates.values() for w in _words_of(text)})
    rows = numbered(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "_tm_row")
    known = F.transform(F.split("text", BLANK, -1), lambda b: F.array_intersect(_listed(vocabulary), F.split(_joined(b), " ")))
    rows = rows.select("_tm_row", "doc_id", _joined(F.col("text")).alias("_joined"), F.filter(known, lambda b: F.size(b) > 0).alias("_known"))
    phrases = []
    for phrase, label in PHRASES.items():
        # words of every script may stand beside a phrase, so its edges are spaces or the ends
        pieces = F.split("_joined", f"(?<![^ ]){phrase}(?![^ ])", -1)
        first = _n_words(F.trim(F.get(pieces, F.lit(0))))
        last = _n_words(F.col("_joined")) - _n_words(F.trim(F.get(pieces, F.size(pieces) - 1))) - len(phrase.split())
        place = F.struct(F.lit(label).alias("label"), (F.size(pieces) - 1).cast("long").alias("places"), first.alias("first"), last.alias("last"))
        phrases.append(F.when(F.col("_joined").contains(phrase) & (F.size(pieces) > 1), place))
    found = rows.select("_tm_row", "doc_id", _n_words(F.col("_joined")).alias("n_words"), F.filter(F.array(*phrases), lambda p: p.isNotNull()).alias("phrases"), "_known")
    found = staged(found, "license-words")
    matched = containments(found.select("_tm_row", F.explode("_known").alias("words")), templates, threshold)
    lists = matched.groupBy("_tm_row").agg(F.array_sort(F.collect_list(F.struct("label", "share"))).alias("matches"))
    none = F.array().cast(lists.schema["matches"].dataType)
    out = staged(found.drop("_known").join(lists, "_tm_row", "left").select("doc_id", "n_words", "phrases", F.coalesce("matches", none).alias("matches")), "licenses")
    release(found)
    return out


def license_digest(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query."""

    def text(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    base = F.col("phrases.label")
    score = F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.share"), F.lit(0.0)))
    return scanned.select(
        "doc_id",
        "n_words",
        F.aggregate("phrases", F.lit(0).cast("long"), lambda a, p: a + p["places"]).alias("n_base"),
        F.array_min("phrases.first").alias("first_word"),
        F.array_max("phrases.last").alias("last_word"),
        text(base).alias("base_labels"),
        text(F.concat(base, F.col("matches.label"))).alias("labels"),
        score.alias("score"),
    )
