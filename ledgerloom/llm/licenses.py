r"""License scans: exact set-similarity join of text blocks with notice templates.

A text's words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased. For a template of
L words the blocks of a text are its word windows [kL, (k + 2)L), so any stretch of L words lies
inside a block. A block meets a template when it holds at least the threshold's share of the
template's distinct words.

Template words are put in one global order, rarest in the corpus first (counted over all texts).
Places of a template's first n - need + 1 words in that order (its prefix) are joined with the table
of template prefixes, as a block that meets a template must hold one of them (prefix filter). Each
place stands for the two blocks around it. A block is looked at only from its rarest template word;
if that stands at place p of the template's order, the block has at most n - p common words
(positional filter), and blocks of fewer than `need` words can't meet it (length filter). What is
left is verified on the block's words. A place carries the words around it, so a text is read once
and never shuffled; what is shuffled are word counts, blocks met, and a row without text for each
document. The table of templates comes from a parameter and is broadcast.

Base labels are places of fixed phrases, found word by word. Null and empty texts have no words,
no labels and score 0; very long texts are scanned whole; repeated rows and rows with null ids are
each reported, as results are joined by the text's 128-bit hash; columns to keep may have any names
but those added, which replace them; other columns are left out.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_CHARS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

#: Phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Sentences of public notices and headers, by the label that they add.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
    ),
    "apache-2": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "lgpl": ("gnu lesser general public license",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2.0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "cc-by": ("licensed under a creative commons attribution license",),
    "cc-by-nc": ("licensed under cc by nc 4.0",),
    "all-rights-reserved": ("all rights reserved",),
}
THRESHOLD = 0.9


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null is empty. Texts of ASCII alone take the faster function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words_of(low: Column) -> Column:
    """Words of a lower-cased text, in order."""
    core = F.btrim(low, F.lit(GAP_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, GAP))


def template_sets(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, int, frozenset[str]]]:
    """(label, length in words, distinct words) of each notice."""
    split = lambda s: "".join(" " if c in GAP_CHARS else c for c in s.lower()).split()
    return [(label, len(split(t)), frozenset(split(t))) for label, notices in templates.items() for t in notices]


def word_order(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template word, rarest in the corpus first; one count per template word reaches the driver."""
    found = docs.select(F.explode(F.filter(words_of(lowered(F.col(text))), lambda w: w.isin(vocabulary))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def prefix_table(spark: SparkSession, sets: list[tuple[str, int, frozenset[str]]], order: dict[str, int], threshold: float) -> DataFrame:
    """A row for each prefix word of each template: word, rank (its place in the template's order), label, length, need, tokens (in order)."""
    rows = []
    for label, length, tokens in sets:
        ordered = sorted(tokens, key=order.__getitem__)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        rows += [(w, r, label, length, need, ordered) for r, w in enumerate(ordered[: len(ordered) - need + 1])]
    return spark.createDataFrame(rows, "word string, rank int, label string, length int, need int, tokens array<string>")


def blocks_met(docs: DataFrame, text: str, prefixes: DataFrame) -> DataFrame:
    """(t1, t2, label, share): text hashes and the shares of the templates that blocks of the text meet."""
    known = prefixes.agg(F.collect_set("word").alias("words"), F.max("length").alias("most")).first()
    words, most = known["words"] or [], known["most"] or 1
    rows = docs.select(*_text_hashes(F.col(text)), words_of(lowered(F.col(text))).alias("words"))
    rows = rows.where(F.arrays_overlap("words", F.array(*map(F.lit, words)).cast("array<string>")))
    # places of prefix words, with the words from `from` on that their blocks can hold
    start = lambda i: F.greatest(i - 2 * most, F.lit(0))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: x.word.isin(words))
    places = F.transform(places, lambda x: F.struct(x.word.alias("word"), x.i.alias("i"), start(x.i).alias("from"), F.slice("words", start(x.i) + 1, 4 * most).alias("near")))
    seeds = rows.select("t1", "t2", F.size("words").alias("n_words"), F.inline(places)).join(F.broadcast(prefixes), "word")
    at = F.floor(F.col("i") / F.col("length")).cast("int")
    blocks = seeds.withColumn("k", F.explode(F.array(at, at - 1))).where("k >= 0").where(F.col("n_words") - F.col("k") * F.col("length") >= F.col("need"))
    blocks = blocks.where(F.size("tokens") - F.col("rank") >= F.col("need"))
    blocks = blocks.withColumn("block", F.slice("near", F.col("k") * F.col("length") - F.col("from") + 1, 2 * F.col("length")))
    blocks = blocks.where(~F.arrays_overlap("block", F.slice("tokens", F.lit(1), F.col("rank"))))
    common = F.size(F.array_intersect("block", "tokens"))
    return blocks.where(common >= F.col("need")).select("t1", "t2", "label", (common / F.size("tokens").cast("double")).alias("share"))


def _text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), text).alias(f"t{seed}") for seed in (1, 2)]


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, tuple[str, ...]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns to keep, with n_words, n_base, first_word, last_word long, base_labels, labels string, score double."""
    phrases = BASE_PHRASES if phrases is None else phrases
    sets = template_sets(TEMPLATES if templates is None else templates)
    order = word_order(docs, text, sorted({w for *_, tokens in sets for w in tokens}))
    met = blocks_met(docs, text, prefix_table(docs.sparkSession, sets, order, threshold))
    met = met.groupBy("t1", "t2").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))

    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[c for c in keep if c not in made]).alias("row"), *_text_hashes(F.col(text)), lowered(F.col(text)).alias("low"))
    rows = rows.withColumn("n_words", F.regexp_count("low", F.lit(WORD)).cast("long"))
    word = WORD[:-1]
    found = []
    for i, (phrase, label) in enumerate(phrases.items()):
        parts = phrase.split(" ")
        likely = F.lit(True)
        for p in sorted(parts, key=len, reverse=True):
            likely = likely & F.col("low").contains(p)
        pieces = F.col(f"pieces{i}")
        # cut at the phrase's first word where the others follow, so that places may overlap
        rest = "".join(f"{GAP}{p}" for p in parts[1:])
        rows = rows.withColumn(f"pieces{i}", F.when(likely, F.split("low", f"(?<!{word}){parts[0]}(?={rest}(?!{word}))")))
        n = F.when(pieces.isNull(), 0).otherwise(F.size(pieces) - 1).cast("long")
        there = n > 0
        first = F.when(there, F.regexp_count(F.element_at(pieces, 1), F.lit(WORD)).cast("long"))
        last = F.when(there, F.col("n_words") - F.regexp_count(F.element_at(pieces, -1), F.lit(WORD)) - F.lit(1))
        found.append((n, first, last, F.when(there, F.lit(label))))
    counts, firsts, lasts, names = zip(*found)
    pick = lambda f, cols: f(*cols) if len(cols) > 1 else cols[0]
    base = rows.select("row", "t1", "t2", "n_words", sum(counts[1:], counts[0]).alias("n_base"), pick(F.least, firsts).alias("first_word"), pick(F.greatest, lasts).alias("last_word"), F.array_compact(F.array(*names)).alias("base"))

    out = base.join(met, ["t1", "t2"], "left")
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    labels = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select("row.*", "n_words", "n_base", "first_word", "last_word", join(F.col("base")).alias("base_labels"), join(labels).alias("labels"), score.alias("score")).drop("_")
