"""License scans: places of base phrases, and license notices found by a set-similarity join.

Method: exact set-similarity join of notice templates with text blocks (paragraphs: lines up to one
without a word). Both are sets of words; a template T is a candidate where a block holds
ceil(t |T|) of its words. Words are ordered by how few documents of the whole corpus hold them,
rarest first. A block that reaches the threshold must share one of the first |T| - ceil(t |T|) + 1
words of T in that order (prefix filter), have at least ceil(t |T|) template words (length filter),
and have enough words left behind the shared ones (positional filter). Only blocks that pass are
compared in full. A candidate is found where some run of neighbouring words, across line ends and
little more than twice as long as the template, holds ceil(t |T|) of its words, the words that tell
T from other notices among them (MARKS).

Everything is DataFrame expressions. Template words are few and fixed, so a text is first reduced
to the template words it holds; only texts that hold enough words of some template are cut into
paragraphs. The template index is broadcast: its size depends on the given templates alone, and the
texts' blocks are not moved.

Cases: a null or empty text has no words, places or labels and score 0; equal places cannot tie, as
a word starts one phrase at most; repeated rows each get their row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import id_and_text, lower_ascii
from holdfast.session import stage

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = rf"\n{BREAKS[:-1]}*\n"  # a line without a word
THRESHOLD = 0.8

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"),
           ("all rights reserved", "reserved"))
# Notices by label, in the words that license texts ask to be used.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, "
            "are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related "
            "or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"))
# What must stand in a notice, by template: words or phrases, `|` between equal ones.
MARKS = (("apache", "2|v2"), ("redistribution", "binary"), ("by nc",), ("by sa",), ("waived",),
         ("gnu general public license", "3|v3"), ("lesser general public license",), ("mit",),
         ("permission", "associated"), ("mozilla",), ("unencumbered",))


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(BREAKS, text.lower()) if w))


def span(text: str) -> int:
    """Words among which a notice must stand: room for names and comment marks between its own."""
    return 2 * sum(w != "" for w in re.split(BREAKS, text)) + 4


def needed(n: int, threshold: float) -> int:
    return ceil(threshold * n - 1e-9)


def _phrase_at(words: str, i: Column, phrase: str) -> Column:
    test = F.lit(True)
    for k, word in enumerate(phrase.split()):
        test &= F.get(words, i + k) == word
    return F.coalesce(test, F.lit(False))


def _places(words: str) -> Column:
    """(start, label) wherever a base phrase stands."""
    def at(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in reversed(PHRASES):
            found = F.when(_phrase_at(words, i, phrase), label).otherwise(found)
        return F.struct(i.cast("long").alias("start"), found.alias("label"))

    every = F.transform(F.sequence(F.lit(0), F.size(words) - 1), at)
    return F.filter(every, lambda x: x["label"].isNotNull())


def _any_phrase() -> str:
    return "|".join(p.replace(" ", BREAKS) for p, _ in PHRASES)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text", marks: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Per row: id, n_words, places (start, label), labels and score, and the found blocks.

    marks: what each template's notices must hold; MARKS for TEMPLATES, nothing for other ones.
    """
    if marks is None:
        marks = MARKS if templates is TEMPLATES else [()] * len(templates)
    wanted = [(label, template_words(text), span(text), [f"(?:^| )(?:{m})(?: |$)" for m in must])
              for (label, text), must in zip(templates, marks, strict=True)]
    vocabulary = sorted({w for _, words, _, _ in wanted for w in words})
    low = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    rows = id_and_text(docs, id_col, text_col).select("doc_id", low.alias("low")).withColumn(
        "words", F.filter(F.split("low", BREAKS), lambda w: w != "")).select(
        "doc_id", "low", F.size("words").cast("long").alias("n_words"),
        F.when(F.col("low").rlike(_any_phrase()), _places("words")).otherwise(none)
        .alias("places"),
        F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])).alias("held"))
    enough = F.lit(False)
    for _, words, _, _ in wanted:
        enough |= F.size(F.array_intersect("held", F.array(*[F.lit(w) for w in words]))) >= (
            needed(len(words), threshold))
    rows = stage(rows.select("doc_id", "n_words", "places", "held",
                             F.when(enough, F.col("low")).alias("low"),
                             F.monotonically_increasing_id().alias("row")), "licenses")
    blocks = found_blocks(rows, wanted, vocabulary, threshold)
    labelled = blocks.groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("nearest"),
        F.collect_set(F.struct("block", "label", "containment")).alias("blocks"))
    out = rows.drop("held", "low").join(labelled, "row", "left")
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    both = F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("nearest", F.lit(0.0)))
    return out.select("doc_id", "n_words", "places", F.array_sort(base).alias("base_labels"),
                      F.array_sort(both).alias("labels"), score.alias("score"), "blocks")


def found_blocks(rows: DataFrame, wanted: Sequence[tuple[str, list[str], int, list[str]]],
                 vocabulary: list[str], threshold: float) -> DataFrame:
    """(row, block, label, containment): the join itself. rows: row, held, low."""
    spark = rows.sparkSession
    # one row per template word comes back: how many documents hold it
    uses = {r["word"]: r["n"] for r in rows.select(F.explode("held").alias("word")).groupBy(
        "word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (uses.get(w, 0), w))
    rank = {w: k + 1 for k, w in enumerate(order)}
    index, smallest = [], len(order)
    for label, words, reach, marks in wanted:
        own = sorted(rank[w] for w in words)
        least = needed(len(own), threshold)
        smallest = min(smallest, least)
        first = own[:len(own) - least + 1]
        index += [(r, i, first, label, own, words, least, reach, marks)
                  for i, r in enumerate(first)]
    templates = spark.createDataFrame(
        index, "rank int, place int, first array<int>, label string, own array<int>, "
               "own_words array<string>, least int, reach int, marks array<string>")
    ranked = F.array(*[F.lit(w) for w in order])
    blocks = rows.where("low IS NOT NULL").select("row", F.posexplode(F.split("low", GAP)).alias(
        "block", "part"))
    sets = blocks.select("row", "block", "part", F.array_sort(F.transform(
        F.array_intersect(F.split("part", BREAKS), ranked),
        lambda w: F.array_position(ranked, w).cast("int"))).alias("ranks")).where(
        F.size("ranks") >= smallest)
    probes = sets.select("*", F.posexplode("ranks").alias("at", "rank"))
    size = F.size("ranks")
    # a block meets a template once, by the first prefix word they share
    candidates = probes.join(F.broadcast(templates), "rank").where(
        (size >= F.col("least")) & (F.least(F.size("own") - F.col("place"), size - F.col("at"))
                                    >= F.col("least"))
        & (F.array_min(F.array_intersect("ranks", "first")) == F.col("rank"))
        & (F.size(F.array_intersect("ranks", "own")) >= F.col("least")))
    own = F.col("own_words")

    def once(value: Column, use) -> Column:
        """use(value), with the value computed a single time."""
        return F.get(F.transform(F.array(value), use), 0)

    def held(run: Column) -> Column:
        """Template words of a run that is a notice."""
        n = F.size(F.array_intersect(run, own))
        marked = F.forall("marks", lambda m: F.rlike(F.concat_ws(" ", run), m))
        return F.when((n >= F.col("least")) & marked, n)

    def most(words: Column) -> Column:
        return F.array_max(F.transform(words, lambda w, i: F.when(
            F.array_contains(own, w), once(F.slice(words, i + 1, F.col("reach")), held))))

    words = F.filter(F.split("part", BREAKS), lambda w: w != "")
    # exploded, so that the filter below is not computed a second time under it
    return candidates.select("row", "block", "label", "own_words", F.explode(
        F.transform(F.array(words), most)).alias("most")).where("most IS NOT NULL").select(
        "row", "block", "label", (F.col("most") / F.size("own_words")).alias("containment"))
