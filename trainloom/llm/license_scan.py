"""License scans by an exact set-similarity join of text blocks and templates, in DataFrame functions only.

Blocks are all runs of SPAN times as many words as a template has, over the words of the whole text, so neither line
breaks nor the length of lines matter, and words that stand far apart make no match. A template is a short list of
words; a block matches if it holds at least THRESHOLD of the template's distinct words (containment). Words are
ordered by how many texts hold them, rarest first. What lacks at most k of a template's words has one of its k + 1
rarest (prefix filter), has as many template words as must be shared (length filter), and, from the first shared
word on, both must still have enough words (positional filter): first whole texts must pass, then blocks must have
a word of the prefix, then their words are counted. Templates are a fixed handful, so the join's small side is part
of the plan and no row moves but the word counts.

Phrases are counted besides, as places where their words stand consecutively. Null and empty texts have no
words, no places and no labels; very long ones are scanned whole, block by block. Of equally good blocks of a template
the first is told. Rows with equal or null doc_ids are scanned as they stand; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainloom.llm.quality_rules import barrier

THRESHOLD, SPAN = 0.85, 2
#: Words are runs of ASCII letters and digits and of all that is not ASCII.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences that stand in texts under a license (fixed values, from the licenses' own notices); several have one label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("cc", "licensed under cc by"),
    ("cc-nc", "licensed under cc by nc"),
    ("reserved", "all rights reserved"),
)


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, APART), "")


def rarity(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Of each template word, how many texts hold it."""
    own = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), APART))
    counts = {r["word"]: r["n"] for r in docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row a template word
    return {w: counts.get(w, 0) for w in vocabulary}


def need(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def passes(own: Column, template: list[str], threshold: float) -> Column:
    """Whether words (rarest first) pass the length, prefix and positional filters for the template (rarest first)."""
    n, least = len(template), need(len(template), threshold)
    # With the first shared word at i of the template and j of the words, no more than what follows both can be shared.
    room = F.lit(0)
    for i, w in reversed(list(enumerate(template[: n - least + 1]))):
        j = F.array_position(own, w).cast("int")
        room = F.when(j > 0, F.least(F.lit(n - i), F.size(own) - j + 1)).otherwise(room)
    return (F.size(own) >= least) & (room >= least) & (F.size(F.array_intersect(own, F.array(*map(F.lit, template)))) >= least)


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches for each row.

    matches has, for each template that a block meets the threshold with, its label, the containment of the best
    block, and the word and the line at which the first such block starts; score is the largest containment, or 1
    where a phrase stands.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counts = rarity(docs, vocabulary)
    ordered = [(label, sorted(set(t.split()), key=lambda w: (counts[w], w))) for label, t in templates]
    spread = F.array(*map(F.lit, sorted(vocabulary, key=lambda w: (counts[w], w))))
    rarest = sorted({w for _, t in ordered for w in t[: len(t) - need(len(t), threshold) + 1]})
    out = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    out = out.withColumn("_split", F.split("_text", APART)).withColumn("n_words", (F.size("_split") - F.when(F.get("_split", 0) == "", 1).otherwise(0) - F.when((F.size("_split") > 1) & (F.element_at("_split", -1) == ""), 1).otherwise(0)).cast("long")).drop("_split")

    # Words stand one space apart, so that a phrase's place is the number of spaces before it.
    some = reduce(lambda a, b: a | b, [F.regexp_like("_text", F.lit("(?i)" + p.replace(" ", APART))) for p in phrases])
    out = out.withColumn("_words", barrier(F.when(some, words(lower("_text"))).otherwise(F.array().cast("array<string>"))))
    for i, p in enumerate(phrases):
        out = out.withColumn(f"_at{i}", barrier(F.when(F.size("_words") > 0, F.filter(F.sequence(F.lit(0), F.size("_words") - 1), partial(stands, p.split()))).otherwise(F.array().cast("array<int>"))))
    out = out.withColumn("_at", barrier(F.concat(*[f"_at{i}" for i in range(len(phrases))])))
    base = [F.when(F.size(f"_at{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]
    out = out.withColumn("_base", barrier(F.array_compact(F.array(*base))))

    # Texts without any word of a prefix are done with.
    may = F.regexp_like("_text", F.lit(r"(?i)(?<![a-z0-9\x80-\x{10FFFF}])(?:" + "|".join(rarest) + r")(?![a-z0-9\x80-\x{10FFFF}])"))
    out = out.withColumn("_all", barrier(F.when(may, words(lower("_text"))).otherwise(F.array().cast("array<string>"))))
    out = out.withColumn("_own", barrier(F.array_intersect(spread, "_all")))
    for i, (label, t) in enumerate(ordered):
        best = block(t, SPAN * len(templates[i][1].split()), threshold)
        out = out.withColumn(f"_best{i}", barrier(F.when(passes(F.col("_own"), t, threshold), best)))
    found = [F.when(F.col(f"_best{i}").isNotNull(), F.struct(F.lit(label).alias("label"), F.col(f"_best{i}.containment").alias("containment"), (F.col(f"_best{i}.at") - 1).cast("long").alias("word"), line_of(F.col(f"_best{i}.at")).alias("line"))) for i, (label, _) in enumerate(ordered)]
    out = out.withColumn("matches", barrier(F.array_compact(F.array(*found))))
    more = F.transform("matches", lambda m: m["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.greatest(F.when(F.size("_at") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"), joined("_base").alias("base_labels"), joined(F.concat("_base", more)).alias("labels"), score.alias("score"), "matches")


def stands(phrase: list[str], i: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.get("_words", i + k) == w, F.lit(False)) for k, w in enumerate(phrase)])


def block(template: list[str], length: int, threshold: float) -> Column:
    """containment and at of the first best block of so many words of the text that holds enough of the template; null if none does."""
    least = need(len(template), threshold)
    own, prefix = (F.array(*map(F.lit, x)) for x in (template, template[: len(template) - least + 1]))
    # The best blocks may start with a word of the template; the text's end cuts the last ones.
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_all"), F.lit(1))), lambda i: F.array_contains(own, F.get("_all", i - 1)) & F.arrays_overlap(F.slice("_all", i, length), prefix))
    held = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice("_all", i, length), own)).alias("held"), (-i).alias("back")))
    best = F.array_max(held)
    return F.when(best["held"] >= least, F.struct((best["held"] / F.lit(len(template))).alias("containment"), (-best["back"]).alias("at")))


def line_of(at: Column) -> Column:
    """The number of the line that has the text's word at this place, counted from 1."""
    upto = F.transform(F.split("_text", "\n"), lambda x: F.size(words(lower(x))))
    sums = F.aggregate(upto, F.struct(F.lit(0).alias("words"), F.lit(0).alias("line")), lambda s, n: F.struct((s["words"] + n).alias("words"), (s["line"] + F.when(s["words"] + n < at, 1).otherwise(0)).alias("line")))
    return sums["line"]


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("matches")
