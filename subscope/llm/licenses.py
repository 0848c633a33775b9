"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.9
STRETCH = 2  # a block has as many words as this many times the template

# fixed values: phrases that count wherever their words stand consecutively
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# fixed values: wording of public license notices
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case. Java's lower-casing does that and changes other letters to other non-ASCII ones only,
    but for two that become an ASCII letter."""
    return F.when(text.rlike("[\u0130\u212A]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def token_set(text: str) -> list[str]:
    low = "".join(c if c.isalnum() else " " for c in text.lower())
    return sorted(set(low.split()))


def word_count(text: str) -> int:
    return len("".join(c if c.isalnum() else " " for c in text).split())


def need_of(tokens: Sequence[str], threshold: float) -> int:
    """How many of a template's distinct tokens a block must hold."""
    return math.ceil(threshold * len(tokens) - 1e-9)


def spaced(text: Column) -> Column:
    """All words with one space before, between and after them; two spaces if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text), SEPARATORS + "+", " ")), F.lit(" "))


def phrases(docs: DataFrame, spaced_col: str) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word and base_labels (array), from the column of ``spaced`` words."""
    s = F.col(spaced_col)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        head, rest = phrase.split(" ", 1)
        there = s.contains(f" {phrase} ")
        counts.append(F.when(there, F.regexp_count(s, F.lit(f" {head}(?= {rest} )"))).otherwise(0).cast("long"))
        # words before the first place: the spaces before it; the last place likewise from the reversed text
        firsts.append(F.when(there, spaces(F.substring_index(s, f" {phrase} ", 1))))
        after = F.substring_index(s, f" {phrase} ", -1)
        lasts.append(F.when(there, F.col("n_words") - spaces(after) - len(phrase.split(" ")) + 0))
        labels.append(F.when(there, F.lit(label)))
    out = docs.withColumn("n_words", F.when(F.trim(s) == "", 0).otherwise(spaces(s) - 1).cast("long"))
    return out.withColumns({
        "n_base": sum(counts[1:], counts[0]),
        "first_word": F.array_min(F.array(*firsts)).cast("long"),
        "last_word": F.array_max(F.array(*lasts)).cast("long"),
        "base_labels": F.array_compact(F.array(*labels)),
    })


def reduced(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """What one scan takes from each whole text: the base columns, the templates' tokens in it and its blocks.

    ``docs`` has doc_id, text and key. ``held`` are the distinct tokens. ``blocks`` is null unless the text holds enough
    tokens of some template (the length filter, on the whole text); else they are pieces of the text of twice the
    longest run, one starting every longest run, so that each run lies whole in a piece. Words outside the templates
    are empty in them.
    """
    sets = [token_set(text) for _, text in templates]
    vocabulary = sorted(set().union(*sets))
    widest = STRETCH * max(word_count(text) for _, text in templates)
    words, literals = F.col("__w"), lambda tokens: F.array(*map(F.lit, tokens))
    out = phrases(docs.withColumn("__s", spaced(F.col("text"))).drop("text"), "__s")
    out = out.withColumn("__w", F.split(F.trim("__s"), " ")).drop("__s")
    out = out.withColumn("held", F.array_intersect(literals(vocabulary), words))
    enough = [F.size(F.array_intersect(literals(s), F.col("held"))) >= need_of(s, threshold) for s in sets]
    known = F.transform(words, lambda w: F.when(w.isin(vocabulary), w).otherwise(""))
    pieces = F.transform(F.sequence(F.lit(1), F.size("__k"), F.lit(widest)), lambda i: F.slice("__k", i, 2 * widest))
    out = out.withColumn("__k", F.when((F.size("held") > 0) & F.greatest(F.lit(False), *enough), known)).drop("__w")
    return out.withColumn("blocks", F.when(F.col("__k").isNotNull(), pieces)).drop("__k")


def frequencies(seen: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """How many rows of ``seen`` hold each of the templates' ``tokens``; the result is as long as ``tokens``."""
    found = {r["token"]: r["count"] for r in seen.select(F.explode("held").alias("token")).groupBy("token").count().collect()}
    return {t: found.get(t, 0) for t in tokens}


def prefix_index(spark: SparkSession, freq: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(token, template, label, tokens, need, span): each template under the rarest tokens of which a match holds one.

    A block that shares ``need`` of n tokens misses n - need at most, so it has one of the n - need + 1 rarest.
    """
    rows = []
    for i, (label, text) in enumerate(templates):
        tokens = sorted(token_set(text), key=lambda t: (freq[t], t))
        need = need_of(tokens, threshold)
        rows += [(t, i, label, tokens, need, STRETCH * word_count(text)) for t in tokens[: len(tokens) - need + 1]]
    return spark.createDataFrame(rows, "token string, template int, label string, tokens array<string>, need int, span int")


def template_matches(seen: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, label, containment) of every row of ``reduced`` and template at or over the threshold.

    A block is a run of STRETCH times as many words as the template has, wherever it starts and however its lines are
    broken. Containment is the largest share of the template's distinct tokens that a run holds.
    """
    vocabulary = sorted(set().union(*(token_set(t) for _, t in templates)))
    freq = frequencies(seen, vocabulary)
    by_rarity = sorted(vocabulary, key=lambda t: (freq[t], t))
    index = prefix_index(seen.sparkSession, freq, templates, threshold)
    heads = sorted({r["token"] for r in index.select("token").collect()})
    pieces = seen.where(F.col("blocks").isNotNull()).select("doc_id", "key", F.posexplode("blocks").alias("piece", "words"))
    # the piece's template words, rarest first
    pieces = pieces.withColumn("held", F.array_intersect(F.array(*map(F.lit, by_rarity)), F.col("words")))
    probes = pieces.withColumn("token", F.explode(F.array_intersect(F.array(*map(F.lit, heads)), F.col("held"))))
    pairs = probes.join(F.broadcast(index), "token")  # one row for each template and prefix token, fixed by the templates
    # length filter and positional filter: what is left from the shared token on must suffice
    left = F.size("held") - F.array_position("held", F.col("token")) + 1
    pairs = pairs.where((F.size("held") >= F.col("need")) & (left >= F.col("need") - (F.array_position("tokens", F.col("token")) - 1)))
    # a pair meets under each of its prefix tokens; the first one in the template's order speaks for it
    first = F.filter("tokens", lambda t: F.array_contains("held", t))[0]
    pairs = pairs.where((first == F.col("token")) & (F.size(F.array_intersect("held", "tokens")) >= F.col("need")))
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("tokens", F.element_at("words", i)))
    runs = F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("words", i, F.col("span")), F.col("tokens"))))
    verified = pairs.withColumn("shared", F.array_max(runs)).where("shared >= need")
    return verified.groupBy("doc_id", "key", "template", "label").agg(F.max(F.col("shared") / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: counts of base phrases, labels and the best score.

    The score is 1 with a base phrase, else the best containment at or over the threshold, else 0. A null text is
    empty: no words, null places, empty labels. Rows alike in id and text get equal results. ``docs`` is scanned once.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    seen = materialize(reduced(base.withColumn("key", F.xxhash64("text")), templates, threshold), "licenses")
    found = template_matches(seen, templates, threshold)
    found = found.groupBy(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best")  # as many labels as templates at most
    )
    out = seen.drop("held", "blocks").join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k")), "left")
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined("base_labels").alias("base_labels"),
        joined(F.concat("base_labels", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
