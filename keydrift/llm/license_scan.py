"""License scans by an exact set-similarity join (operator 4).

A text block is any run of BLOCK words, wherever it begins. It meets a template if it contains at least CONTAINED
of the template's distinct words. The join follows the prefix principle: words are put in the global order of
their corpus frequency, rarest first; a block that shares enough words with a template shares one of the
template's first words, so only those are looked up. A stretch of the text holds all blocks that contain a rare
word of some BLOCK places; length and positional bounds drop stretches before sets are compared, and only in
stretches that share enough words are their blocks compared one by one, from every word of the template on.
Phrases standing word for word are found beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Opening or notice lines of public licences.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Share of a template's distinct words that a block contains; words in a block.
CONTAINED, BLOCK = 0.8, 48
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _needed(words: int) -> int:
    """The least overlap that meets the threshold."""
    return next(n for n in range(words + 1) if n >= CONTAINED * words)


def _array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words_of(text: Column) -> Column:
    """The words of a text: digits, letters a-z of either case, and all that is not ASCII."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    parts = phrase.split()

    def stands(at: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, at + k) == part for k, part in enumerate(parts)])

    return F.filter(F.sequence(F.lit(0), F.size(words)), stands)


def _has_phrase(text: Column) -> Column:
    """A quick test that no text with a phrase fails."""
    gap = NOT_WORD
    return F.coalesce(text.rlike("(?i)(" + "|".join(p.replace(" ", gap) for p in PHRASES) + ")"), F.lit(False))


def frequencies(docs: DataFrame) -> dict[str, int]:
    """How often each template word stands in the corpus: as many rows as the templates have words."""
    known = {w for t in TEMPLATES.values() for w in t.split()}
    hits = F.filter(F.transform(words_of(F.col("text")), F.lower), lambda w: w.isin(*sorted(known)))
    counted = docs.select(F.explode(hits).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in known} | {r["word"]: r["count"] for r in counted}


def licensed(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns count the PHRASES; labels adds those of templates that some block meets. score is 1 with a
    phrase, else the greatest containment among blocks that meet a template, else 0. Null and empty texts have
    no words, places or labels. Repeated rows are scanned one by one; columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    counts = frequencies(docs)
    order = sorted(counts, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order)}
    index, sets = [], []
    for number, (label, template) in enumerate(sorted(TEMPLATES.items())):
        ranks = sorted({rank[w] for w in template.split()})
        needed = _needed(len(ranks))
        sets.append((number, label, ranks, needed))
        index += [(r, number, i) for i, r in enumerate(ranks[: len(ranks) - needed + 1])]
    index = spark.createDataFrame(index, "word_rank int, template int, template_at int")
    sets = spark.createDataFrame(sets, "template int, label string, ranks array<int>, needed int")
    rare = [order[r] for r in sorted({r.word_rank for r in index.select("word_rank").distinct().collect()})]
    templates = F.broadcast(index.join(F.broadcast(sets), "template"))  # as many rows as TEMPLATES have words

    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", words_of(F.col("text")).alias("words"))
    exact = F.when(_has_phrase(F.col("text")), F.transform("words", lambda w: F.translate(w, UPPER, LOWER)))
    hit = F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: F.lower(F.get("words", i)).isin(*rare))
    words = words.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), exact.alias("exact"), hit.alias("hits"))

    # Hits in places c * BLOCK and after share a stretch: every block with one of them lies inside it.
    cells = F.array_distinct(F.transform("hits", lambda i: (i / BLOCK).cast("int")))
    ranks = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])

    def stretch(cell: Column) -> Column:
        begin, end = F.greatest(cell * BLOCK - BLOCK + 1, F.lit(0)), cell * BLOCK + 2 * BLOCK - 1
        return F.transform(F.slice("words", begin + 1, end - begin), lambda w: F.try_element_at(ranks, F.translate(w, UPPER, LOWER)))

    block = F.transform(cells, stretch)
    places = {label: _places(F.col("exact"), phrase) for phrase, label in PHRASES.items()}
    base = words.select("row", "doc_id", "n_words", block.alias("blocks"), *[p.alias(label) for label, p in places.items()])
    labels = sorted(places)
    every = F.flatten(F.array(*[F.coalesce(F.col(f"`{x}`"), F.array().cast("array<int>")) for x in labels]))
    named = F.filter(F.array(*[F.when(F.size(F.col(f"`{x}`")) > 0, x) for x in labels]), lambda x: x.isNotNull())
    base = base.select("row", "doc_id", "n_words", "blocks", every.alias("places"), named.alias("named"))
    base = base.select(
        "row", "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("named", ",").alias("base_labels"), F.explode_outer("blocks").alias("block"),
    )

    base = base.withColumnRenamed("block", "stretch").withColumn("block", F.array_sort(F.array_distinct(F.array_compact("stretch"))))
    looked = base.select("*", F.posexplode_outer("block").alias("at", "word_rank"))
    bound = F.least(F.size("ranks") - F.col("template_at"), F.size("block") - F.col("at"))
    met = looked.join(
        templates, (looked.word_rank == templates.word_rank) & (F.size("block") >= F.col("needed")) & (bound >= F.col("needed")), "left"
    )
    common = F.size(F.array_intersect("block", "ranks"))
    # The block that begins at a word of the template holds all that a block with this word as its first one can.
    held = lambda at: F.size(F.array_intersect(F.slice("stretch", at + 1, BLOCK), "ranks"))
    begins = F.filter(F.sequence(F.lit(0), F.size("stretch") - 1), lambda at: F.array_contains("ranks", F.get("stretch", at)))
    most = F.when(common >= F.col("needed"), F.array_max(F.transform(begins, held)))
    met = met.select("*", most.alias("most"))
    contained = F.when(F.col("most") >= F.col("needed"), F.col("most") / F.size("ranks"))
    found = met.select(*[c for c in base.columns if c not in ("block", "stretch")], F.when(contained.isNotNull(), F.col("label")).alias("label"), contained.alias("contained"))
    keys = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    rows = found.groupBy(*keys).agg(F.collect_set("label").alias("more"), F.max("contained").alias("contained"))
    both = F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), "more")
    return rows.select(
        *keys[1:], F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
