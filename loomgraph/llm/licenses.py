"""Licence texts by an exact set-similarity join.

Text blocks are overlapping windows over the words of the whole text, whatever its lines. They are joined with licence
templates wherever a block holds at least ``THRESHOLD`` of a template's distinct words, the words that tell it from its
neighbours (``nc``, ``sa``, a version) among them. Words are ordered from the rarest in the corpus to the commonest; a
block that reaches the threshold must share one of the template's first ``n - need + 1`` words (prefix filter), must
have enough template words at all (length filter), and enough of them at or after the shared one (positional filter).
What is left is verified on the whole sets, so the join is exact.

Column expressions and joins only. The templates are a fixed small table, the one broadcast side; word frequencies come
from all documents, folded map-side to the templates' few words.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, read_documents

#: Words of the contract: runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.85
#: Words of a block, and from one block's first word to the next one's: any 24 words in a row lie whole in a block.
BLOCK_WORDS = 32
STRIDE = 8

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}

#: Sentences by which public licences are named or granted, and their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", "All rights reserved"),
)

#: Words that a block must hold to get a label, since they tell it from licences worded alike.
TELLING = {"apache-2.0": {"apache", "2"}, "cc-by-nc": {"nc"}, "cc-by-sa": {"sa"}, "cc0": {"cc0"}, "gpl-3.0": {"gnu", "3"}, "lgpl": {"lesser"}, "mpl-2.0": {"mozilla"}}


def template_words(text: str) -> list[str]:
    """Distinct words in order of their first place."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def words(text: Column) -> Column:
    """The words of a text with A-Z lowered.

    ``lower`` changes other letters, too, but no word sought here has any; the Kelvin sign, the one letter that it turns
    into an ASCII one, is put out of its reach.
    """
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b"))), NOT_WORD), "")


def places(w: Column, phrase: tuple[str, ...]) -> Column:
    """Starts of the phrase in the word array."""
    follows = lambda i: [F.get(w, i + k) == F.lit(x) for k, x in enumerate(phrase[1:], 1)]

    def here(x: Column, i: Column) -> Column:
        cond = x == F.lit(phrase[0])
        for c in follows(i):
            cond = cond & c
        return F.when(cond, i)

    return F.when(F.array_contains(w, phrase[-1]), F.filter(F.transform(w, here), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def text_blocks(docs: DataFrame, some_of: Column) -> DataFrame:
    """doc_id and ``w``, the distinct words of a block, for every block of the texts that hold a word of ``some_of``."""
    held = docs.select("doc_id", words(F.col("text")).alias("all")).where(F.arrays_overlap("all", some_of))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (BLOCK_WORDS - STRIDE)), F.lit(STRIDE))
    cut = held.select("doc_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, BLOCK_WORDS))).alias("w"))
    return cut.select("doc_id", F.array_distinct("w").alias("w")).where(F.arrays_overlap("w", some_of))


def word_frequencies(docs: DataFrame, vocabulary: Iterable[str]) -> dict[str, int]:
    """How many documents hold each template word; one pass over all of them, at most one row per template word."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(v,) for v in sorted(set(vocabulary))], "word string")
    held = docs.select(F.explode(F.array_intersect(words(F.col("text")), F.array(*(F.lit(v) for v in sorted(set(vocabulary)))))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {r["word"]: counts.get(r["word"], 0) for r in wanted.collect()}


def containment_join(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, label, containment): every label whose template a block of the document holds to the threshold.

    ``docs`` has doc_id and text (no nulls). Containment is the best over the document's blocks and the label's templates.
    """
    spark = docs.sparkSession
    sets = [(label, template_words(text)) for label, text in templates]
    frequency = word_frequencies(docs, (w for _, ws in sets for w in ws))
    order = sorted(frequency, key=lambda w: (frequency[w], w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for t, (label, ws) in enumerate(sets):
        ws = sorted(ws, key=rank.__getitem__)
        need = math.ceil(threshold * len(ws) - 1e-9)
        telling = sorted(TELLING.get(label, set()) & set(ws))
        index += [(w, t, label, i, need, ws, telling) for i, w in enumerate(ws[: len(ws) - need + 1])]
    prefixes = spark.createDataFrame(index, "word string, template int, label string, at int, need int, words array<string>, telling array<string>")
    first = F.array(*(F.lit(w) for w in sorted({row[0] for row in index})))
    in_order = F.array(*(F.lit(w) for w in order))
    candidates = text_blocks(docs, first)
    # the block's template words from the rarest to the commonest, and which of them open a template
    ordered = candidates.select("doc_id", F.array_intersect(in_order, F.col("w")).alias("b"))
    probes = ordered.select("doc_id", "b", F.posexplode("b").alias("place", "word"))
    met = probes.join(F.broadcast(prefixes), "word")
    size = F.size("words")
    long_enough = F.size("b") >= F.col("need")
    enough_left = F.least(size - F.col("at"), F.size("b") - F.col("place")) + F.least(F.col("at"), F.col("place")) >= F.col("need")
    overlap = F.size(F.array_intersect("b", "words"))
    verified = met.where(long_enough & enough_left).withColumn("overlap", overlap).where((F.col("overlap") >= F.col("need")) & (F.size(F.array_except("telling", "b")) == 0))
    return verified.groupBy("doc_id", "label").agg(F.max(F.col("overlap") / size).alias("containment"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row.

    Null and empty texts have no words and no labels (empty strings), and score 0. A phrase scores 1, else the best
    containment counts. Rows repeated with one doc_id are one document: each row's own phrases, their common templates.
    Labels that tie are all listed. Texts of any length go one way, in blocks; a row takes memory in proportion to its
    words.
    """
    texts = id_text(docs)
    found = containment_join(texts).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    marked = texts.select("doc_id", words(F.col("text")).alias("w"))
    spots = {label: places(F.col("w"), phrase) for label, phrase in PHRASES.items()}
    at = marked.select("doc_id", F.size("w").cast("long").alias("n_words"), *(spot.alias(f"p{k}") for k, spot in enumerate(spots.values())))
    every = F.concat(*(F.col(f"p{k}") for k in range(len(spots))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(spots))))
    counted = at.select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("_base"))
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.round(F.coalesce("_best", F.lit(0.0)), 6)).alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_documents(spark, sf_dir))


def _oracle() -> str:
    rows = ", ".join(f"({t}, '{label}', {sorted(template_words(text))!r}, {sorted(TELLING.get(label, set()))!r}::VARCHAR[])" for t, (label, text) in enumerate(TEMPLATES))
    cond = lambda p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p))
    cases = " ".join(f"WHEN {cond(p)} THEN '{label}'" for label, p in PHRASES.items())
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = rf"list_filter(string_split_regex({low}, '{NOT_WORD}'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {split.format("t")} AS w FROM d),
p AS (SELECT r, i - 1 AS i, CASE {cases} END AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
b AS (SELECT r, CAST(count(*) AS BIGINT) AS n_base, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word,
             list_sort(list_distinct(list(label))) AS ls FROM p WHERE label IS NOT NULL GROUP BY r),
k AS (SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - {BLOCK_WORDS - STRIDE}) + 1, {STRIDE}), lambda i: w[i : i + {BLOCK_WORDS - 1}])) AS w FROM w WHERE len(w) > 0),
t AS (SELECT * FROM (VALUES {rows}) AS t (t, label, ws, telling)),
m AS (SELECT doc_id, label, max(len(list_intersect(k.w, t.ws)) / len(t.ws)) AS c FROM k, t
      WHERE len(list_intersect(k.w, t.ws)) >= ceil({THRESHOLD} * len(t.ws) - 1e-9) AND list_has_all(k.w, t.telling) GROUP BY doc_id, label),
n AS (SELECT doc_id, list(label) AS ls, max(c) AS c FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b.ls, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(n.ls, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(coalesce(n.c, 0.0)::DOUBLE, 6) END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM w.doc_id
"""


OP7_SQL = _oracle()
