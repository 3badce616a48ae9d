"""License scan by an exact set-similarity join, in DataFrame operations only.

Blocks of text are runs of words, whatever the line breaks. A block matches a license template, as sets of tokens, if it
holds at least CONTAINMENT of the template's tokens in SPAN times the template's words. The template tokens are ordered by
their frequency in the corpus, rarest first, and three filters leave few pairs of a text and a template: a text with a block
that matches holds one of the template's first tokens (prefix), as many template tokens as are needed (length), and behind
the first shared token enough of both are left (position). The blocks of what remains are counted exactly.

The texts are read once. That reading writes, per row, which template tokens it holds and, if they are as many as some
template needs, the places of all of them; everything else works on this slim table.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.llm.texts import ascii_lower, table
from offerloom.plans.lineage import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
CONTAINMENT = 0.9
#: Words of a block, as a multiple of the template's words; room for what a notice has in between, such as an address.
SPAN = 1.5
#: The wording of well-known notices.
TEMPLATES = (
    ("mit-1", "Released under the MIT License"),
    ("mit-2", "Licensed under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_tokens(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, text.lower())))


def needed(tokens: int) -> int:
    """Tokens that a block must share with a template of so many."""
    return math.ceil(CONTAINMENT * tokens - 1e-9)


def span(text: str) -> int:
    """Words of the blocks that are compared with a template of this text."""
    return math.ceil(SPAN * len(re.findall(WORD, text.lower())))


def slim_rows(docs: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """row, doc_id, n_words, held (distinct template and phrase tokens), hits (their places), without the texts.

    ``hits`` is empty where the tokens of the whole text are too few for every template and phrase.
    """
    sets = [template_tokens(text) for _, text in templates]
    parts = [phrase.split() for phrase, _ in PHRASES]
    vocabulary = F.lit(sorted({t for s in [*sets, *parts] for t in s}))
    words = F.split(ascii_lower(F.coalesce("text", F.lit(""))), _GAP)
    # held by one row, so that no later expression splits the text again
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(words)).alias("words"))
    rows = rows.select("*", F.explode(F.array(F.array_intersect(vocabulary, "words"))).alias("held"))
    # an empty word stands before a gap at the start and after one at the end
    lead = (F.col("words")[0] == "").cast("int")
    n_words = F.size("words") - lead - F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    enough = F.lit(False)
    for tokens, least in [*((s, needed(len(s))) for s in sets), *((p, len(p)) for p in parts)]:
        enough = enough | (F.size(F.array_intersect("held", F.lit(tokens))) >= least)
    placed = F.transform("words", lambda word, at: F.struct((at - lead).alias("at"), word.alias("word")))
    hits = F.when(enough & (F.size("held") > 0), F.filter(placed, lambda x: F.array_contains("held", x["word"]))).otherwise(F.array().cast("array<struct<at:int,word:string>>"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", n_words.cast("long").alias("n_words"), "held", hits.alias("hits"))


def token_order(slim: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template tokens by the number of documents that hold them, over all documents, rarest first, then by code point."""
    n = {r["token"]: r["count"] for r in slim.select(F.explode("held").alias("token")).groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda t: (n.get(t, 0), t))


def _most_in_block() -> Column:
    """Most tokens of the template in ``span`` words in a row; 0 if it is too few.

    A block that holds the most begins at a template word, and its first ``needed`` template words lie inside the span.
    """
    hits, span = F.col("inside"), F.col("span")
    place = lambda i: F.get(hits, i)["at"]
    starts = F.filter(F.sequence(F.lit(0), F.size(hits)), lambda i: F.coalesce(place(i + F.col("needed") - 1) - place(i) < span, F.lit(False)))
    inside = lambda i: F.filter(F.slice(hits, i + 1, span), lambda x: x["at"] - place(i) < span)
    return F.coalesce(F.array_max(F.transform(starts, lambda i: F.size(F.array_distinct(inside(i)["word"])))), F.lit(0))


def matches(slim: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """row, label, containment: every template that a block of a row of ``slim_rows`` meets, with its best block.

    The join pairs whole texts with templates, which loses nothing, as a text holds the tokens of all its blocks. A pair
    appears once, at its first shared token; then the blocks of the text are compared with the template.
    """
    sets = {name: template_tokens(text) for name, text in templates}
    by_rank = token_order(slim, sorted({t for s in sets.values() for t in s}))
    index = []
    for name, text in templates:
        words = sorted(sets[name], key=by_rank.index)
        row = (name, words, needed(len(words)), span(text))
        index += [(token, at, *row) for at, token in enumerate(words[: len(words) - needed(len(words)) + 1])]
    prefix = slim.sparkSession.createDataFrame(index, "token string, word_at int, label string, words array<string>, needed int, span int")
    texts = slim.filter(F.size("hits") > 0).select("row", "hits", F.array_intersect(F.lit(by_rank), "held").alias("tokens"))
    probes = texts.select("*", F.posexplode("tokens").alias("at", "token"))
    # the index has a row per template and prefix token, whatever the corpus
    pairs = probes.join(F.broadcast(prefix), "token").filter(F.size("tokens") >= F.col("needed"))
    rest = F.least(F.size("tokens") - F.col("at"), F.size("words") - F.col("word_at"))
    earlier = F.arrays_overlap(F.slice("tokens", F.lit(1), F.col("at")), F.slice("words", F.lit(1), F.col("word_at")))
    pairs = pairs.filter((rest >= F.col("needed")) & ~earlier & (F.size(F.array_intersect("tokens", "words")) >= F.col("needed")))
    of_template = F.filter("hits", lambda x: F.array_contains(F.col("words"), x["word"]))
    blocks = pairs.select("row", "label", "words", "needed", "span", F.explode(F.array(of_template)).alias("inside"))
    found = blocks.select("row", "label", "words", "needed", F.explode(F.array(_most_in_block())).alias("shared"))
    return found.filter(F.col("shared") >= F.col("needed")).select("row", "label", (F.col("shared") / F.size("words")).alias("containment"))


def _begins(parts: list[str]) -> Column:
    """The word numbers at which these words stand one after the other."""

    def here(x: Column, i: Column) -> Column:
        found = x["word"] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            after = F.get("hits", i + k)
            found = found & (after["word"] == part) & (after["at"] == x["at"] + k)
        return F.coalesce(found, F.lit(False))

    return F.filter("hits", here)["at"]


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 with a base phrase, else the largest containment of a matching block, else 0. Null and empty texts have no
    words and no labels. Repeated rows, also of one id with other texts, and rows without id each get a result of their own.
    An empty table gives no rows. Other columns are not read.
    """
    slim = cut(slim_rows(docs, templates), "slim")
    found = matches(slim, templates).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = slim.select("row", "doc_id", "n_words", F.explode(F.array(F.struct(*[_begins(phrase.split()).alias(label) for phrase, label in PHRASES]))).alias("places"))
    joined = base.join(found, "row", "left")
    every = [F.col(f"places.{label}") for _, label in PHRASES]
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(every, PHRASES)]))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        sum(map(F.size, every), F.lit(0)).cast("long").alias("n_base"),
        F.least(*map(F.array_min, every)).cast("long").alias("first_word"),
        F.greatest(*map(F.array_max, every)).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, more))), ",").alias("labels"),
        F.when(F.size(labels) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir))


def _sql() -> str:
    """Every template against every run of so many words that begins at one of its words; other runs hold no more."""
    rows = ", ".join(f"('{name}', {template_tokens(text)!r}, {needed(len(template_tokens(text)))}, {span(text)})" for name, text in TEMPLATES)
    base = "".join(
        f"""
  SELECT r, i, '{label}' AS label FROM w, unnest(range(0, len(words))) AS u(i)
  WHERE {' AND '.join(f"words[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))} UNION ALL"""
        for phrase, label in PHRASES
    ).removesuffix(" UNION ALL")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (
  SELECT r, doc_id, regexp_extract_all(low, '{WORD}') AS words FROM d),
p AS ({base}),
t(label, tokens, needed, span) AS (VALUES {rows}),
v AS (SELECT label, needed, span, len(tokens) AS n_tokens, unnest(tokens) AS token FROM t),
o AS (SELECT r, unnest(words) AS token, generate_subscripts(words, 1) AS at FROM w),
h AS (SELECT o.r, v.label, v.needed, v.span, v.n_tokens, o.at, o.token FROM o JOIN v USING (token)),
b AS (
  SELECT x.r, x.label, x.at, any_value(x.needed) AS needed, count(DISTINCT y.token) AS shared, any_value(x.n_tokens) AS n_tokens
  FROM h x JOIN h y ON x.r = y.r AND x.label = y.label AND y.at >= x.at AND y.at < x.at + x.span GROUP BY x.r, x.label, x.at),
m AS (
  SELECT r, label, max(shared / n_tokens) AS containment FROM b WHERE shared >= needed GROUP BY r, label),
g AS (
  SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r),
e AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION ALL SELECT r, label FROM m) GROUP BY r),
s AS (
  SELECT r, max(containment) AS best FROM m GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(g.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
       CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN g USING (r) LEFT JOIN e USING (r) LEFT JOIN s USING (r)"""


ORACLES = {"op1_license_scan": _sql()}
