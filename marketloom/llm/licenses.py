"""License scan: phrases in place, and an exact containment join of text blocks with templates.

A document's words are cut into overlapping blocks, twice as long as the longest
template of a size class, so any passage of a template's length lies whole in one
block. A block and a template join where the block holds the needed part of the
template's distinct tokens. The join follows prefix, length and positional
filters: tokens stand in one order for all, the rarest in the corpus first; a
template that needs o of its t tokens must share one of its first t - o + 1 with
the first b - o + 1 of a block of b tokens; blocks of fewer than o tokens are
too short; and a shared token at place i of one and j of the other leaves at
most min(t - i, b - j) in common. What passes is counted exactly.

Tokens that stand in no template cannot change an overlap, so blocks keep the
others only. Documents of the same tokens in the same places are looked at once.
Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.binding import bind
from marketloom.llm.common import text_of
from marketloom.session import stored

#: Words are runs of digits, letters and of anything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Phrases whose places are counted, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Customary notices of public licenses.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
NUM, DEN = 9, 10  # least part of a template's distinct tokens a block must hold
SMALLEST = 8  # words of the smallest size class


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    span: int  # size class: a power of two, its number of words at least
    need: int  # tokens a block must share

    @property
    def tokens(self) -> list[str]:
        return sorted(set(self.words))


def templates(notices: tuple[tuple[str, str], ...] = TEMPLATES, num: int = NUM, den: int = DEN) -> list[Template]:
    """The notices as token sets; one without words is left out."""
    found = []
    for i, (label, text) in enumerate(notices):
        words = tuple(w for w in re.split(NOT_WORD + "+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w)
        if words:
            span = max(SMALLEST, 1 << (len(words) - 1).bit_length())
            found.append(Template(i, label, words, span, -(-num * len(set(words)) // den)))
    return found


def _words(text: Column) -> Column:
    """Words with A-Z as a-z. The Kelvin sign, the one other letter whose small form is ASCII alone, is kept apart."""
    folded = F.lower(F.replace(text, F.lit("K"), F.lit("κ")))
    return F.array_remove(F.split(folded, NOT_WORD + "+"), "")


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively; looked for only in texts that hold the phrase."""
    parts = phrase.split()
    here = lambda w, i: F.when(
        (w == parts[0]) & (F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase), i.cast("bigint")
    )
    some = F.array_compact(F.transform(words, here))
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), some).otherwise(F.array().cast("array<bigint>"))


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def token_counts(docs: DataFrame, tokens: list[str], text_col: str = "text") -> DataFrame:
    """(token, holding): how many documents hold each token."""
    shared = F.array_intersect(_words(text_of(text_col)), _literals(tokens))
    return docs.select(F.explode(shared).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("holding"))


def _scanned(docs: DataFrame, id_col: str, text_col: str, tokens: list[str], leading: list[str]) -> DataFrame:
    """Per row: n_words, the places of every phrase, and where template tokens stand, if it holds a leading one."""

    def measured(words: Column) -> Column:
        spots = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("token")))
        hits = F.when(F.arrays_overlap(words, _literals(leading)), F.filter(spots, lambda x: x["token"].isin(tokens)))

        def found(joined: Column) -> Column:
            return F.struct(*[_places(words, joined, p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)])

        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            bind(found, joined=F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).alias("at"),
            hits.alias("hits"),
        )

    v = bind(measured, words=_words(text_of(text_col)))
    return docs.select(F.col(id_col).alias("doc_id"), v.alias("v")).select("doc_id", "v.*")


def _blocks(hits: DataFrame, spans: list[int], rank: DataFrame) -> DataFrame:
    """(key, span, block, ranks): the distinct template tokens of each block, rarest first."""
    spot = hits.select("key", F.explode("hits").alias("h")).select("key", "h.pos", "h.token").join(rank, "token")
    spot = spot.withColumn("span", F.explode(F.array(*[F.lit(s) for s in spans])))
    at = F.floor(F.col("pos") / F.col("span")).cast("bigint")
    spot = spot.withColumn("block", F.explode(F.array(at, at - 1)))
    return spot.groupBy("key", "span", "block").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))


def containment_join(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, block, label, containment) of all blocks and templates that reach the needed overlap.

    ``blocks`` has (key, span, block, ranks) and ``wanted`` (span, label, need,
    t_ranks), where ranks are ascending arrays of token numbers in the common
    order. Each pair may come out several times, once per shared leading token.
    """
    index = wanted.select("*", F.posexplode(F.expr("slice(t_ranks, 1, size(t_ranks) - need + 1)")).alias("i", "rank"))
    spots = blocks.select("*", F.posexplode("ranks").alias("j", "rank"))
    t, b = F.size("t_ranks"), F.size("ranks")
    near = spots.join(index, ["span", "rank"]).filter(
        (b >= F.col("need")) & (F.col("j") <= b - F.col("need")) & (F.least(t - F.col("i"), b - F.col("j")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("ranks", "t_ranks"))
    return near.filter(shared >= F.col("need")).select("key", "block", "label", (shared / t).alias("containment"))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    notices: tuple[tuple[str, str], ...] = TEMPLATES,
    num: int = NUM,
    den: int = DEN,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base columns tell the places of PHRASES. ``labels`` adds the labels of
    templates of which a block holds ``num`` / ``den`` of the tokens. ``score`` is 1
    where a phrase stands, else the greatest containment found, else 0. A null or
    empty text has no words, null places, empty labels and score 0. Rows and
    identifiers, null and repeated ones too, stay as they come; an empty table
    gives no rows; other columns are ignored. The driver holds the distinct
    tokens of the templates, whatever the corpus.
    """
    spark = docs.sparkSession
    wanted = templates(notices, num, den)
    tokens = sorted({t for w in wanted for t in w.tokens})
    holding = {r.token: r.holding for r in token_counts(docs, tokens, text_col).collect()}
    rank = {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (holding.get(t, 0), t)))}
    ranked = [(w, sorted(rank[t] for t in w.tokens)) for w in wanted]
    names = sorted(rank, key=rank.get)
    leading = sorted({names[r] for w, ranks in ranked for r in ranks[: len(ranks) - w.need + 1]})

    rows = stored(_scanned(docs, id_col, text_col, tokens, leading), "licenses")
    held = rows.filter("hits IS NOT NULL").withColumn("key", F.sha2(F.to_json("hits"), 256))
    hits = held.groupBy("key").agg(F.first("hits").alias("hits"))
    numbers = spark.createDataFrame(list(rank.items()), "token string, rank int")
    table = spark.createDataFrame(
        [(w.span, w.label, w.need, ranks) for w, ranks in ranked], "span int, label string, need int, t_ranks array<int>"
    )
    found = containment_join(_blocks(hits, sorted({w.span for w in wanted}), numbers), table)
    found = stored(
        found.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")), "license-labels"
    )
    plain = rows.filter("hits IS NULL").drop("hits")
    none = {"more": F.lit(None).cast("array<string>"), "best": F.lit(None).cast("double")}
    judged = held.drop("hits").join(found, "key", "left").drop("key").unionByName(plain.withColumns(none))

    at = [F.col(f"at.p{i}") for i in range(len(PHRASES))]
    every = F.concat(*at)
    labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, (_, label) in zip(at, PHRASES)])))
    added = F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>"))))
    return judged.select(
        "doc_id",
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(added, ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """The definition itself: every phrase at every word, every block with every template."""
    wanted = templates()
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"('{w.label}', {w.span}, {listed(w.tokens)})" for w in wanted)
    phrases = ", ".join(f"('{label}', {listed(p.split())})" for p, label in PHRASES)
    return rf"""
WITH template(label, span, tokens) AS (VALUES {rows}), phrase(label, parts) AS (VALUES {phrases}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (SELECT r, words, unnest(range(len(words))) AS i FROM d), place AS (
  SELECT w.r, w.i, p.label FROM w JOIN phrase p ON w.words[w.i + 1 : w.i + len(p.parts)] = p.parts
), base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY r
), block AS (
  SELECT r, span, list_distinct(words[b * span + 1 : (b + 2) * span]) AS part FROM (
    SELECT r, words, span, unnest(range(len(words) // span + 1)) AS b FROM d, (SELECT DISTINCT span FROM template))
), hit AS (
  SELECT r, list(DISTINCT label) AS labels, max(n / t) AS best FROM (
    SELECT r, label, len(list_intersect(part, tokens)) AS n, len(tokens) AS t FROM block JOIN template USING (span))
  WHERE {DEN} * n >= {NUM} * t GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hit.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN hit USING (r)
"""


ORACLE = _oracle()
