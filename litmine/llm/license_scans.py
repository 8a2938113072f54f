"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a line of a document, or any run of as many consecutive words, across line
breaks, as the longest template has; so a notice is found however it is wrapped.  A
template is the words of a license notice.  A block holds a template if it has at least
THRESHOLD of the template's distinct words (containment).  The join is exact and filters
in the usual order:

* tokens are ordered by how many blocks of the corpus have them, rarest first;
* prefix: a block that holds a template of t tokens shares one of the template's
  first t - need + 1 tokens, and that within its own first tokens;
* length: it has at least ``need`` template tokens;
* position: what stands after the shared token, on either side, must suffice.

Runs of words are looked at around such tokens only, as a run that holds a template has
one of them; first all words that a run with the token could have, then each run.

Only words that occur in templates count; others can't add to a containment.
DataFrame functions only.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm.common import table
from litmine.llm.decontamination import plain_words

THRESHOLD = (9, 10)

#: Phrases of the query and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Short notices and sentences of public licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]


def _need(size: int) -> int:
    return ceil(size * THRESHOLD[0] / THRESHOLD[1])


def _lines(docs: DataFrame, any_of: list[str]) -> DataFrame:
    """(row, line, words): the lines of documents that have one of the words, as distinct words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = "|".join(sorted(map(re.escape, any_of)))
    near = docs.filter(text.rlike(f"(?i)(?<![a-z0-9])(?:{some})(?![a-z0-9])")) if any_of else docs.limit(0)
    lines = near.select("doc_id", "text_hash", F.explode(F.split(text, "\n")).alias("line")).filter(F.col("line").rlike(f"(?i)(?<![a-z0-9])(?:{some})(?![a-z0-9])"))
    return lines.select("doc_id", "text_hash", F.array_distinct(plain_words(F.col("line"))).alias("words"))


def _runs(docs: DataFrame, any_of: list[str], run: int) -> DataFrame:
    """(row, token, around, at): each place of one of the words in a text of several lines.

    ``around`` has the words from run - 1 before the token to run - 1 after it, the token
    standing at ``at`` from 1.
    """
    some = "|".join(sorted(map(re.escape, any_of)))
    near = docs.filter(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{some})(?![a-z0-9])") & F.col("text").contains("\n")) if any_of else docs.limit(0)
    words = near.select("doc_id", "text_hash", plain_words(F.col("text")).alias("w"))
    spots = F.filter(F.transform("w", lambda w, i: F.when(w.isin(any_of), i + 1)), lambda i: i.isNotNull())
    first = lambda i: F.greatest(i - run + 1, F.lit(1))
    seen = F.transform(spots, lambda i: F.struct(F.element_at("w", i).alias("token"), F.slice("w", first(i), i - first(i) + run).alias("around"), (i - first(i) + 1).alias("at")))
    return words.select("doc_id", "text_hash", F.explode(seen).alias("s")).select("doc_id", "text_hash", "s.*")


def template_links(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, text_hash, label, score): templates that a line or a run of words holds.

    ``docs``: (doc_id, text_hash, text).  ``score`` is the best containment.
    """
    sets = {name: sorted(set(_words(text))) for name, text in templates}
    vocabulary = sorted(set().union(*sets.values()))
    only = F.array(*map(F.lit, vocabulary))
    # a line below every template's need in words it shares with the vocabulary is out already
    least = min(_need(len(s)) for s in sets.values())
    counted = (
        docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
        .filter(F.col("line") != "")
        .select(F.explode(F.array_intersect(plain_words(F.col("line")), only)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    n = {r.token: r.n for r in counted.collect()}  # a row per template word
    place = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (n.get(t, 0), t)))}
    prefixes = []
    for name, tokens in sets.items():
        tokens = sorted(tokens, key=place.__getitem__)
        need = _need(len(tokens))
        prefixes += [(name, place[t], k, len(tokens), need, [place[x] for x in tokens]) for k, t in enumerate(tokens[: len(tokens) - need + 1])]
    heads = docs.sparkSession.createDataFrame(prefixes, "label string, token int, tpos int, tsize int, need int, tokens array<int>")
    names = {i: t for t, i in place.items()}
    wanted = sorted({names[p[1]] for p in prefixes})
    number = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    blocks = _lines(docs, wanted).select(
        "doc_id", "text_hash", F.array_sort(F.transform(F.array_intersect("words", only), lambda w: number[w])).alias("block")
    ).filter(F.size("block") >= least).distinct()
    posted = blocks.select("doc_id", "text_hash", "block", F.posexplode("block").alias("bpos", "token"))
    near = posted.join(F.broadcast(heads), "token").filter(
        (F.size("block") >= F.col("need"))
        & (F.col("bpos") <= F.size("block") - F.col("need"))
        & (F.least(F.size("block") - F.col("bpos"), F.col("tsize") - F.col("tpos")) + F.least("bpos", "tpos") >= F.col("need"))
    )
    both = F.size(F.array_intersect("block", "tokens"))
    lines = near.filter(both >= F.col("need")).select("doc_id", "text_hash", "label", (both / F.col("tsize")).alias("score"))
    run = max(len(_words(text)) for _, text in templates)
    whole = docs.sparkSession.createDataFrame(
        [(name, names[t], len(sets[name]), need, sorted(sets[name])) for name, t, _, _, need, _ in prefixes], "label string, token string, tsize int, need int, tokens array<string>"
    )
    around = _runs(docs, wanted, run).join(F.broadcast(whole), "token").filter(F.size(F.array_intersect("around", "tokens")) >= F.col("need"))
    most = F.array_max(F.transform(F.sequence(F.lit(1), "at"), lambda i: F.size(F.array_intersect(F.slice("around", i, run), F.col("tokens")))))
    runs = around.withColumn("most", most).filter(F.col("most") >= F.col("need")).select("doc_id", "text_hash", "label", (F.col("most") / F.col("tsize")).alias("score"))
    return lines.unionByName(runs).groupBy("doc_id", "text_hash", "label").agg(F.max("score").alias("score"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Positions, from 0, at which a phrase's words stand one after the other."""
    parts = _words(phrase)

    def starts(i: Column) -> Column:
        here = F.lit(True)
        for k, w in enumerate(parts):
            here = here & (F.get(words, i + k) == w)
        return here

    room = F.size(words) - len(parts)
    return F.when(room >= 0, F.filter(F.sequence(F.lit(0), room), starts)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 with a phrase, else the best containment of a held template, else 0.
    Null and empty texts have no words, places or labels; repeated rows get equal
    results; an empty table gives an empty one.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    held = template_links(rows)
    held = held.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    held = held.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "more", "best")
    none = F.array().cast("array<int>")
    # a text without the phrase's rarest word has no place of it
    maybe = F.coalesce(F.col("text").rlike(r"(?i)mit[^a-z0-9]+license|apache[^a-z0-9]+license|cc[^a-z0-9]+by"), F.lit(False))
    words = plain_words(F.col("text"))
    base = rows.select("doc_id", "text_hash", F.size(words).cast("long").alias("n_words"), F.when(maybe, words).alias("w"))
    base = base.select("doc_id", "text_hash", "n_words", *[F.when(F.col("w").isNotNull(), phrase_places(F.col("w"), p)).otherwise(none).alias(f"at{k}") for k, (p, _) in enumerate(PHRASES)])
    places = F.concat(*[F.col(f"at{k}") for k in range(len(PHRASES))])
    has = F.filter(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    out = base.select("doc_id", "text_hash", "n_words", places.alias("at"), F.array_sort(F.array_distinct(has)).alias("base"))
    out = out.join(held, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


_TEMPLATE_SQL = ", ".join(f"('{name}', '{' '.join(_words(text))}')" for name, text in TEMPLATES)
_PHRASE_SQL = ", ".join(f"('{label}', '{phrase}')" for phrase, label in PHRASES)
OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
phrases AS (SELECT label, string_split(p, ' ') AS p FROM (VALUES {_PHRASE_SQL}) v(label, p)),
templates AS (SELECT label, list_distinct(string_split(p, ' ')) AS p FROM (VALUES {_TEMPLATE_SQL}) v(label, p)),
base AS (
  SELECT r, label, i FROM (SELECT r, w, unnest(range(0, len(w))) AS i FROM w), phrases WHERE w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p
), b AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY r
), lines AS (
  SELECT r, list_distinct(regexp_extract_all(l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS s FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
), held AS (
  SELECT r, label, len(list_intersect(s, p)) / len(p) AS score FROM lines, templates WHERE len(s) > 3 AND 10 * len(list_intersect(s, p)) >= 9 * len(p)
), h AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM held GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(h.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(h.score, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b ON w.r = b.r LEFT JOIN h ON w.r = h.r
"""
