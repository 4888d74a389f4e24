"""Licence scans by a positional index of rare words.

Base: the places where a phrase's words stand next to each other.  The method adds labels by template:

1. the postings of all templates list, for each licence word, (template, position in the template);
2. every text's licence words come with their positions; document frequencies of these words over all texts
   give their IDF (at most as many words as the templates have);
3. a text looks up all its licence words in the postings; a hit votes for (template, place of the
   template's first word in the text), and votes within ``SLACK`` words of each other add up, each word
   of the template once;
4. a template whose votes hold at least ``ENOUGH`` of the IDF of its own ``RARE`` rarest words is a
   candidate, whatever else the text holds; a candidate becomes a label if one of its mandatory key phrases occurs in the text.

All of it is DataFrame expressions.  A text is split once; only its licence words go on, and votes are
summed by (text, template, place), so a text that repeats one word costs in proportion to its length.

Defined cases: a null text is an empty one; a very long text is split and looked up whole; texts without words have no labels and score 0; repeated rows all
stay; an empty table gives none; other columns are ignored whatever their names.  ``score`` is 1 with a base label, else
the greatest share of IDF among the labels' templates, else 0.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomql.llm.text import LOWER, UPPER, words
from loomql.plans.scratch import cut

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Openings of public licence notices, and phrases of which one must occur.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("any person obtaining a copy", "released under the mit license")),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("licensed under the apache license", "apache license version 2 0")),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "gnu gpl")),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl")),
    "agpl": ("this program is free software under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license", "gnu agpl")),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "bsd license")),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "isc license")),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution", "licensed under cc by")),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    "bsd-3": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("names of its contributors may be used to endorse",)),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software altered source versions must be plainly marked as such", ("altered source versions must be plainly marked",)),
    "bsl": ("boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("boost software license", "person or organization obtaining a copy of the software")),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license", ("do what the fuck you want to",)),
    "cc0": ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law cc0 universal", ("cc0 1 0 universal", "dedicated the work to the public domain")),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike", "licensed under cc by sa")),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial", "licensed under cc by nc")),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ("eclipse public license",)),
    "ofl": ("this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    "gfdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("gnu free documentation license",)),
    "artistic": ("this package is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", ("artistic license",)),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("without a written agreement is hereby granted", "postgresql license")),
    "apache-notice": ("licensed under the apache license version 2 0", ("licensed under the apache license", "apache license version 2 0")),
    "cc-by-notice": ("this work is licensed under cc by 4 0", ("licensed under cc by", "license cc by")),
    "gpl-notice": ("this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    "mit-notice": ("released under the mit license", ("released under the mit license",)),
}
LABEL_OF = {"apache-notice": "apache", "cc-by-notice": "cc-by", "gpl-notice": "gpl", "mit-notice": "mit"}
#: Words too common in prose to look up.
COMMON = frozenset("a an and any are as at by can for form if in into is it may not of on or that the this to under use v with you your".split())

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE, SLACK, ENOUGH = 12, 2, 0.5
_VOTE = "array<struct<template: string, k: int>>"


def rare_words(template: str) -> list[str]:
    """A template's words that can be looked up, in order."""
    return [w for w in TEMPLATES[template][0].split() if w not in COMMON]


def looked_up() -> list[str]:
    """Words whose places are noted: the templates' rare words and the first words of phrases."""
    phrases = [*BASE, *(p for _, keys in TEMPLATES.values() for p in keys)]
    return sorted({w for t in TEMPLATES for w in rare_words(t)} | {p.split()[0] for p in phrases})


def _ascii_lower(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _stands_at(phrase: str, place: Column) -> Column:
    """Whether the words of ``phrase`` after its first follow ``place`` in the array ``w``."""
    rest = [F.coalesce(_ascii_lower(F.get(F.col("w"), place + k)) == w, F.lit(False)) for k, w in enumerate(phrase.split()[1:], 1)]
    return reduce(lambda a, b: a & b, rest)


def _noted(docs: DataFrame) -> DataFrame:
    """One row a text: word count, places of licence words, places of base phrases, templates whose key phrase occurs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text"), SEPARATOR).alias("w"))
    plain = lambda x: F.lower(x).isin(looked_up()) & (F.octet_length(x) == F.octet_length(F.lower(x)))
    hits = F.filter(F.transform("w", lambda x, i: F.when(plain(x), F.struct(i.alias("i"), F.lower(x).alias("word")))), lambda h: h.isNotNull())
    rows = rows.withColumn("hits", hits)

    def places(phrase: str) -> Column:
        head = phrase.split()[0]
        return F.transform(F.filter("hits", lambda h: (h["word"] == head) & _stands_at(phrase, h["i"])), lambda h: h["i"])

    def occurs(phrases: tuple[str, ...]) -> Column:
        return F.exists("hits", lambda h: reduce(lambda a, b: a | b, [(h["word"] == p.split()[0]) & _stands_at(p, h["i"]) for p in phrases]))

    some = F.size("hits") > 0
    found = F.array(*[F.struct(F.lit(label).alias("label"), places(p).alias("at")) for p, label in BASE.items()])
    keyed = F.array_compact(F.array(*[F.when(occurs(keys), F.lit(t)) for t, (_, keys) in TEMPLATES.items()]))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), "hits", F.when(some, found).alias("found"), F.when(some, keyed).alias("keyed")).withColumn("id", F.monotonically_increasing_id())


def _inverse_frequencies(rows: DataFrame) -> dict[str, float]:
    """IDF of each looked-up word over all texts (ln(1 + texts / texts with the word))."""
    n = rows.count()
    df = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").count().collect()
    return {w: math.log(1 + n) for w in looked_up()} | {r["word"]: math.log(1 + n / r["count"]) for r in df}


def _votes(rows: DataFrame, idf: dict[str, float]) -> DataFrame:
    """(id, template, share): the greatest share of a template's rare IDF that stands in place."""
    index: dict[str, list[tuple[str, int]]] = {}
    for t in TEMPLATES:
        for k, w in enumerate(TEMPLATES[t][0].split()):
            if w not in COMMON:
                index.setdefault(w, []).append((t, k))
    words_of = {t: sorted([(w, idf[w]) for w in dict.fromkeys(rare_words(t))], key=lambda x: (-x[1], x[0]))[:RARE] for t in TEMPLATES}
    total = {t: sum(v for _, v in x) for t, x in words_of.items()}
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(w, float(idf[w]), [{"template": t, "k": k} for t, k in at]) for w, at in index.items()], f"word string, idf double, at {_VOTE}"))
    totals = F.broadcast(spark.createDataFrame([(t, float(v)) for t, v in total.items()], "template string, total double"))
    hits = rows.where("size(hits) > 0").select("id", F.explode("hits").alias("h"))
    votes = hits.join(table, F.col("h.word") == F.col("word")).select("id", "h.i", "word", "idf", F.explode("at").alias("v")).select("id", "word", "idf", F.col("v.template").alias("template"), (F.col("i") - F.col("v.k")).alias("start"))
    width = 2 * SLACK + 2  # two votes within SLACK share a cell of one of two grids
    cells = F.explode(F.array(F.struct(F.lit(0).alias("g"), F.floor(F.col("start") / width).alias("c")), F.struct(F.lit(1).alias("g"), F.floor((F.col("start") + SLACK + 1) / width).alias("c")))).alias("cell")
    in_cell = votes.select("id", "template", "word", "idf", cells).groupBy("id", "template", "cell", "word").agg(F.max("idf").alias("idf"))
    best = in_cell.groupBy("id", "template", "cell").agg(F.sum("idf").alias("held")).groupBy("id", "template").agg(F.max("held").alias("held"))
    return best.join(totals, "template").select("id", "template", F.least(F.lit(1.0), F.col("held") / F.col("total")).alias("share"))


def scan(docs: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for every row of ``docs``.

    ``matches`` lists the accepted templates with their shares.
    """
    rows = cut(_noted(docs))
    shares = _votes(rows, _inverse_frequencies(rows))
    candidates = shares.where(F.col("share") >= enough)
    accepted = candidates.join(rows.where("size(keyed) > 0").select("id", "keyed"), "id").where(F.array_contains("keyed", F.col("template")))
    label = F.create_map(*[F.lit(x) for t in TEMPLATES for x in (t, LABEL_OF.get(t, t))])
    matched = accepted.groupBy("id").agg(F.array_sort(F.collect_set(F.element_at(label, F.col("template")))).alias("added"), F.max("share").alias("share"), F.array_sort(F.collect_list(F.struct("template", "share"))).alias("matches"))
    out = rows.select("id", "doc_id", "n_words", "found").join(matched, "id", "left")
    places = F.coalesce(F.flatten(F.transform("found", lambda x: x["at"])), F.array().cast("array<int>"))
    base = F.coalesce(F.transform(F.filter("found", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]), F.array().cast("array<string>"))
    out = out.withColumn("places", places).withColumn("base", F.array_sort(F.array_distinct(base)))
    return out.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "matches",
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")
