"""Licence scans against a plain reading of the base rules, and planted notices."""

import math
import re

import pytest
from llm.conftest import prose, texts_of

from loomql.llm import op6_licenses as op


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in op.BASE.items():
        p = phrase.split()
        at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(df):
    rows = op.scan(df).collect()
    got = sorted((repr(r["doc_id"]), *r[1:6]) for r in rows)
    assert got == sorted(((repr(i), *plain(t)) for i, t in texts_of(df)), key=repr) or sorted(got, key=repr) == sorted(((repr(i), *plain(t)) for i, t in texts_of(df)), key=repr)
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    return rows


def test_base_columns(spark, docs, odd, empty):
    check(docs)
    check(odd)
    assert op.scan(empty).count() == 0


def test_base_edges(spark):
    texts = ["MIT license, mit LICENSE; cc-by cc by", "mit.license", "mitlicense mit licenses", "éMIT license", "apache\nlicense", "GNU General\tPublic--License", "cc cc by by", "Key mit license", "license mit"]
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


NOTICES = {
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "lgpl": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
}


@pytest.mark.parametrize("label", list(NOTICES))
def test_the_method_adds_labels(spark, rng, label):
    texts = [prose(rng, 50) for _ in range(30)] + [f"{prose(rng, 20)}\n{NOTICES[label]}\n{prose(rng, 20)}", "the license of this software is free"]
    rows = {r["doc_id"]: r for r in op.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert rows[30]["labels"] == label and rows[30]["score"] >= 0.5 and rows[30]["base_labels"] == ""
    assert all(rows[i]["labels"] == "" and rows[i]["score"] == 0 for i in rows if i != 30)


def test_every_notice_of_a_text_counts(spark, rng):
    full = f"{prose(rng, 40)} ".join(op.TEMPLATES[t][0] + " " for t in op.TEMPLATES)
    some = f"{NOTICES['mit']} {prose(rng, 30)} {NOTICES['bsd']} {prose(rng, 30)} {NOTICES['mpl']} {prose(rng, 30)} {NOTICES['isc']}"
    rows = op.scan(spark.createDataFrame([(0, full), (1, some), *[(i, prose(rng, 50)) for i in range(2, 20)]], "doc_id long, text string")).collect()
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[0] == ",".join(sorted({op.LABEL_OF.get(t, t) for t in op.TEMPLATES})) and labels[1] == "bsd,isc,mit,mpl"
    assert not any(labels[i] for i in range(2, 20))


def test_scattered_words_and_missing_key_phrases_do_not_count(spark):
    scattered = " and ".join(NOTICES["mpl"].split()[::-1])
    no_key = NOTICES["mpl"].replace("Mozilla Public License", "Mozilla Private License")
    rows = op.scan(spark.createDataFrame([(0, scattered), (1, no_key), (2, "mozilla " * 3000)], "doc_id long, text string")).collect()
    assert all(r["labels"] == "" for r in rows)


def brute_labels(texts):
    """Labels by the module's rule, one text after the other."""
    words = [[w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] for t in texts]
    listed = set(op.looked_up())
    n, df = len(texts), {}
    for ws in words:
        for w in set(ws) & listed:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(1 + n / df[w]) if w in df else math.log(1 + n) for w in listed}
    holds = lambda ws, phrase: any(ws[i : i + len(phrase.split())] == phrase.split() for i in range(len(ws)))
    out = []
    for ws in words:
        found = {label for phrase, label in op.BASE.items() if holds(ws, phrase)}
        for t, (text, keys) in op.TEMPLATES.items():
            cells = {}
            for i, w in enumerate(ws):
                for k, x in enumerate(text.split()):
                    if w == x and w not in op.COMMON:
                        width = 2 * op.SLACK + 2
                        for cell in ((0, (i - k) // width), (1, (i - k + op.SLACK + 1) // width)):
                            cells.setdefault(cell, {})[w] = idf[w]
            total = sum(sorted((idf[w] for w in set(op.rare_words(t))), reverse=True)[: op.RARE])
            if max((sum(c.values()) for c in cells.values()), default=0) >= op.ENOUGH * total and any(holds(ws, key) for key in keys):
                found.add(op.LABEL_OF.get(t, t))
        out.append(",".join(sorted(found)))
    return out


def test_labels_by_brute_force(spark, docs, rng):
    planted = [f"{prose(rng, 30)} {text} {prose(rng, 30)}" for text, _ in op.TEMPLATES.values()] + list(NOTICES.values())
    cut = [" ".join(t.split()[: rng.randint(20, 60)]) for t in planted]
    swapped = [" ".join(w if rng.random() < 0.8 else "river" for w in t.split()) for t in planted]
    texts = [t for _, t in texts_of(docs)] + planted + cut + swapped + [None, "", "license " * 50]
    rows = op.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == dict(enumerate(brute_labels(texts)))


def test_native(spark, docs):
    assert "Python" not in op.scan(docs)._jdf.queryExecution().executedPlan().toString()
