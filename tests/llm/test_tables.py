"""Fingerprints, mixing and license scans against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockline.llm import digest, licenses, mixing
from tests.llm import brute

DIGEST = "doc_id long, text string, part string, tail string, _th string"


def test_entropy_levels_match_counting():
    pick = random.Random(2)
    texts = ["".join(pick.choice("abcdefgh ij") for _ in range(n)).encode() for n in (0, 1, 63, 64, 65, 200, 500, 0)] + [("é" * 70).encode()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    laid = digest.Padded(np.frombuffer(b"".join(texts), np.uint8), offsets)
    levels = laid.levels()
    seen = 0
    for start, text in zip(laid.starts, texts, strict=True):
        for at in range(len(text) - 63):
            entropy = -sum(c / 64 * math.log2(c / 64) for c in Counter(text[at : at + 64]).values())
            assert abs(levels[start + at] - entropy / 6 * 1000) <= 1.01
            seen += 1
    assert seen == (levels >= 0).sum()


def test_likeness():
    none, one = np.zeros((0, 256), np.uint8), np.full((1, 256), 3, np.uint8)
    assert digest.likeness(none, none) == 1 and digest.likeness(none, one) == 0 and digest.likeness(one, one) == 1
    other = np.full((1, 256), 12, np.uint8)
    assert digest.likeness(one, other) == 0
    assert digest.likeness(np.concatenate([one, other]), other) == 1


def test_fingerprints_match_the_plain_edit(spark):
    pick = random.Random(6)
    docs = [(k * 7 % 61, "".join(pick.choice("abcdefghij klmnopqrst uvwé.\n") for _ in range(pick.choice([3, 40, 300, 3000, 30000]))))
            for k in range(61)]
    docs += [(100, None), (101, ""), (102, "a" * 5000), (103, docs[4][1]), (None, "first of all " * 30)]
    df = spark.createDataFrame([(*d, "a", "b", "c") for d in docs], DIGEST).repartition(3)
    got = {r.doc_id: r for r in digest.fingerprints(df).collect()}
    ordered = sorted(docs, key=lambda d: -1 if d[0] is None else d[0])
    assert len(got) == len(docs)
    for k, (name, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = got[name]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        if len(text) >= 3000 and len(set(text)) > 10:
            assert row.near_edited > 0.5
    assert got[103].fingerprint == got[docs[4][0]].fingerprint
    assert got[100].fingerprint == got[101].fingerprint == ""


def test_short_and_periodic_texts_have_fingerprints_of_their_own(spark):
    pick = random.Random(8)
    texts = ["".join(pick.choice("abcdefghij klmnopqrst uvw.") for _ in range(n)) for n in range(64, 151)]
    texts += ["a" * 5000, "0123456789" * 300, "xy" * 40, "-=" * 60]
    texts += ["".join(pick.choice("abcdefghij klmnopqrst uvw.") for _ in range(60000))]
    docs = [d for k, t in enumerate(texts) for d in ((2 * k, t), (2 * k + 1, "".join(pick.choice("ABCDEFGHIJ KLMNOPQRS") for _ in range(64 + k))))]
    df = spark.createDataFrame([(*d, "", "", "") for d in docs], DIGEST).repartition(3)
    got = {r.doc_id: r for r in digest.fingerprints(df).collect()}
    assert all(r.fingerprint and r.edited_fingerprint for r in got.values())
    assert max(r.near_next for r in got.values()) < 0.5
    plain = [got[2 * k] for k in range(87)]
    assert all(r.near_edited < 1 for r in plain) and sum(r.near_edited > 0.1 for r in plain) >= 80


def test_fingerprints_of_repeated_rows_one_row_and_an_empty_table(spark):
    rows = [(1, "one text of some length", "", "", "")] * 2
    got = digest.fingerprints(spark.createDataFrame(rows, DIGEST)).collect()
    assert len(got) == 2 and len({r.fingerprint for r in got}) == 1 and all(r.near_next == 1 for r in got)
    assert len(digest.fingerprints(spark.createDataFrame(rows[:1], DIGEST)).collect()) == 1
    assert digest.fingerprints(spark.createDataFrame([], DIGEST)).collect() == []


MIX = "doc_id long, text string, lang string, source string, tokens string, whole string"
WEIGHTS = {"domain": {"web": 0.5, "books": 4.0}, "lang": {"en": 2.0, "xx": 0.0}, "source": {"s1": 3.0}}


def _domain():
    return F.when(F.col("source").isin("s1", "s2"), "web").when(F.col("source") == "s3", "books").otherwise("other")


@pytest.mark.parametrize(("share", "epochs", "per_slice"), [(0.3, 1, 4096), (0.9, 2, 5), (3.0, 4, 3), (9.0, 2, 4096)])
def test_mixture_matches_the_plain_version(spark, monkeypatch, share, epochs, per_slice):
    monkeypatch.setattr(mixing, "SLICE_DOCUMENTS", per_slice)
    pick = random.Random(epochs)
    docs = [(k, "w " * pick.choice([0, 1, 5, 40]), pick.choice(["en", "de", "xx", None]), pick.choice(["s1", "s1", "s1", "s2", "s3", "s4", None]))
            for k in range(150)]
    docs += [(200, None, "en", "s3"), (201, "big " * 3000, "en", "s4")]
    df = spark.createDataFrame([(*d, "a", "b") for d in docs], MIX).repartition(4)
    out = mixing.mixed(df, weights=WEIGHTS, domain=_domain(), budget_share=share, max_epochs=epochs, seed=3)
    got = {r.doc_id: r.copies for r in out.collect()}
    rows = [(k, "web" if s in ("s1", "s2") else "books" if s == "s3" else "other", la or "", s or "", len(brute.words(t))) for k, t, la, s in docs]
    assert got == brute.mixture(rows, WEIGHTS, share, epochs, 3)


def test_mixture_of_repeated_rows_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s1", "", "")] * 3 + [(None, "c", "en", "s1", "", "")], MIX)
    got = [tuple(r) for r in mixing.mixed(df, weights={}, domain=_domain(), budget_share=1.0, max_epochs=1).select("doc_id", "copies").collect()]
    assert sorted(got, key=str) == [(1, 1)] * 3 + [(None, 1)]
    assert mixing.mixed(spark.createDataFrame([], MIX), weights={}, domain=_domain()).collect() == []


FILES = "path string, text string, license_name string, dir string, salt string, _key string"


def _cosine(text):
    weights, rare = licenses.term_weights()
    own = {t: n * weights.get(t, rare) for t, n in licenses.terms_of(text).items()}
    size = math.sqrt(sum(v * v for v in own.values()))
    found = [(round(sum(own.get(t, 0) * v for t, v in vector.items()) / size, 6) if size else 0, -k, name)
             for k, name, vector in licenses.template_vectors()]
    return max(found)


def test_licenses_match_the_plain_version_and_inherit(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("a/LICENSE", "words before\n" + mit), ("a/x.txt", "nothing here"), ("a/b/c/y.txt", "the and of to\nin it"),
        ("a/b/COPYING.txt", gpl), ("a/b/z.txt", "text\n" + mit + "\nmore text"), ("top.txt", "no"), ("q/w.txt", None), (None, "x"),
        ("q/e.txt", ""), ("a/b/c/d/e/deep.txt", "x\n" * 50), ("other/file.txt", gpl), ("other/n.txt", "released the hounds under license of work"),
        ("other/long.txt", "w " * 20_000 + "\nLicensed under CC BY-NC 4.0"), ("a/x.txt", "nothing here"),
    ]
    df = spark.createDataFrame([(*f, "a", "b", "c", "d") for f in files], FILES).repartition(3)
    out = licenses.scanned(df)
    got = {r.path: (r.license, r.license_by, r.license_from) for r in out.collect()}
    assert len(out.collect()) == len(files) and {"license_name", "dir", "salt", "_key"} <= set(out.columns)
    assert got["a/LICENSE"] == ("MIT", "file", None)
    assert got["a/x.txt"] == ("MIT", "inherited", "a/LICENSE")
    assert got["a/b/c/y.txt"] == got["a/b/c/d/e/deep.txt"] == ("GPL-3.0", "inherited", "a/b/COPYING.txt")
    assert got["a/b/z.txt"] == ("MIT", "header", None)
    assert got["other/n.txt"] == ("GPL-3.0", "inherited", "other/file.txt")
    assert got["other/long.txt"] == ("CC-BY-NC-4.0", "header", None)
    assert got["top.txt"] == got["q/w.txt"] == got[None] == got["q/e.txt"] == (None, None, None)
    assert licenses.scanned(spark.createDataFrame([], FILES)).collect() == []


WRAPPED = {
    "MIT": """/*
 * Copyright (c) 2015 Jane Doe
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 */""",
    "BSD-3-Clause": """# Copyright 2011 Foo Corp. All rights reserved.
#
# Redistribution and use in source and binary forms, with or
# without modification, are permitted provided that the following
# conditions are met:""",
    "GPL-3.0": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "Apache-2.0": """; Licensed under the
; Apache License, Version
; 2.0 (the "License"); you may not
; use this file except in compliance
; with the License.""",
}


def test_wrapped_headers_above_other_text(spark):
    body = "\n\nimport os\n" + "\n".join(f"value{i} = compute(item{i})  # work for later" for i in range(80))
    files = [(f"{name}/{k}.py", lead + header + body) for name, header in WRAPPED.items() for k, lead in enumerate(("", "#!/bin/env tool\nmore words here\n"))]
    files += [("none/a.py", "the general public may use this software free of charge under the terms" + body), ("none/b.py", "permission license copy software" + body)]
    df = spark.createDataFrame([(*f, None, None, None, None) for f in files], FILES).repartition(3)
    got = {r.path: (r.license, r.license_by) for r in licenses.scanned(df).collect()}
    assert got == {p: (None, None) if p.startswith("none") else (p.split("/")[0], "header") for p, _ in files}


def test_statements_among_other_words_of_a_line(spark):
    files = [("MIT/a.c", "// Copyright 2020 Foo Corp. Released under the MIT License"),
             ("Apache-2.0/b.c", "Copyright (c) 2015 Jane Doe. Licensed under the Apache License, Version 2.0")]
    df = spark.createDataFrame([(p, t + "\nint main;\n", None, None, None, None) for p, t in files], FILES)
    got = {r.path: (r.license, r.license_score, r.license_by) for r in licenses.scanned(df).collect()}
    assert got == {p: (p.split("/")[0], 1.0, "header") for p, _ in files}


def test_license_filter_loses_no_match(spark):
    pick = random.Random(1)
    pool = sorted({t for _, text in licenses.TEMPLATES for t in licenses.terms_of(text)}) + ["foo", "bar"]
    texts = [" ".join(pick.choices(pool, k=pick.randint(0, 9))) for _ in range(200)]
    texts += [" ".join(w for w in text.split() if pick.random() < 0.8) for _, text in licenses.TEMPLATES for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "_key long, text string")
    got = {r._key: (r.score, -r.template, r.license) for r in licenses.best_matches(df).filter("unit = -1").collect()}
    assert got == {k: c for k, t in enumerate(texts) if (c := _cosine(t))[0] >= licenses.THRESHOLD}
    assert len(got) > 20


def test_only_units_that_may_match_are_shuffled(spark):
    lines = ["Released under the MIT License", "released the hounds under license of work", "the general public may use this software"]
    df = spark.createDataFrame([(k, "\n".join([line] + [f"word{k} software license"] * 50)) for k, line in enumerate(lines * 5)], "_key long, text string")
    seen = []
    plain = licenses._scored

    def scored(terms, templates, threshold):
        seen.append(terms.select("_key", "unit").distinct().count())
        return plain(terms, templates, threshold)

    licenses._scored = scored
    try:
        got = {(r._key, r.unit, r.license) for r in licenses.best_matches(df.union(df)).collect()}
    finally:
        licenses._scored = plain
    assert got == {(k, 0, "MIT") for k in range(0, 15, 3)}
    assert seen == [10]  # of 780 units: the first line and the whole of the five texts with a statement
