"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Each line of a text (a header statement) and the text as a whole (a licence file)
is a sparse TF-IDF vector; terms the templates lack weigh as the rarest. The
best template at or above the threshold names the licence. Where neither says
anything, every stretch of the text's terms as long as a template is compared with
it, over line ends and inside lines, so a wrapped header or a statement among other
words counts as well. A text without a statement of its own inherits from the nearest ancestor directory that holds a
licence file.

DataFrame functions only. A vector of cosine >= t to a template must share enough
of its heavy terms: the terms of a template that can be dropped leave a rest of
norm below t, so a text with none of the others cannot match. Only texts with
such a term are split into terms, and nothing that could match is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import settled

THRESHOLD = 0.8
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = "[a-z0-9]+"
FILE_NAME = r"(^|/)(licen[cs]e|copying)[^/]*$"

COMMON = frozenset(
    "a any and are as be by can can't either except for form found free from general in is it later may not of on or "
    "person public source subject that the this to under use v version with work you style files file".split())

# fixed values: the wording of public licence statements
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def terms_of(text: str) -> Counter:
    return Counter(re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER))))


def term_weights(templates=TEMPLATES) -> tuple[dict[str, float], float]:
    """Inverse document frequency of each template term, and of any other term."""
    seen = Counter(term for _, text in templates for term in terms_of(text))
    number = len(templates)
    return {t: math.log((1 + number) / (1 + n)) + 1 for t, n in sorted(seen.items())}, math.log(1 + number) + 1


def template_vectors(templates=TEMPLATES) -> list[tuple[int, str, dict[str, float]]]:
    """(number, licence, unit vector) of each template."""
    weights, _ = term_weights(templates)
    out = []
    for number, (name, text) in enumerate(templates):
        raw = {t: n * weights[t] for t, n in sorted(terms_of(text).items())}
        size = math.sqrt(sum(v * v for v in raw.values()))
        out.append((number, name, {t: v / size for t, v in raw.items()}))
    return out


def needed_terms(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Terms of which a matching text holds at least one.

    Per template, terms are dropped while what is dropped has a norm below the
    threshold: first those common in prose, then the lightest.
    """
    keep: set[str] = set()
    for _, _, vector in template_vectors(templates):
        dropped = 0.0
        for term, value in sorted(vector.items(), key=lambda x: (x[0] not in COMMON, x[1], x[0])):
            dropped += value * value
            if math.sqrt(dropped) >= threshold - 1e-9:
                keep.add(term)
    return sorted(keep)


def _folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _share(number: int) -> Column:
    held = F.filter("shares", lambda s: s["template"] == number)
    return F.get(held, F.lit(0))["share"]


def _hint(templates, threshold: float) -> Column:
    return F.lit("(?<![a-z0-9])(?:" + "|".join(needed_terms(templates, threshold)) + ")(?![a-z0-9])")


def _shapes(templates) -> Column:
    """Number of terms and unit vector of each template."""
    return F.array(*[
        F.struct(F.lit(sum(terms_of(text).values())).alias("size"),
                 F.array(*[F.struct(F.lit(t).alias("term"), F.lit(v).alias("share")) for t, v in vector.items()]).alias("entries"))
        for (_, text), (_, _, vector) in zip(templates, template_vectors(templates), strict=True)])


def _reaches(entries: Column, present: Column, threshold: float) -> Column:
    """Whether a cosine at the threshold is possible: it is at most the norm of the shares of the terms present."""
    held = F.filter(entries, lambda e: F.array_contains(present, e["term"]))
    return F.aggregate(held, F.lit(0.0), lambda total, e: total + e["share"] * e["share"]) >= threshold * threshold - 1e-6


def _split(texts: DataFrame, templates, *columns: str) -> DataFrame:
    """`columns`, the terms of the text and those of them that templates have."""
    # each explode of one element keeps what it holds from being computed again inside a lambda
    split = texts.select(*columns, F.explode(F.array(F.regexp_extract_all("text", F.lit(f"({TERM})")))).alias("terms"))
    known = F.array(*[F.lit(t) for t in term_weights(templates)[0]])
    return split.select(*columns, "terms", F.explode(F.array(F.array_intersect("terms", known))).alias("present"))


def best_matches(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(_key, unit, template, license, score) of each unit's best template; unit -1 is the whole text.

    `files` has _key and text; rows of one key are one text. Ties go to the first template.
    Units are left out by the bound on their terms, so only those that may match are shuffled.
    """
    hint = _hint(templates, threshold)
    texts = files.select("_key", _folded("text").alias("text")).filter(F.regexp_like("text", hint))
    lines = texts.select("_key", F.posexplode(F.split("text", "\n", -1)).alias("unit", "text")).filter(F.regexp_like("text", hint))
    units = lines.unionByName(texts.select("_key", F.lit(-1).alias("unit"), "text"))
    fitting = _split(units, templates, "_key", "unit").filter(
        F.exists(_shapes(templates), lambda s: _reaches(s["entries"], F.col("present"), threshold)))
    terms = fitting.dropDuplicates(["_key", "unit"]).select("_key", "unit", F.explode("terms").alias("term"))
    return _scored(terms, templates, threshold)


def _scored(terms: DataFrame, templates, threshold: float) -> DataFrame:
    """(_key, unit, template, license, score) of the units of (_key, unit, term) that reach the threshold."""
    spark = terms.sparkSession
    weights, rare = term_weights(templates)
    counted = terms.groupBy("_key", "unit", "term").agg(F.count("*").alias("n"))
    # both tables are as long as the templates' terms
    known = spark.createDataFrame(sorted(weights.items()), "term string, idf double")
    entries = [(t, number, value) for number, _, vector in template_vectors(templates) for t, value in vector.items()]
    vectors = spark.createDataFrame(entries, "term string, template int, share double").groupBy("term").agg(
        F.sort_array(F.collect_list(F.struct("template", "share"))).alias("shares"))
    weighed = counted.join(F.broadcast(known), "term", "left").join(F.broadcast(vectors), "term", "left").select(
        "_key", "unit", (F.col("n") * F.coalesce("idf", F.lit(rare))).alias("w"), "shares")
    sums = [F.sum(F.col("w") * F.col("w")).alias("square")]
    for number in range(len(templates)):
        sums.append(F.sum(F.col("w") * F.coalesce(_share(number), F.lit(0.0))).alias(f"dot{number}"))
    scored = weighed.groupBy("_key", "unit").agg(*sums)
    cosines = F.array(*[
        F.struct(F.round(F.col(f"dot{k}") / F.sqrt("square"), 6).alias("score"), F.lit(-k).alias("place")) for k in range(len(templates))])
    names = F.array(*[F.lit(name) for name, _ in templates])
    best = scored.select("_key", "unit", F.array_max(cosines).alias("best")).filter(F.col("best.score") >= threshold)
    return best.select(
        "_key", "unit", (-F.col("best.place")).alias("template"),
        F.get(names, -F.col("best.place")).alias("license"), F.col("best.score").alias("score"))


def stretch_matches(files: DataFrame, stated: DataFrame | None = None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """As best_matches, for every run of as many terms as a template has; unit is that of the run's place.

    The cosine to a template is at most the norm of its shares of the terms that are
    present, and a match holds a needed term. Texts and runs are left out by these
    two bounds only, so nothing that could match is lost. Texts whose _key is in `stated`
    are left out; the bounds go first, so only texts that pass them are shuffled.
    """
    needed = F.array(*[F.lit(t) for t in needed_terms(templates, threshold)])
    texts = files.select("_key", _folded("text").alias("text")).filter(F.regexp_like("text", _hint(templates, threshold)))
    split = _split(texts, templates, "_key")
    fitting = split.select("_key", "terms", F.filter(
        _shapes(templates), lambda s: _reaches(s["entries"], F.col("present"), threshold)).alias("shapes"))
    fitting = fitting.filter(F.size("shapes") > 0)
    if stated is not None:
        fitting = fitting.join(stated.select("_key").distinct(), "_key", "left_anti")
    fitting = fitting.dropDuplicates(["_key"]).select("_key", "terms", F.explode("shapes").alias("shape"))
    places = F.filter(F.transform("terms", lambda t, i: F.when(F.array_contains(needed, t), i + 1)), lambda p: p.isNotNull())
    size, last = F.col("shape.size"), F.greatest(F.lit(1), F.size("terms") - F.col("shape.size") + 1)
    starts = F.flatten(F.transform(places, lambda p: F.sequence(
        F.least(last, F.greatest(F.lit(1), p - size + 1)), F.least(p, last))))
    runs = fitting.select("_key", "shape", "terms", F.array_distinct(starts).alias("starts"))
    runs = runs.select("_key", "shape", F.explode(F.transform("starts", lambda s: F.struct(
        s.alias("at"), F.slice("terms", s, F.col("shape.size")).alias("run")))).alias("r"))
    runs = runs.filter(_reaches(F.col("shape.entries"), F.col("r.run"), threshold))
    # two templates of one length share their runs
    unit = F.col("r.at").cast("long") * (max(sum(terms_of(text).values()) for _, text in templates) + 1) + size
    units = runs.select("_key", unit.alias("unit"), F.col("r.run").alias("run")).dropDuplicates(["_key", "unit"])
    return _scored(units.select("_key", "unit", F.explode("run").alias("term")), templates, threshold)


def scanned(files: DataFrame, *, path: str = "path", text: str = "text", templates=TEMPLATES,
            threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `files` but the text, and: license, license_score, license_by, license_from.

    license_by is `header` (a line of the text, or a stretch as long as a template where
    no line and not the whole text is a statement), `file` (the text as a whole, or a
    file named LICENSE or COPYING with a statement), `inherited` (from the licence
    file license_from in the nearest ancestor directory) or null. Of several lines
    the best counts, then the first; of several licence files of a directory the
    best, then the first path. A null path inherits nothing; a null text has no
    statement; repeated rows get equal results; an empty table gives no rows.
    """
    key = F.struct(F.col(f"`{path}`").cast("string").alias("p"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"))
    rest = [F.col(f"`{c}`") for c in files.columns if c != text]
    rows = files.select(F.struct(*rest).alias("_row"), key.alias("_key"))
    texts = files.select(key.alias("_key"), F.col(f"`{text}`").cast("string").alias("text"))
    found = settled(best_matches(texts, templates, threshold))
    runs = stretch_matches(texts, found, templates, threshold)
    found = found.withColumn("unit", F.col("unit").cast("long")).unionByName(runs)
    own = found.groupBy("_key").agg(
        F.max(F.when(F.col("unit") < 0, F.struct("score", (-F.col("template")).alias("t"), "license"))).alias("whole"),
        F.max(F.when(F.col("unit") >= 0, F.struct("score", (-F.col("unit")).alias("u"), "license"))).alias("line"),
    )
    named = F.regexp_like(F.lower(F.col("_key.p")), F.lit(FILE_NAME))
    is_file = F.col("whole").isNotNull() | F.coalesce(named, F.lit(False))
    # the licence of a licence file is that of the whole, else of its best line
    score = F.when(F.col("whole").isNotNull(), F.col("whole.score")).otherwise(F.col("line.score"))
    license = F.when(F.col("whole").isNotNull(), F.col("whole.license")).otherwise(F.col("line.license"))
    own = settled(own.select("_key", license.alias("license"), score.alias("score"), is_file.alias("is_file")))

    folder = F.regexp_replace("_key.p", "/?[^/]*$", "")
    holders = own.filter("is_file AND _key.p IS NOT NULL").select(folder.alias("dir"), "license", "score", F.col("_key.p").alias("from"))
    holders = holders.groupBy("dir").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "from", "license")).alias("h"))
    parts = F.split("dir", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = rows.filter("_key.p IS NOT NULL").select(folder.alias("dir")).distinct()
    # a file at the top lies in '', which is above every directory
    climbs = folders.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("up"))
    nearest = climbs.join(holders.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.max(F.struct(F.length("up").alias("depth"), "up", "h")).alias("n")).select("dir", "n.h")
    # one directory may hold a third of all files: its row is repeated and its files are salted
    spread = nearest.select("dir", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.join(own, "_key", "left").withColumn("dir", folder).withColumn(
        "salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(spread, ["dir", "salt"], "left")
    stated = F.col("license").isNotNull()
    return joined.select(
        "_row.*",
        F.coalesce("license", "h.license").alias("license"),
        F.coalesce(F.col("score"), -F.col("h.s")).alias("license_score"),
        F.when(stated & F.col("is_file"), "file").when(stated, "header").when(F.col("h").isNotNull(), "inherited").alias("license_by"),
        F.when(~stated | F.col("license").isNull(), F.col("h.from")).alias("license_from"),
    )
