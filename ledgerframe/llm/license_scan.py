"""Licences of files, by Spark's own expressions only.

Method.  Headers (lines and paragraphs) and whole files are compared with licence
templates by the cosine of sparse TF-IDF vectors, whole files with the complete
texts in ``licenses/`` as well.  A licence file is a complete text, or a notice that
makes up a good part of its file.  A directory's licence file
licenses what lies below it: a file without a licence of its own takes that of the
nearest ancestor directory, found by joins on paths.

Document frequencies are counted over all documents; terms that no template holds
count as unseen.  By the Cauchy-Schwarz inequality a piece can only reach the
threshold if it holds one of a set of a template's terms that weigh enough together.
The terms that fewest documents hold make up that set, so nearly all other pieces are
passed over without loss.

Scale.  Two passes over the texts without moving them; only term counts (bounded by
the templates) reach the driver.  Inheritance joins distinct directories, not
files, with one licence per directory; files then meet their directory's answer,
and a directory of a third of all files is no group of its own.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from math import log, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import materialize

#: Wording of common licence notices and of the openings of licence texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


#: Complete licence texts, for whole files only.
FILE_TEMPLATES = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]

#: Licences whose complete texts differ from one above in little but their titles: that one, words of the title, name.
RETITLED = [("GPL-3.0", "gnu affero general public license", "AGPL-3.0")]
#: Words of a file in which its title is looked for.
OPENING = 60

#: Broadcast the directories' licences up to so many bytes of paths, join by shuffle beyond.
BROADCAST_BYTES = 8 << 20


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each of some terms (the templates', which are broadcast)."""
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in ["", *terms]], "term string"))
    # The empty term, added to each document, counts the documents themselves.
    held = F.array_union(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), F.array(F.lit("")))
    rows = docs.select(F.explode(held).alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found.pop("", 0), found


class _Weights:
    """Inverse document frequencies, template vectors of unit length, and anchors."""

    def __init__(self, n: int, df: dict[str, int], templates: list[tuple[str, str]], threshold: float):
        self.unseen = log(n + 1) + 1
        self.idf = {t: log((n + 1) / (df.get(t, 0) + 1)) + 1 for _, text in templates for t in _words(text)}
        self.names = [name for name, _ in templates]
        self.vectors, anchors = [], set()
        for _, text in templates:
            v = {t: k * self.idf[t] for t, k in Counter(_words(text)).items()}
            norm = sqrt(sum(x * x for x in v.values()))
            v = {t: x / norm for t, x in v.items()}
            self.vectors.append(v)
            rest = 1.0
            # Rare terms first, of those about equally rare the weightiest.
            for t, x in sorted(v.items(), key=lambda p: (df.get(p[0], 0).bit_length(), -p[1], p[0])):
                if sqrt(max(rest, 0)) < threshold:
                    break
                anchors.add(t)
                rest -= x * x
        self.anchors = sorted(anchors)

    def least_terms(self, threshold: float) -> list[int]:
        """Distinct terms of each template that a text must hold to reach the threshold."""
        out = []
        for v in self.vectors:
            mass, n = 0.0, 0
            for x in sorted(v.values(), reverse=True):
                if mass >= threshold**2 - 1e-6:
                    break
                mass, n = mass + x * x, n + 1
            out.append(n)
        return out


def _map(values: dict, kind: str = "double") -> Column:
    """A constant map of terms, as one literal to the planner."""
    return F.from_json(F.lit(json.dumps(values, sort_keys=True)), f"map<string,{kind}>")


def _array(terms: Iterable[str]) -> Column:
    """A constant array of terms (letters and digits), as one literal to the planner."""
    return F.split(F.lit(" ".join(terms)), " ")


def _best(terms: Column, w: _Weights) -> Column:
    """The best template of a piece as (score, place), by its terms.

    Only the distinct terms that some template holds are looked up; the others
    add to the length of the vector by their counts.
    """
    idf, weights = _map(w.idf), _map({t: [v.get(t, 0.0) for v in w.vectors] for t in w.idf}, "array<double>")
    present = F.array_intersect(terms, _array(sorted(w.idf)))
    count = lambda t: F.size(F.filter(terms, lambda x: x == t)).cast("double")
    held = F.transform(present, lambda t: F.struct(t.alias("term"), count(t).alias("n"), F.element_at(idf, t).alias("idf")))
    start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    step = lambda a, x: F.when(a["term"] == x, F.struct(a["term"].alias("term"), (a["n"] + 1.0).alias("n"), a["s"].alias("s"))).otherwise(F.struct(x.alias("term"), F.lit(1.0).alias("n"), (a["s"] + a["n"] * a["n"]).alias("s")))
    squares = F.aggregate(F.array_sort(terms), start, step, lambda a: a["s"] + a["n"] * a["n"])

    def scored(held: Column, squares: Column) -> Column:
        known = lambda f: F.aggregate(held, F.lit(0.0), lambda a, e: a + f(e))
        norm = F.sqrt(known(lambda e: e["n"] * e["n"] * e["idf"] * e["idf"]) + (squares - known(lambda e: e["n"] * e["n"])) * w.unseen**2)
        add = lambda a, e: F.zip_with(a, F.element_at(weights, e["term"]), lambda x, y: x + e["n"] * e["idf"] * y)
        dots = F.aggregate(held, F.array_repeat(F.lit(0.0), len(w.vectors)), add)
        return F.array_max(F.transform(dots, lambda d, i: F.struct(F.round(d / norm, 6).alias("score"), (-i).alias("place"))))

    # Through a one-element array, so that the shared parts are computed once.
    once = F.transform(F.array(F.struct(held.alias("held"), squares.alias("squares"))), lambda p: scored(p["held"], p["squares"]))
    return F.element_at(once, 1)


def scan_licenses(docs: DataFrame, path: Column | None = None, threshold: float = 0.7, file_threshold: float = 0.9, notice_share: float = 0.4, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """The licence of every file: its own, or inherited from a directory.

    ``docs`` has ``doc_id`` and ``text``; ``path`` gives a file's path with ``/``
    between names (``/source/lang/doc_id`` by default).  Returns per row doc_id,
    path, own_license and own_score (the best template of a line, paragraph or the
    whole text with a cosine of at least the threshold; the earlier template wins
    a tie; for a complete licence text that licence, by its title where only that tells it
    from another; of a file of several whole licences the nearest one), is_license_file (the whole text
    reaches ``file_threshold``, or a line or paragraph that does holds at least
    ``notice_share`` of the words of a file whose name has no extension, or that of
    plain text), license and license_from (``own``, the
    directory it is inherited from, or null).

    Nulls and empty texts: they have no licence of their own and can inherit; a null
    path, or a null source or lang in the default one, is skipped.  Very long texts
    are read whole.  Ties and repeats: of several licence files in one directory that
    with the best score counts, then the least name; rows that repeat an id are judged
    each for itself.  An empty table gives no rows.  Other columns, whatever their
    names, are not read.
    """
    templates = templates or TEMPLATES
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), (path if path is not None else F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string"))).alias("path"))
    file_templates = FILE_TEMPLATES
    vocabulary = sorted({t for _, text in [*templates, *file_templates] for t in _words(text)})
    counted = document_frequencies(docs, vocabulary)
    w = _Weights(*counted, templates, threshold)
    anchors = _array(w.anchors)
    has_anchor = lambda terms: F.arrays_overlap(terms, anchors)
    whole = _terms(F.col("text"))
    parts = F.concat(F.split("text", r"\r?\n"), F.filter(F.split("text", r"\r?\n[ \t]*\r?\n"), lambda p: p.contains("\n")))
    pieces = F.filter(F.transform(parts, _terms), has_anchor)
    gate = has_anchor(F.split(F.lower("text"), "[^a-z0-9]+"))
    scored = F.transform(pieces, lambda t: F.struct(_best(t, w).alias("best"), F.size(t).alias("words")))
    found = F.when(gate, F.struct(_best(whole, w).alias("whole"), scored.alias("pieces"), F.size(whole).alias("words")))
    complete = _Weights(*counted, file_templates, file_threshold)
    held = F.array_distinct(whole)
    enough = [F.size(F.array_intersect(held, _array(sorted(v)))) >= n for v, n in zip(complete.vectors, complete.least_terms(file_threshold), strict=True)]
    file = F.when(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), _array(complete.anchors)) & F.greatest(*enough, F.lit(False)), _best(whole, complete))
    opening = F.array_join(F.slice(whole, 1, OPENING), " ")
    rows = docs.select("doc_id", "path", found.alias("f"), F.when(file.isNotNull(), F.struct(file.alias("best"), opening.alias("opening"))).alias("file"))
    piece = F.array_max(F.transform("f.pieces", lambda p: p["best"]))
    notice = F.array_max(F.transform(F.filter("f.pieces", lambda p: p["best"]["score"] >= file_threshold), lambda p: p["words"])) >= notice_share * F.col("f.words")
    # A notice at the head of a short program is that file's alone.
    notice = notice & F.col("path").rlike(r"(^|/)[^/.]+([.](txt|md|rst))?$")
    names = F.array(*(F.lit(n) for n in w.names))
    name = lambda best: F.when(best["score"] >= threshold, F.get(names, -best["place"]))
    own = F.array_max(F.array(F.col("f.whole"), piece))
    # A complete text names the licence, whatever notice it quotes.
    is_file = F.coalesce(F.col("file.best.score") >= file_threshold, F.lit(False))
    file_name = F.get(F.array(*(F.lit(n) for n in complete.names)), -F.col("file.best.place"))
    for close_to, title, other in RETITLED:
        file_name = F.when((file_name == close_to) & F.col("file.opening").contains(title), other).otherwise(file_name)
    own_license = F.when(is_file, file_name).otherwise(name(own))
    own_score = F.when(is_file, F.col("file.best.score")).when(own["score"] >= threshold, own["score"])
    rows = rows.select("doc_id", "path", own_license.alias("own_license"), own_score.alias("own_score"), (is_file | F.coalesce(F.col("f.whole.score") >= file_threshold, F.lit(False)) | F.coalesce(notice, F.lit(False))).alias("is_license_file"))
    rows = materialize(rows.withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")), "licenses")
    return _inherited(rows)


def _inherited(rows: DataFrame) -> DataFrame:
    """Adds the licence of the nearest ancestor directory that has a licence file."""
    given = rows.filter("is_license_file AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct(-F.col("own_score"), F.col("own_license").alias("name"))).alias("best"))
    given = given.select(F.col("dir").alias("ancestor"), F.col("best.name").alias("given"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor")))
    dirs = rows.filter("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(ancestors).alias("a")).select("dir", "a.depth", "a.ancestor")
    nearest = dirs.join(given, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "given")).alias("n")).select("dir", F.col("n.ancestor").alias("from_dir"), F.col("n.given").alias("given"))
    nearest = materialize(nearest, "nearest")
    # A directory's files need not meet in one task while its answers fit a broadcast.
    size = nearest.agg(F.sum(F.octet_length("dir") + F.octet_length("from_dir") + 64)).first()[0] or 0
    out = rows.join(F.broadcast(nearest) if size <= BROADCAST_BYTES else nearest, "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "own_score", "is_license_file", F.when(own, F.col("own_license")).otherwise(F.col("given")).alias("license"), F.when(own, F.lit("own")).otherwise(F.col("from_dir")).alias("license_from"))
