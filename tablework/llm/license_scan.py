"""License scans: TF-IDF cosine to templates, then directory inheritance (operator 7).

A text's candidate stretches are runs of words that occur in some template,
with at most ``GAP`` other words between two of them, over lines and within
them; the whole text is a candidate too.  Each is a sparse TF-IDF vector compared with every
template by cosine.  Inverse document frequencies of the templates' words
are counted over all texts; any other word of a stretch weighs as a word of
one text.  A text whose words lie mostly in licence stretches is a licence
file: it licenses its directory.  A file without a licence of its own takes
that of its nearest ancestor directory, found by joining the directories of
its path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import words as W
from tablework.llm.store import materialise, prepare, table

COSINE = 0.70      # least similarity of a licence notice
SHARE = 0.5        # share of a text's words in notices that makes it a licence file
GAP = 2            # words of no template inside a stretch
LEAST = 4          # template words a stretch has at least

# Notices of public licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0"],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain."],
}


@dataclass
class Templates:
    """Templates as unit TF-IDF rows over their words."""
    vocab: np.ndarray    # sorted hashes
    idf: np.ndarray
    rare: float          # weight of a word of no template
    rows: np.ndarray     # template x word
    names: list[str]

    @classmethod
    def build(cls, templates: dict[str, list[str]], vocab: np.ndarray, df: np.ndarray, texts: int) -> "Templates":
        names = [n for n, ts in templates.items() for _ in ts]
        idf = np.log((1 + texts) / (1 + df)) + 1
        tf = np.zeros((len(names), len(vocab)))
        for i, t in enumerate(t for ts in templates.values() for t in ts):
            np.add.at(tf[i], np.searchsorted(vocab, _hashes(t)), 1)
        rows = tf * idf
        return cls(vocab, idf, math.log((1 + texts) / 2) + 1, rows / np.linalg.norm(rows, axis=1, keepdims=True), names)


def _hashes(text: str) -> np.ndarray:
    raw, offs = W.text_bytes(pa.array([text]))
    return W.split_words(raw, offs, W.ALNUM)[2]


def vocabulary(templates: dict[str, list[str]]) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for ts in templates.values() for t in ts]))


def _places(h: np.ndarray, vocab: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of template words, their numbers)."""
    may = np.flatnonzero(gate[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocab, h[may]), len(vocab) - 1)
    hit = vocab[at] == h[may]
    return may[hit], at[hit]


def _gate(vocab: np.ndarray) -> np.ndarray:
    g = np.zeros(1 << 16, bool)
    g[(vocab >> np.uint64(48)).astype(np.int64)] = True
    return g


def _frequencies(batches, vocab: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts that hold each template word, and all texts (word -1), of a task."""
    gate, df, texts = _gate(vocab), np.zeros(len(vocab), np.int64), 0
    for b in batches:
        raw, offs = W.text_bytes(b.column(0))
        texts += b.num_rows
        for i, j in W.chunks(offs):
            o = offs[i:j + 1]
            _, _, h, first = W.split_words(raw[o[0]:o[-1]], o - o[0], W.ALNUM)
            at, word = _places(h, vocab, gate)
            doc = np.searchsorted(first, at, side="right") - 1
            df += np.bincount(np.unique(doc * len(vocab) + word) % len(vocab), minlength=len(vocab))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(len(vocab))]), pa.array(np.r_[texts, df])], names=["word", "n"])


def notices(t: Templates, gate: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(text, template, cosine, share of the text's words in notices) of the
    best notice of each text that has one."""
    start, _, h, first = W.split_words(raw, offs, W.ALNUM)
    at, word = _places(h, t.vocab, gate)
    if not len(at):
        return []
    doc = np.searchsorted(first, at, side="right") - 1
    line = np.searchsorted(np.flatnonzero(raw == 10), start[at])
    apart = np.r_[True, (np.diff(at) > GAP + 1) | (doc[1:] != doc[:-1])]
    best: dict[int, tuple[float, int]] = {}
    inside: dict[int, int] = {}
    # stretches over lines, stretches within lines, whole texts
    for cut, whole in ((apart, False), (apart | np.r_[True, line[1:] != line[:-1]], False), (np.r_[True, doc[1:] != doc[:-1]], True)):
        head = np.flatnonzero(cut)
        hit: dict[int, int] = {}
        for a, b in zip(head.tolist(), np.r_[head[1:], len(at)].tolist()):
            if b - a < LEAST:
                continue
            d = int(doc[a])
            size = int(first[d + 1] - first[d]) if whole else int(at[b - 1] - at[a] + 1)
            w, n = np.unique(word[a:b], return_counts=True)
            x = n * t.idf[w]
            norm = math.sqrt(float((x * x).sum()) + (size - (b - a)) * t.rare ** 2)
            c = t.rows[:, w] @ x / norm
            k = int(c.argmax())
            if c[k] >= COSINE:
                hit[d] = hit.get(d, 0) + size
                if d not in best or (c[k], -k) > best[d]:
                    best[d] = (float(c[k]), -k)
        for d, n_words in hit.items():
            inside[d] = max(inside.get(d, 0), n_words)
    return [(d, -k, c, inside[d] / int(first[d + 1] - first[d])) for d, (c, k) in sorted(best.items())]


def scan(files: DataFrame, keep: list[str], templates: dict[str, list[str]] | None = None) -> DataFrame:
    """files (with ``text``) -> the ``keep`` columns + own_license (null where
    none), cosine and share.  Null, empty and wordless texts have none."""
    spark = files.sparkSession
    prepare(spark)
    templates = TEMPLATES if templates is None else templates
    vocab = vocabulary(templates)
    texts = files.select(F.col("text").cast("string").alias("text"))
    got = texts.mapInArrow(lambda it: _frequencies(it, vocab), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r.word: r.n for r in got}
    held = spark.sparkContext.broadcast(Templates.build(templates, vocab, np.array([n.get(i, 0) for i in range(len(vocab))]), n.get(-1, 0)))
    kept = [F.col(f"`{c}`") for c in keep]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.select(*kept).schema)

    def run(batches):
        t = held.value
        gate = _gate(t.vocab)
        for b in batches:
            raw, offs = W.text_bytes(b.column(0))
            name, cosine, share = [None] * b.num_rows, [None] * b.num_rows, [0.0] * b.num_rows
            for i, j in W.chunks(offs):
                o = offs[i:j + 1]
                for d, k, c, s in notices(t, gate, raw[o[0]:o[-1]], o - o[0]):
                    name[i + d], cosine[i + d], share[i + d] = t.names[k], c, s
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(name, pa.string()), pa.array(cosine, pa.float64()), pa.array(share)],
                                             names=[*keep, "own_license", "cosine", "share"])

    return files.select(F.col("text").cast("string").alias("text"), *kept).mapInArrow(run, ddl + "own_license string, cosine double, share double")


def inherit(scanned: DataFrame, path: str = "path") -> DataFrame:
    """scanned (path, own_license, cosine, share) -> all columns + license and
    license_from: 'file', the licensing directory, or null.

    A directory's licence is that of its licence files: the one of most of
    them, ties by higher cosine, then name.  A null path inherits nothing; a
    path without a slash lies in the root directory ''."""
    folder = F.regexp_extract(F.col(path), "^(.*)/[^/]*$", 1)
    by_folder = scanned.where((F.col("share") >= SHARE) & F.col("own_license").isNotNull() & F.col(path).isNotNull()) \
        .groupBy(folder.alias("folder"), "own_license").agg(F.count("*").alias("n"), F.max("cosine").alias("c"))
    rules = materialise(by_folder.groupBy("folder").agg(F.min(F.struct(
        -F.col("n"), -F.col("c"), F.col("own_license").alias("name"))).alias("b")).select("folder", F.col("b.name").alias("name")), "rules")
    # only the distinct directories are joined with their ancestors
    parts = F.split("folder", "/")
    up = scanned.where(F.col(path).isNotNull() & F.col("own_license").isNull()).select(folder.alias("folder")).distinct() \
        .select("folder", F.explode(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(parts)))).alias("depth")) \
        .withColumn("above", F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("depth")), "/"))
    near = up.join(rules.toDF("above", "name"), "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "name")).alias("b")) \
        .select(F.col("folder").alias("_folder"), F.col("b.above").alias("_above"), F.col("b.name").alias("_name"))
    near = materialise(near, "inherited")
    return scanned.join(near, (folder == F.col("_folder")) & F.col("own_license").isNull(), "left") \
        .withColumn("license", F.coalesce("own_license", "_name")) \
        .withColumn("license_from", F.when(F.col("own_license").isNotNull(), "file").otherwise(F.col("_above"))) \
        .drop("_folder", "_above", "_name")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every whole text of ``documents``; a document's path is
    source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                                   F.concat_ws("/", "source", "lang", "doc_id").alias("path"))
    got = materialise(scan(docs, ["doc_id", "path"]), "scanned")
    return inherit(got).select("doc_id", "path", "own_license", F.round("cosine", 6).alias("cosine"),
                               (F.col("share") >= SHARE).alias("license_file"), "license", "license_from")
