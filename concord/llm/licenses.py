"""License scans by diagonal voting.

Templates of license notices are cut into word k-grams. Every place of a document whose k-gram stands in a template votes, by a
Spark join on the gram, for the diagonal (document place minus template place) of that template; votes are counted by diagonal,
neighbouring diagonals are merged to bridge small insertions and deletions, and each span so found is verified against the words
of the template. Fixed base phrases are located exactly beside it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise, pieces, whole_id

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Usual notices of public licenses, as their publishers word them, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "lgpl-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "bsl-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "public-domain": ["This is free and unencumbered software released into the public domain."],
}

#: Template k-grams that are sent to every task at most.
MAX_BROADCAST = 1_000_000

#: ASCII letters lower-cased; other ASCII but digits and letters becomes a blank. Bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def license_words(text: bytes | str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, as UTF-8."""
    return ((text.encode() if isinstance(text, str) else text) or b"").translate(_FOLD).split() if text else []


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> dict[str, list[int]]:
    """Word places at which the words of each phrase stand one after the other, overlaps included."""
    line = b" " + b" ".join(words) + b" "
    out = {}
    for phrase in phrases:
        needle = b" " + phrase.encode() + b" "
        at, places, words_before, seen = line.find(needle), [], 0, 0
        while at >= 0:
            words_before += line.count(b" ", seen, at)
            seen = at
            places.append(words_before)
            at = line.find(needle, at + 1)
        out[phrase] = places
    return out


def template_grams(templates: dict[str, list[str]], k: int) -> list[tuple[int, str, int, int, int]]:
    """(gram, label, template, place, words of the template) of every k-gram of every template."""
    out, n = [], 0
    for label in sorted(templates):
        for text in templates[label]:
            words = license_words(text)
            out += [(gram_hash(words[i : i + k]), label, n, i, len(words)) for i in range(len(words) - k + 1)]
            n += 1
    return out


def gram_hash(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 7) - (1 << 63)


def scan_words(docs: DataFrame, templates: list[list[bytes]], k: int, base: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """One row for each row of ``docs``: its base places, and the places and hashes of its rolling k-grams that can be in a template.

    A k-gram with a word that no template has cannot be in one, which is decided from the word alone; all others are hashed.
    """
    vocabulary = frozenset(w for words in templates for w in words)
    probe = re.compile(b"|".join(re.escape(p.split()[0].encode()) for p in base)) if base else None

    def run(batches):
        for b in pieces(batches):
            out = []
            for t in b.column(2).to_pylist():
                words = license_words(t)
                n = len(words)
                found = phrase_places(words, base) if t and probe and probe.search(t.translate(_FOLD)) else {}
                places = sorted(p for ps in found.values() for p in ps)
                held = np.fromiter(map(vocabulary.__contains__, words), bool, n)
                runs = held[: n - k + 1].copy() if n >= k else np.zeros(0, bool)
                for j in range(1, k):
                    runs &= held[j : n - k + 1 + j]
                at = np.flatnonzero(runs).tolist()
                out.append((n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted({base[p] for p, x in found.items() if x})), [{"at": i, "gram": gram_hash(words[i : i + k])} for i in at]))
            n, nb, first, last, labels, got = zip(*out) if out else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(nb, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(labels, pa.string()), pa.array(got, pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())])))],
                ["uid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), whole_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return materialise(rows.mapInArrow(run, "uid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, grams array<struct<at int, gram long>>"), "licenses")


def vote(grams: DataFrame, templates: DataFrame, k: int, gap: int = 4, near: int = 8, least: float = 0.6) -> DataFrame:
    """(uid, label, template, start, end, coverage): verified spans, from ``grams(uid, at, gram)`` and ``templates(gram, label, template, place, words)``.

    Votes are counted by (document, template, diagonal). Diagonals at most ``gap`` apart whose places are at most ``near`` words
    apart are merged; a span stands if its votes cover ``least`` of the template's k-grams, each template place counted once.
    Up to ``MAX_BROADCAST`` k-grams of templates are broadcast, more are joined by a shuffle.
    """
    small = templates.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    votes = grams.join(F.broadcast(templates) if small else templates, "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    lanes = votes.groupBy("uid", "label", "template", "words", "diagonal").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.collect_set("place").alias("places"))
    by = Window.partitionBy("uid", "template").orderBy("diagonal", "start")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > gap) | (F.col("start") - F.lag("end").over(by) > near + F.col("words")) | F.lag("diagonal").over(by).isNull()
    merged = lanes.withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("span", F.sum("new").over(by))
    spans = merged.groupBy("uid", "label", "template", "words", "span").agg(F.min("start").alias("start"), (F.max("end") + k).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hits"))
    covered = spans.withColumn("coverage", F.col("hits") / (F.col("words") - k + 1))
    return covered.where(F.col("coverage") >= least).select("uid", "label", "template", "start", "end", "coverage")


def scan(docs: DataFrame, k: int = 3, least: float = 0.6, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row of ``docs``.

    ``labels`` joins the base labels and those of verified template spans, distinct and sorted. ``score`` is the best coverage of
    a template, 1 where a base phrase stands, else 0. ``spans`` is an array of (label, start, end, coverage), in words.
    Null and empty texts have no words, no places and empty labels. Repeated rows and rows with a null id are kept one to one. Other
    columns are ignored; an empty table gives an empty result.
    """
    templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
    rows_of = template_grams(templates, k)
    rows = scan_words(docs, [license_words(t) for texts in templates.values() for t in texts], k, base, id_col, text_col)
    held = docs.sparkSession.createDataFrame(rows_of, "gram long, label string, template int, place int, words int")
    spans = vote(rows.select("uid", F.inline("grams")), held, k, least=least)
    by = spans.groupBy("uid").agg(F.collect_list(F.struct("label", "start", "end", "coverage")).alias("spans"), F.max("coverage").alias("best"))
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.coalesce(F.transform("spans", lambda x: x["label"]), F.array().cast("array<string>"))))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.drop("grams").join(by, "uid", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), F.coalesce("spans", F.array().cast(by.schema["spans"].dataType)).alias("spans"))
