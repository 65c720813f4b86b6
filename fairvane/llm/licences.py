"""Licence scans: TF-IDF cosine to templates, then inheritance from ancestor directories.

Passages of a text are runs of neighbouring units (lines, and the sentences of a line) of at
most ``LONGEST`` words together, single units of any length, and the whole text.  Each is
compared with licence notices and bodies as a sparse TF-IDF vector; the most similar
template over a threshold gives the passage's licence.  Document frequencies of the
template words are counted over the whole corpus.

Only passages that hold an anchor are compared.  The anchors of a template are its
heaviest words, as many as it takes until the rest of its vector is shorter than the
threshold: a passage without any of them can't reach the threshold.  So the anchors are an
index of the templates' words and leave nothing out.

Of passages that overlap the most similar one counts, and of these of one text the most
similar gives the file's own licence; ``all_licences`` names all.  A file that is named as a
licence file, or is little but a notice, gives its licence to its directory; files without
a licence of their own inherit it from the nearest ancestor directory, found by joining
directories with their ancestors.

Defined results: null and empty texts have no own licence but may inherit one; a null
path lies in the root directory; ties of similarity go to the licence first in the
alphabet, then to the earlier and the shorter passage; of several licence files in a
directory one named as such comes first, then the most similar; repeated rows are kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text

#: Identifiers of licences and the notices they are given by.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("ISC", "Released under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. The software is provided as is, without warranty of any kind, express or implied, including but not "
        "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    (
        "Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)

TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
UNIT_END = re.compile(r"\n+|(?<=[.;])[ \t]+(?=[A-Z])")
#: Words of a passage of several units; twice the longest template has fewer.
LONGEST = 250
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright)[^/]*$"


def words_in(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in words_in(t)})


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those that hold each template word: a bounded list."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    met = F.array_intersect(F.split(F.lower(whole_text()), r"[^a-z0-9.]+"), known)
    rows = docs.select(F.explode(met).alias("word")).groupBy("word").count().collect()
    return docs.count(), {r["word"]: r["count"] for r in rows}


def units_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the lines of a text and of the sentences of each."""
    out, at = [], 0
    for m in [*UNIT_END.finditer(text), None]:
        end = len(text) if m is None else m.start()
        if words := words_in(text[at:end]):
            out.append((at, end, words))
        at = end if m is None else m.end()
    return out


def damped(count: int) -> float:
    """A word's weight for its count in a passage: repeats of common words count little."""
    return 1 + math.log(count) if count else 0.0


class Passage:
    """The cosine of a growing list of words to each template."""

    def __init__(self, matcher: Matcher):
        self.matcher, self.count, self.square = matcher, Counter(), 0.0
        self.dots = [0.0] * len(TEMPLATES)
        self.anchored = 0

    def add(self, words: list[str]) -> None:
        m = self.matcher
        for w in words:
            idf = m.idf.get(w, m.unknown)
            c = self.count[w]
            self.count[w] = c + 1
            before, after = damped(c) * idf, damped(c + 1) * idf
            self.square += after * after - before * before
            for t, weight in m.holders.get(w, ()):
                self.dots[t] += (after - before) * weight
            self.anchored += w in m.anchors

    def best(self) -> tuple[float, str]:
        """(similarity, licence); of equal ones the first in the alphabet."""
        if not self.square:
            return 0.0, ""
        norm = math.sqrt(self.square)
        return min(((-round(d / (size * norm), 9), name) for d, (name, size) in zip(self.dots, self.matcher.templates) if d), default=(0.0, ""))


class Matcher:
    """Template vectors with inverse document frequencies, and the anchors for a threshold."""

    def __init__(self, n: int, frequencies: dict[str, int], threshold: float = 0.5):
        self.threshold = threshold
        self.idf = {w: math.log((n + 1) / (frequencies.get(w, 0) + 1)) + 1 for w in vocabulary()}
        self.unknown = math.log(n + 1) + 1
        self.templates: list[tuple[str, float]] = []
        self.holders: dict[str, list[tuple[int, float]]] = {}
        self.anchors: set[str] = set()
        for t, (name, text) in enumerate(TEMPLATES):
            weights = {w: damped(c) * self.idf[w] for w, c in Counter(words_in(text)).items()}
            size = math.sqrt(sum(x * x for x in weights.values()))
            self.templates.append((name, size))
            rest = size * size
            for w, x in sorted(weights.items(), key=lambda item: (-item[1], item[0])):
                self.holders.setdefault(w, []).append((t, x))
                if math.sqrt(max(rest, 0.0)) >= (threshold - 1e-6) * size:
                    self.anchors.add(w)
                rest -= x * x

    def best(self, passage: str) -> tuple[float, str]:
        p = Passage(self)
        p.add(words_in(passage))
        cosine, name = p.best()
        return -cosine, name

    def passages(self, text: str) -> list[tuple[float, str, int, int]]:
        """(similarity, licence, start, end) of the passages that are chosen, the most similar first."""
        units = units_of(text)
        hits = [i for i, (_, _, words) in enumerate(units) if not self.anchors.isdisjoint(words)]
        if not hits:
            return []
        found = []
        starts: set[int] = set()
        for i in hits:
            size, a = len(units[i][2]), i
            starts.add(i)
            while a > 0 and size + len(units[a - 1][2]) <= LONGEST:
                a -= 1
                size += len(units[a][2])
                starts.add(a)
        for a in sorted(starts):
            p, size = Passage(self), 0
            for b in range(a, len(units)):
                size += len(units[b][2])
                if b > a and size > LONGEST:
                    break
                p.add(units[b][2])
                if p.anchored:
                    cosine, name = p.best()
                    if -cosine >= self.threshold:
                        found.append((cosine, name, units[a][0], units[b][1]))
        chosen: list[tuple[float, str, int, int]] = []
        for cosine, name, a, b in sorted(found, key=lambda f: (f[0], f[1], f[2], f[3])):
            if not any(a < d and c < b for _, _, c, d in chosen):
                chosen.append((-cosine, name, a, b))
        return chosen

    def of_text(self, text: str) -> tuple[float, str, str]:
        """(similarity, licence, passage) of the most similar passage."""
        chosen = self.passages(text)
        if not chosen:
            return 0.0, "", ""
        cosine, name, a, b = chosen[0]
        return cosine, name, text[a:b]


_OWN = "doc_id {}, path string, own_licence string, similarity double, passage_sha string, whole double, all_licences string"


def own_licences(files: DataFrame, threshold: float) -> DataFrame:
    """doc_id, path, own licence (or null), its similarity, that of the text as a whole, and all licences it names."""
    matcher = Matcher(*document_frequencies(files), threshold)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                chosen = matcher.passages(text)
                if not chosen:
                    rows.append((None, 0.0, None, 0.0, None))
                    continue
                cosine, name, a, b = chosen[0]
                sha = hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()[:16]
                rows.append((name, cosine, sha, matcher.best(text)[0], ",".join(sorted({c[1] for c in chosen}))))
            kinds = [pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("path"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[x.split()[0] for x in _OWN.split(", ")],
            )

    fields = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), whole_text().alias("text"))
    return fields.mapInArrow(match, _OWN.format(dict(fields.dtypes)["doc_id"]))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, the root ('') last, as structs of dir and depth."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above"), n.alias("depth")),
    )


def scan_licences(files: DataFrame, threshold: float = 0.5, whole_threshold: float = 0.6) -> DataFrame:
    """Own, inherited and effective licence of every file (doc_id, path, text)."""
    own = stored(own_licences(files, threshold).withColumn("dir", _directory(F.col("path"))), "licences")
    named = F.col("path").rlike(LICENCE_FILE)
    giving = (
        own.where("own_licence is not null")
        .where(named | (F.col("whole") >= whole_threshold))
        .groupBy("dir")
        .agg(F.min_by("own_licence", F.struct(~named, -F.col("similarity"), "own_licence", "path")).alias("licence"))
        .select(F.col("dir").alias("above"), "licence")
    )
    directories = own.select("dir").distinct()
    inherited = (
        directories.select("dir", F.inline(ancestors(F.col("dir"))))
        .join(giving, "above")
        .groupBy("dir")
        .agg(F.max_by(F.struct("above", "licence"), "depth").alias("nearest"))
        .select("dir", F.col("nearest.licence").alias("inherited_licence"), F.col("nearest.above").alias("inherited_from"))
    )
    # Stored, so that both sides of the join are dealt out anew and a directory that holds a
    # third of all files is split among tasks; the merge hint keeps it from being broadcast.
    joined = own.join(stored(inherited, "inherited").hint("merge"), "dir", "left")
    return joined.select(
        "doc_id",
        "path",
        "own_licence",
        "similarity",
        "passage_sha",
        F.when(F.col("own_licence").isNull(), F.col("inherited_licence")).alias("inherited_licence"),
        F.when(F.col("own_licence").isNull(), F.col("inherited_from")).alias("inherited_from"),
        F.coalesce("own_licence", "inherited_licence").alias("licence"),
        "all_licences",
    )
