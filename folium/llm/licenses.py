"""License scans with a positional rare-token index (operator 1).

One pass counts in how many documents each licence word stands, over all
documents; a template's anchors are its words of highest inverse document
frequency. The second pass looks up the anchors that a file has: every posting
(template, place in it) of an anchor at a word position votes for the template
at the position minus the place, so that postings are intersected by relative
position. A template that enough anchors agree on is accepted if all its
mandatory key phrases stand where it was placed, give or take a few words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import schema, table, text_or_empty

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 in lower case: what isn't ASCII counts as part of a word
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


# The texts of public licences and of their notices, and phrases that each has to hold.
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
NO_WARRANTY = """The software is provided "as is", without warranty of any kind, express or implied, including but not
limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall
the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract,
tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the
software."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:"""
BSD_SOURCE = """Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer."""
BSD_BINARY = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
BSD_END = """This software is provided by the copyright holders and contributors "as is" and any express or implied
warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular
purpose are disclaimed."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. The software is
provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties
of merchantability and fitness."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details."""
GPL_2_TERMS = """You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium,
provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of
warranty; keep intact all the notices that refer to this License and to the absence of any warranty"""
GPL_3_TERMS = """You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that
you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices
stating that this License and any non-permissive terms added in accord with section 7 apply to the code"""
LGPL_NOTICE = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version {} of the License, or (at your
option) any later version."""
AGPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License {}
which accompanies this distribution, and is available at"""
CDDL = """The contents of this file are subject to the terms of the Common Development and Distribution License (the
"License"). You may not use this file except in compliance with the License."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
CC = "This work is licensed under a Creative Commons Attribution{} International License"
TEMPLATES = (
    Template("mit-notice", "released under the MIT License", ("under the MIT License",)),
    Template("mit-notice", "licensed under the MIT License", ("under the MIT License",)),
    Template("mit-grant", GRANT.partition(", including")[0], ("Permission is hereby granted, free of charge", "to deal in the Software without restriction")),
    Template("mit-text", f"{GRANT} {NO_WARRANTY}", ("to deal in the Software without restriction", "shall be included in all copies or substantial portions", "without warranty of any kind", "use or other dealings in the software")),
    Template("mit-warranty", NO_WARRANTY, ("without warranty of any kind", "In no event shall the authors or copyright holders be liable", "use or other dealings in the software")),
    Template("isc", ISC, ("with or without fee is hereby granted", "this permission notice appear in all copies", "disclaims all warranties with regard to this software")),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0", ("under the Apache License, Version 2.0",)),
    Template("apache-2.0", APACHE, ("except in compliance with the License", "apache.org/licenses/LICENSE-2.0", "permissions and limitations under the License")),
    Template("gpl-2.0", "licensed under the GNU General Public License version 2", ("GNU General Public License version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License version 3", ("GNU General Public License version 3",)),
    Template("gpl-2.0", GPL_NOTICE.format(2), ("under the terms of the GNU General Public License", "either version 2 of the License", "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE")),
    Template("gpl-3.0", GPL_NOTICE.format(3), ("under the terms of the GNU General Public License", "either version 3 of the License", "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE")),
    Template("gpl-2.0-terms", GPL_2_TERMS, ("copy and distribute verbatim copies of the Program's source code", "notices that refer to this License and to the absence of any warranty")),
    Template("gpl-3.0-terms", GPL_3_TERMS, ("convey verbatim copies of the Program's source code", "non-permissive terms added in accord with section 7")),
    Template("lgpl-2.1", LGPL_NOTICE.format("2.1"), ("GNU Lesser General Public License", "either version 2.1 of the License")),
    Template("lgpl-3.0", LGPL_NOTICE.format(3), ("GNU Lesser General Public License", "either version 3 of the License")),
    Template("agpl-3.0", "licensed under the GNU Affero General Public License version 3", ("GNU Affero General Public License",)),
    Template("agpl-3.0", AGPL_NOTICE, ("GNU Affero General Public License", "either version 3 of the License")),
    Template("bsd", BSD_GRANT, ("Redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("bsd-2-clause", f"{BSD_GRANT} {BSD_SOURCE} {BSD_BINARY} {BSD_END}", ("Redistributions of source code must retain", "Redistributions in binary form must reproduce", "materials provided with the distribution. This software is provided by")),
    Template("bsd-3-clause", f"{BSD_GRANT} {BSD_SOURCE} {BSD_BINARY} {BSD_NAMES} {BSD_END}", ("Redistributions of source code must retain", "Redistributions in binary form must reproduce", "to endorse or promote products derived from this software")),
    Template("mpl-2.0", MPL, ("subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file")),
    Template("epl-1.0", EPL.format("v1.0"), ("terms of the Eclipse Public License v1.0",)),
    Template("epl-2.0", EPL.format("2.0"), ("terms of the Eclipse Public License 2.0",)),
    Template("cddl-1.0", CDDL, ("subject to the terms of the Common Development and Distribution License", "except in compliance with the License")),
    Template("bsl-1.0", BOOST, ("to any person or organization obtaining a copy of the software", "to use, reproduce, display, distribute, execute, and transmit the Software")),
    Template("zlib", ZLIB, ("Permission is granted to anyone to use this software for any purpose", "must not be misrepresented; you must not claim that you wrote", "may not be removed or altered from any source distribution")),
    Template("unlicense", UNLICENSE, ("free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute")),
    Template("cc-by-4.0", CC.format(" 4.0"), ("Creative Commons Attribution 4.0 International License",)),
    Template("cc-by-sa-4.0", CC.format("-ShareAlike 4.0"), ("Creative Commons Attribution-ShareAlike 4.0 International License",)),
)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Index:
    """Postings of the anchors of templates, given the document frequency of every licence word."""

    def __init__(self, templates: tuple[Template, ...], base: dict[str, str], seen: dict[bytes, int], total: int, anchors: int = 6, agree: int = 2, slack: int = 3):
        idf = lambda w: math.log((total + 1) / (seen.get(w, 0) + 1))
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.labels, self.words, self.keys, self.need, self.slack = [], [], [], [], []
        for t, template in enumerate(templates):
            words = words_of(template.text)
            rare = set(sorted(set(words), key=lambda w: (-idf(w), words.index(w)))[:anchors])
            for place, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, place))
            self.labels.append(template.label)
            self.words.append(words)
            self.keys.append([(_first(words, key), key) for key in map(words_of, template.keys)])
            self.need.append(min(agree, len(rare)))
            self.slack.append(max(slack, len(words) // 12))
        self.base = [(label, words_of(phrase)) for label, phrase in sorted(base.items())]
        self.starts = defaultdict(list)
        for label, phrase in self.base:
            self.starts[phrase[0]].append((label, phrase))
        self.telling = set(self.postings) | set(self.starts)

    def scan(self, text: str) -> dict:
        """n_words, places (label, word) of base phrases, spans (label, first word, words, share) of templates.

        Where a template is accepted at several places that overlap, the one
        with the largest share of its words counts, of equal ones the first.
        """
        words = words_of(text)
        places, spans = [], set()
        if not self.telling.isdisjoint(words):
            votes: dict[tuple[int, int], set] = defaultdict(set)
            for i, w in enumerate(words):
                if w in self.telling:
                    for label, phrase in self.starts.get(w, ()):
                        if words[i : i + len(phrase)] == phrase:
                            places.append((label, i))
                    for t, place in self.postings.get(w, ()):
                        votes[t, i - place].add(w)
            found: dict[int, list[tuple[float, int]]] = defaultdict(list)
            for (t, at), who in votes.items():
                if len(who) >= self.need[t] and self._keys_stand(words, t, at):
                    found[t].append((-self._share(words, t, at), at))
            for t, some in found.items():
                kept: list[int] = []
                for share, at in sorted(some):
                    if all(abs(at - k) >= len(self.words[t]) for k in kept):
                        kept.append(at)
                        spans.add((self.labels[t], max(0, at), len(self.words[t]), -share))
        return {"n_words": len(words), "places": places, "spans": sorted(spans)}

    def _share(self, words: list[bytes], t: int, at: int) -> float:
        """Which part of a template's words stands about where it was placed."""
        around = Counter(words[max(0, at - self.slack[t]) : max(0, at + len(self.words[t]) + self.slack[t])])
        mine = Counter(self.words[t])
        return (mine & around).total() / mine.total()

    def _keys_stand(self, words: list[bytes], t: int, at: int) -> bool:
        slack = self.slack[t]
        for place, phrase in self.keys[t]:
            low = at + place
            if not any(words[k : k + len(phrase)] == phrase for k in range(max(0, low - slack), low + slack + 1)):
                return False
        return True


def _first(words: list[bytes], phrase: list[bytes]) -> int:
    """Where a phrase stands first in a template, which has to hold it."""
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def document_frequencies(docs: DataFrame, words: frozenset[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many of all documents each of ``words`` stands, and how many documents there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = Counter(), 0
        for b in batches:
            for t in b.column(0):
                n.update(words & set(words_of(t.as_py())))
                total += 1
        rows = [*n.items(), (b"", total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

    counts = docs.select(text_or_empty(text).alias("t")).mapInArrow(run, schema("word binary, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    got = {bytes(r["word"]): r["n"] for r in counts.collect()}  # as many rows as templates have words, and one
    return got, got.pop(b"", 0)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_words, places (label, word), spans (label, word, words, share).

    A null or empty text has no words, places or spans. Rows that repeat are
    scanned each; an empty table gives no rows. Of words with equal document
    frequency the one that stands first in a template is the rarer anchor.
    Other columns of ``docs`` don't come out. The key keeps its name, so it can't
    be called like one of the results.
    """
    if key in ("n_words", "places", "spans"):
        raise ValueError(f"a key can't be called {key}")
    vocabulary = frozenset(w for t in templates for w in words_of(t.text))
    index = Index(templates, base, *document_frequencies(docs, vocabulary, text))
    kind = docs.schema[key].dataType.simpleString()
    spec = f"k {kind}, n_words long, places array<struct<label string, word long>>, spans array<struct<label string, word long, words long, share double>>"
    places = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    spans = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [index.scan(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([g["n_words"] for g in got], pa.int64()),
                    pa.array([[{"label": a, "word": i} for a, i in g["places"]] for g in got], places),
                    pa.array([[{"label": a, "word": i, "words": n, "share": s} for a, i, n, s in g["spans"]] for g in got], spans),
                ],
                ["k", "n_words", "places", "spans"],
            )

    return docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(run, schema(spec)).withColumnRenamed("k", key)


def op1_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score: the largest share of a verified template's words found in place, 0.5 for base phrases alone, else 0."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda x: x["label"]), F.transform("spans", lambda x: x["label"]))))
    where = F.transform("places", lambda x: x["word"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(where).alias("first_word"), F.array_max(where).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.when(F.size("places") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op1_rare_token_index": op1_rare_token_index}
ORACLE_SQL: dict[str, str] = {}
