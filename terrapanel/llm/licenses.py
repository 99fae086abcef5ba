"""Licence scans with a positional index of rare words.

Licence templates are word sequences with mandatory key phrases.  The words'
document frequencies are counted over the whole corpus; the index holds every
template word's postings: template, key phrase, position.

Of a file, the licence words that it has are ranked by rarity.  A template all
of whose key phrases' words are there is looked up by the file's two rarest
words of one key phrase: their postings are intersected by relative position,
that is, the two must stand as far apart as in the phrase (a phrase of one word
has one posting).  Where they agree, every mandatory phrase is verified word
for word: the first one fixes the place, the others stand within SLACK words of
where the template has them.  A place's score is the share of the template's
words, weighted by rarity, that stand where the template has them.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, with
A-Z lower-cased.

Defined results: a null text counts as empty; files without words or places
have no spans and score 0; of equally rare words the first in byte order is
looked up; repeated rows are scanned alike; a very long text is scanned whole,
by itself, in memory that grows with its words; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    """``keys``: mandatory phrases, in the order in which ``text`` has them."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: Fixed phrases: each counts wherever its words stand consecutively.
BASE = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)
#: Lines that refer to well-known licences.
REFERENCES = (
    Template("mit-reference", "released under the mit license", ("under the mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Wording of whole licences and of the headers that files carry.
WORDINGS = (
    Template(
        "mit-whole",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge", "to deal in the software without restriction", "the above copyright notice and this permission notice"),
    ),
    Template(
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce"),
    ),
    Template(
        "bsd-3-clause",
        """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the
        name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
        ("redistributions in binary form must reproduce", "contributors may be used to endorse or promote products", "without specific prior written permission"),
    ),
    Template(
        "isc-whole",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        ("for any purpose with or without fee is hereby granted", "permission notice appear in all copies"),
    ),
    Template(
        "apache-2.0-header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        ("apache license version 2 0", "you may not use this file except in compliance", "unless required by applicable law"),
    ),
    Template(
        "gpl-header",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
        ("you can redistribute it and or modify it", "published by the free software foundation", "distributed in the hope that it will be useful"),
    ),
    Template(
        "mpl-2.0-header",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file"),
    ),
    Template(
        "unlicense-whole",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute"),
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely.""",
        ("in no event will the authors be held liable", "permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"),
    ),
)
TEMPLATES = (*BASE, *REFERENCES, *WORDINGS)
#: Words of a key phrase whose postings are intersected.
PROBES = 2
#: Words by which key phrases after the first may be away from where the template has them.
SLACK = 12

#: A-Z to a-z; every other ASCII character that is no letter or digit to a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those with each word of the vocabulary; counted over all documents."""
    vocabulary = frozenset(vocabulary)

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0):
                found.update(vocabulary.intersection(words_of(t.as_py())))
            found[b""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # as many rows as the vocabulary has words
    counts = {bytes(r.word): r.n for r in rows}
    return counts.pop(b"", 0), counts


class RareWordIndex:
    """Postings of each template's key phrases; and each template word's rarity."""

    def __init__(self, templates: tuple[Template, ...], documents: int, frequencies: dict[bytes, int]):
        self.templates = templates
        self.words = [words_of(t.text.encode()) for t in templates]
        self.idf = {w: math.log((2 + documents) / (1 + frequencies.get(w, 0))) for ws in self.words for w in ws}
        self.rank = {w: n for n, w in enumerate(sorted(self.idf, key=lambda w: (-self.idf[w], w)))}
        self.total = [sum(self.idf[w] for w in ws) for ws in self.words]
        #: Of each template, its key phrases with where they begin, the first one's begin being 0.
        self.keys: list[list[tuple[int, list[bytes]]]] = []
        #: word -> template -> key phrase -> positions in the phrase
        self.postings: dict[bytes, dict[int, dict[int, list[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        self.first = []
        for n, (t, ws) in enumerate(zip(templates, self.words, strict=True)):
            found, at = [], 0
            for phrase in map(words_of, map(str.encode, t.keys)):
                at = next(i for i in range(at, len(ws)) if ws[i : i + len(phrase)] == phrase)
                found.append((at, phrase))
            self.first.append(found[0][0])
            self.keys.append([(at - found[0][0], phrase) for at, phrase in found])
            for k, (_, phrase) in enumerate(found):
                for i, w in enumerate(phrase):
                    self.postings[w][n][k].append(i)
        self.mandatory = [frozenset(w for _, phrase in keys for w in phrase) for keys in self.keys]
        self.known = frozenset(self.idf)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score) of every place; start is where the first key phrase begins."""
        there = self.known.intersection(words)
        wanted = [n for n, m in enumerate(self.mandatory) if m <= there]
        if not wanted:
            return []
        ranked = sorted(there, key=self.rank.__getitem__)  # the file's licence words, rarest first
        probes = {n: self._probes(n, ranked) for n in wanted}
        looked_up = {w for _, ws in probes.values() for w in ws}
        where: dict[bytes, list[int]] = {w: [] for w in looked_up}
        for i, w in enumerate(words):
            if w in looked_up:
                where[w].append(i)
        found = set()
        for n, (k, ws) in probes.items():
            begins = None
            for w in ws:  # the phrase's begin, as each posting has it
                own = {i - at for i in where[w] for at in self.postings[w][n][k]}
                begins = own if begins is None else begins & own
            away, phrase = self.keys[n][k]
            for begin in begins:
                if begin >= 0 and words[begin : begin + len(phrase)] == phrase:
                    slack = SLACK if k else 0
                    found.update((n, s) for s in range(begin - away - slack, begin - away + slack + 1) if self._stands(words, n, s))
        return sorted(((n, s, self._score(words, n, s)) for n, s in found), key=lambda x: (x[1], x[0]))

    def _probes(self, n: int, ranked: list[bytes]) -> tuple[int, list[bytes]]:
        """The key phrase with the file's rarest word of this template, and that phrase's rarest words."""
        of_template = next(w for w in ranked if n in self.postings.get(w, ()))
        k = min(self.postings[of_template][n])
        return k, [w for w in ranked if k in self.postings.get(w, {}).get(n, ())][:PROBES]

    def _stands(self, words: list[bytes], n: int, start: int) -> bool:
        """Whether the first key phrase stands at ``start`` and the others near where they should."""
        if start < 0:
            return False
        (_, first), *others = self.keys[n]
        if words[start : start + len(first)] != first:
            return False
        near = lambda away: range(max(0, start + away - SLACK), start + away + SLACK + 1)
        return all(any(words[i : i + len(phrase)] == phrase for i in near(away)) for away, phrase in others)

    def _score(self, words: list[bytes], n: int, start: int) -> float:
        begin = start - self.first[n]
        same = sum(self.idf[w] for i, w in enumerate(self.words[n]) if 0 <= begin + i < len(words) and words[begin + i] == w)
        return same / self.total[n] if self.total[n] else 1.0


SPANS = "array<struct<label: string, base: boolean, start: long, words: int, score: double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: id, n_words, and spans: all places with label, first word, key length and score."""
    index = RareWordIndex(templates, *document_frequencies(docs, text_col, {w for t in templates for w in words_of(t.text.encode())}))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            counts, spans = [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                counts.append(len(words))
                spans.append(
                    [
                        {"label": index.templates[n].label, "base": index.templates[n].base, "start": start, "words": len(index.keys[n][0][1]), "score": score}
                        for n, start, score in index.scan(words)
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, span_type)], names=[id_col, "n_words", "spans"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, spans {SPANS}")
