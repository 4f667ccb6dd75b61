"""License scans by a positional rare-token index.

Templates (whole licence texts and their customary notices) are indexed by word: word ->
(template, position in it). The document frequency of every template word is counted over all
files. Of each file first the licence words that it holds are found, which leaves the
templates that they could cover. Then the file's licence words are looked up from the
highest IDF down, until every place where such a template covers enough of its weight must
hold ``MEET`` of the words looked up; the rest of its words need no look. Their postings are
intersected by relative position: occurrences that agree on where the template would start
meet there. A start is accepted where enough of them meet, the template covers
``COVER`` of its IDF weight and its mandatory key phrases stand inside it. A template that
is one phrase (the base scan) is accepted exactly where all its words stand.

Defined results: null and empty texts have no words, no places, null positions, empty
labels and score 0; labels are distinct, sorted and joined by commas; repeated rows
each give a row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, tidy

# Phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by label, each with its mandatory key phrases.
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "any later version"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0"]),
]
# Whole licence texts by label, each with its mandatory key phrases.
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
WHOLE = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n" + _MIT_REST, ["hereby granted free of charge", "without warranty of any kind"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_REST, ["with or without fee", "the above copyright notice"]),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_REST, ["hereby granted the software is provided"]),
    ("bsd-2-clause", _BSD_START + "\n" + _BSD_REST, ["redistribution and use in source and binary forms", "with the distribution this software is provided"]),
    ("bsd-3-clause", _BSD_START + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_REST, ["redistribution and use in source and binary forms", "endorse or promote products"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ["must be plainly marked as such"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.", ["unencumbered software", "dedicate any and all copyright interest"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["apache license", "without warranties or conditions of any kind"]),
    ("gpl-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ["gnu general public license", "any later version", "without any warranty"]),
]
MEET = 2  # words that must meet at a start, where the template has enough
COVER = 0.75

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[bytes, ...], ...]
    base: bool


def _templates(texts: list[tuple[str, str, list[str]]], base: bool = False) -> tuple[Template, ...]:
    return tuple(Template(label, tuple(words_of(text.encode())), tuple(tuple(words_of(p.encode())) for p in phrases), base) for label, text, phrases in texts)


TEMPLATES = _templates([(label, phrase, []) for phrase, label in BASE.items()], True) + _templates(NOTICES) + _templates(WHOLE)


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of files, and of those that hold each word of a fixed vocabulary: one row
    per word and partition is summed, one per word reaches the driver."""

    def run(batches):
        total, found = 0, Counter()
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found.update(vocabulary.intersection(words_of(text)))
        rows = [("", total), *((w.decode(), n) for w, n in found.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word.encode(): r.n for r in rows}
    return counts.pop(b"", 0), counts


class Index:
    """The positional index over the templates, under the IDF of one corpus."""

    def __init__(self, total: int, counts: dict[bytes, int], templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        words = sorted({w for t in templates for w in t.words})
        self.idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in words}
        self.vocabulary = frozenset(words)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, t in enumerate(templates):
            for i, w in enumerate(t.words):
                self.postings[w].append((number, i))
        self.weights = [[self.idf[w] for w in t.words] for t in templates]
        self.least = [sum(w) * COVER * (1 - 1e-9) for w in self.weights]
        #: weight and number of places of each word in each template
        self.held = [{w: (self.idf[w] * n, n) for w, n in Counter(t.words).items()} for t in templates]
        self.must = [frozenset(t.words) if t.base else frozenset(w for p in t.phrases for w in p) for t in templates]

    def possible(self, present: set[bytes]) -> list[int]:
        """Templates that a file with these words can hold a place of."""
        out = []
        for number, t in enumerate(self.templates):
            if self.must[number] <= present and (t.base or sum(w for word, (w, _) in self.held[number].items() if word in present) >= self.least[number]):
                out.append(number)
        return out

    def looked_up(self, present: set[bytes], possible: list[int]) -> tuple[set[bytes], dict[int, int]]:
        """The file's licence words of the highest IDF, as many as it takes, and how many of
        their places must meet at any start of each template that covers enough."""
        used = {w for number in possible for w in self.held[number]} & present
        # what is not looked up yet of each template, and the places that are
        rest = {number: sum(w for word, (w, _) in self.held[number].items() if word in present) for number in possible}
        places: dict[int, list[float]] = {number: [] for number in possible}
        needed = dict.fromkeys(possible, 0)
        chosen, waiting = set(), set(possible)
        for word in sorted(used, key=lambda w: (-self.idf[w], w)):
            if not waiting:
                break
            mine = [number for number in waiting if word in self.held[number]]
            if not mine:
                continue
            chosen.add(word)
            for number in possible:
                if word not in self.held[number]:
                    continue
                weight, n = self.held[number][word]
                rest[number] -= weight
                places[number] += [self.idf[word]] * n  # falling, as words come
                if self.templates[number].base:
                    needed[number] = 1
                else:
                    left, needed[number] = self.least[number] - rest[number], 0
                    for w in places[number]:
                        if left <= 0:
                            break
                        left -= w
                        needed[number] += 1
            waiting -= {number for number in mine if needed[number] >= (1 if self.templates[number].base else MEET)}
        return chosen, needed

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, covered share of its weight) of all accepted places."""
        present = set(self.vocabulary.intersection(words))
        possible = self.possible(present) if present else []
        if not possible:
            return []
        chosen, needed = self.looked_up(present, possible)
        wanted = set(possible)
        postings = {w: [p for p in self.postings[w] if p[0] in wanted] for w in chosen}
        votes: Counter = Counter()
        for at in [i for i, w in enumerate(words) if w in postings]:
            for number, i in postings[words[at]]:
                votes[number, at - i] += 1
        out = []
        for (number, start), n in votes.items():
            t, weights = self.templates[number], self.weights[number]
            if n < needed[number]:
                continue
            if t.base:
                if start >= 0 and tuple(words[start : start + len(t.words)]) == t.words:
                    out.append((number, start, 1.0))
                continue
            cover = sum(w for i, (word, w) in enumerate(zip(t.words, weights)) if 0 <= start + i < len(words) and words[start + i] == word) / sum(weights)
            if cover >= COVER:
                window = words[max(0, start) : start + len(t.words)]
                if all(_holds(window, p) for p in t.phrases):
                    out.append((number, start, min(1.0, cover)))
        return out


def _holds(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    return any(tuple(words[i : i + len(phrase)]) == phrase for i in range(len(words) - len(phrase) + 1))


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Two passes over the texts, no shuffle of texts: frequencies, then the scan."""
    vocabulary = frozenset(w for t in templates for w in t.words)
    index = Index(*document_frequencies(docs, text_col, vocabulary), templates)
    names = [x.split()[0] for x in SCAN.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64()]

    def row(doc_id, text):
        words = words_of(text)
        found = index.places(words)
        base = [(s, index.templates[n].label) for n, s, _ in found if index.templates[n].base]
        starts = [s for s, _ in base]
        labels = {label for _, label in base}
        more = labels | {index.templates[n].label for n, _, _ in found}
        return (doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), max((c for _, _, c in found), default=0.0))

    def run(batches):
        for batch in batches:
            rows = [row(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(tidy(run), SCAN)
