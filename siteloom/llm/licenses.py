"""License scans: an exact set-similarity join of text blocks with license templates.

Templates are short notices and whole license texts. A block is a line or, as notices are mostly wrapped, a window of consecutive words
across line ends, half as many again as the template has words. It matches a template when it holds at least THRESHOLD of the template's distinct words. The words of all
templates are ordered by how often they occur in the corpus, rarest first. A block that matches must hold one of the
template's first |T| - need + 1 words (prefix filter), at least `need` template words (length filter), and from the places of
the first common word in both orders enough words must still follow (positional filter). Those that pass are counted
exactly, so no match is lost; windows are counted only around prefix words. Only the templates and the counts of their words, both of fixed size, reach every task.

Beside it, places where fixed phrases stand word by word are found.

Nulls: a null text is empty and has no words; a null doc_id stays. Repeated rows and rows of one doc_id each get their row, by their own
text. Ties between templates: all that match are named, the best containment is the score. Very long texts are scanned whole. Extra columns,
whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Texts of public licenses.
TEXTS = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
        "it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution."
    ),
}
#: Templates: these, short notices and opening sentences of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "all-rights-reserved": "Copyright holder. All rights reserved",
    **TEXTS,
}
#: Letters A-Z become small; anything in ASCII but letters and digits becomes a space, a line's end stays one.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def template_sets(templates=TEMPLATES) -> dict[str, frozenset[bytes]]:
    return {name: frozenset(words(t)) for name, t in templates.items()}


class Scanner:
    """Templates in global order, with an index from prefix words to templates.

    A window has half as many words again as its template's text, given by name in lengths (else as its distinct words).
    """

    def __init__(self, templates: dict[str, frozenset[bytes]], counts: dict[bytes, int], threshold: float = THRESHOLD, lengths: dict[str, int] | None = None):
        lengths = lengths or {}
        order = sorted(set().union(*templates.values()), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates, self.index = [], {}
        for name, t in sorted(templates.items()):
            ranks, need = sorted(self.rank[w] for w in t), math.ceil(threshold * len(t) - 1e-9)
            for place, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.index.setdefault(r, []).append((len(self.templates), place))
            self.templates.append((name, frozenset(ranks), len(ranks), need))
        self.width = [n + n // 2 for n in (lengths.get(name, size) for name, _, size, _ in self.templates)]
        self.words = [frozenset(order[r] for r in ranks) for _, ranks, _, _ in self.templates]
        self.first = frozenset(order[r] for r in self.index)
        self.vocabulary = frozenset(order)

    def matches(self, block: list[bytes]) -> dict[str, float]:
        """Template -> containment, of those that meet the threshold."""
        own = set(block)
        if self.first.isdisjoint(own):
            return {}
        ranks = sorted(self.rank[w] for w in own & self.vocabulary)
        held, tried, out = frozenset(ranks), set(), {}
        for j, r in enumerate(ranks):
            for t, i in self.index.get(r, ()):
                if t in tried:
                    continue
                tried.add(t)  # r is their first common word: later ones have larger places in both orders
                name, words_, size, need = self.templates[t]
                if len(ranks) >= need and 1 + min(size - i - 1, len(ranks) - j - 1) >= need:
                    both = len(words_ & held)
                    if both >= need:
                        out[name] = both / size
        return out

    def wrapped(self, flat: list[bytes]) -> dict[str, float]:
        """Template -> containment in the best window of all words, of those that meet the threshold."""
        at: dict[int, list[int]] = {}
        for i, w in enumerate(flat):
            if w in self.first:
                for t, _ in self.index[self.rank[w]]:
                    at.setdefault(t, []).append(i)
        out = {}
        for t, places in at.items():
            name, _, size, need = self.templates[t]
            own, width, best, begin, end = self.words[t], self.width[t], 0, 0, 0
            held: dict[bytes, int] = {}
            for i in places:  # stretches of windows around prefix words, each place once
                first, last = max(end, i - width + 1, 0), min(len(flat), i + width)
                if first > end or not end:
                    held, begin = {}, first
                for j in range(first, last):
                    gone = flat[j - width] if j - width >= begin else None
                    if gone in held:
                        held[gone] -= 1
                        if not held[gone]:
                            del held[gone]
                    if flat[j] in own:
                        held[flat[j]] = held.get(flat[j], 0) + 1
                        best = max(best, len(held))
                end = max(end, last)
            if best >= need:
                out[name] = best / size
        return out


_PHRASES = {b" " + p.encode() + b" ": label for p, label in PHRASES.items()}


def phrases(flat: list[bytes]) -> tuple[list[int], set[str]]:
    """Starts (counted in words) of all phrases, and their labels."""
    joined, starts, labels = b" " + b" ".join(flat) + b" ", [], set()
    for p, label in _PHRASES.items():
        at, before, last = joined.find(p), 0, 0
        while at >= 0:
            before += joined.count(b" ", last, at)
            starts.append(before)
            labels.add(label)
            last, at = at, joined.find(p, at + 1)
    return starts, labels


def counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each template word occurs in all texts (as many rows as the templates have words)."""

    def run(batches):
        for batch in common.slices(batches):
            found: Counter = Counter()
            for t in common.texts(batch):
                found.update(w for w in t.translate(_TABLE).split() if w in vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = common.id_text(docs).mapInArrow(common.tidied(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}


def scan(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: phrases, labels of matching blocks, and the best containment of any block."""
    sets = templates or template_sets()
    lengths = {} if templates else {name: len(words(t)) for name, t in TEMPLATES.items()}
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(sets, counts(docs, frozenset().union(*sets.values())), threshold, lengths))

    def run(batches):
        scanner = shared.value
        for batch in common.slices(batches):
            rows = []
            for t in common.texts(batch):
                text = t.translate(_TABLE)
                flat = text.split()
                starts, base = phrases(flat)
                found: dict[str, float] = {}
                if not scanner.first.isdisjoint(flat):
                    for block in text.split(b"\n"):
                        for name, c in scanner.matches(block.split()).items():
                            found[name] = max(c, found.get(name, 0.0))
                    for name, c in scanner.wrapped(flat).items():
                        found[name] = max(c, found.get(name, 0.0))
                rows.append((len(flat), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), max(found.values(), default=0.0)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([common.ids(batch), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return common.id_text(docs).mapInArrow(common.tidied(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def sql() -> str:
    """Brute force: every block against every template."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    rows = ", ".join(f"('{n}', [{', '.join(repr(w.decode()) for w in sorted(t))}])" for n, t in template_sets().items())
    bases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return f"""
WITH low AS (SELECT doc_id, {lower} AS t FROM documents),
lists AS (SELECT doc_id, regexp_extract_all(t, {pattern}) AS w FROM low),
template(name, tw) AS (VALUES {rows}),
phrase(p, label) AS (VALUES {bases}),
block AS (SELECT DISTINCT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {pattern})) AS bw FROM low),
met AS (
  SELECT doc_id, name, max(len(list_intersect(bw, tw)) / len(tw)) AS c FROM block, template
  WHERE len(list_intersect(bw, tw)) >= ceil({THRESHOLD} * len(tw) - 1e-9) GROUP BY ALL
),
place AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM lists), phrase
  WHERE array_to_string(w[i : i + len(string_split(p, ' ')) - 1], ' ') = p
),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b FROM place GROUP BY doc_id),
named AS (SELECT DISTINCT doc_id, label FROM place),
every AS (SELECT doc_id, label FROM named UNION SELECT doc_id, name FROM met)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM named x WHERE x.doc_id = l.doc_id), '') AS base_labels,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM every x WHERE x.doc_id = l.doc_id), '') AS labels,
  CAST(coalesce((SELECT max(c) FROM met x WHERE x.doc_id = l.doc_id), 0) AS DOUBLE) AS score
FROM lists l LEFT JOIN base USING (doc_id)
"""
