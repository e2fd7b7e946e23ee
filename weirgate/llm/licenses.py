"""Operator 9: licence scans with a positional rare-token index.

Templates are short licence notices, and passages of PASSAGE words each of full licence texts. The IDF of their
words is counted over all documents. The index holds, of each template, the places of its rarest words: as many
as leave fewer places outside than COVER asks for, so that no start that stands can miss all of them. In each text the
indexed words, wherever they stand, are looked up in these postings; each pair of places votes for (template, place of
the template's start), and starts with too few votes to stand go. The rest are compared word for word: a start stands
when COVER of the template's words are at their places, these weigh at least WEIGHT of its RARE rarest words, and all
of its mandatory phrases occur within it, whatever else the text holds.

A notice that stands gives its label. A full text gives its label where, within SPAN times its length, passages
stand that hold TEXT of its words, with its mandatory phrases between the first and the last of them: a changed holder or
clause costs the passages that it touches. Any plain text can be passed as one.

Base labels are plain: every place where a phrase's words stand consecutively.

One pass counts, one pass scans; no text is shuffled. The driver sees one row per licence word. Nulls: a
null text is an empty one, with no words, no labels and score 0. Repeated rows each give a row. An empty
table gives an empty result. A very long text is scanned whole, as one row of Arrow; extra columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.arrow_text import ALNUM, slices, split_words
from weirgate.llm.shared import ALNUM_WORD, UPPER, map_arrow

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, notice, mandatory phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "are permitted provided")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("into the public domain",)),
)
#: Label, standard full text, phrases that must stand.
TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
        A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted", "without warranty of any kind"),
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
        OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ("source and binary forms", "endorse or promote products"),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ("with or without fee",),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
        ("must not be misrepresented", "plainly marked"),
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
        to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of
        the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated
        by a source language processor.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE,
        TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("machine executable object code",),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
        all present and future rights to this software under copyright law.""",
        ("into the public domain", "relinquishment in perpetuity"),
    ),
    (
        "gpl-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program.""",
        ("gnu general public license", "any later version"),
    ),
)
RARE = 8
WEIGHT = 0.5
COVER = 0.6
PASSAGE = 16
TEXT = 0.75
SPAN = 1.5
#: Words compared at once.
COMPARED = 1 << 20
LOWER = str.maketrans(UPPER, UPPER.lower())


def words_of(text: str) -> list[str]:
    return re.findall(ALNUM_WORD, text.translate(LOWER))


@lru_cache(8)
def passages(texts: tuple) -> tuple[tuple, np.ndarray]:
    """Templates of PASSAGE words of each text, the last with what is left over; and the text that each is of."""
    out, of = [], []
    for t, (label, text, _) in enumerate(texts):
        words = words_of(text)
        cuts = [*range(0, max(1, len(words) - PASSAGE + 1), PASSAGE), len(words)]
        out += [(label, " ".join(words[lo:hi]), ()) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        of += [t] * (len(cuts) - 1)
    return tuple(out), np.array(of, dtype=np.int64)


class Index:
    """Vocabulary, postings and phrases of the templates, by the hashes that split_words gives."""

    def __init__(self, templates: tuple) -> None:
        texts = [t.encode() for _, t, _ in templates]
        self.vocabulary = sorted({w for t in texts for w in t.split()})
        hashes = hashes_of(b" ".join(self.vocabulary))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.words = [np.array([number[w] for w in t.split()]) for t in texts]
        self.phrases = [[np.array([number[w] for w in p.encode().split()]) for p in phrases] for _, _, phrases in templates]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, -1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


class Postings:
    """The places of each template's rarest words: more of them than may be out of place in a start that stands."""

    def __init__(self, index: Index, weight: np.ndarray) -> None:
        posts, self.votes = [], []
        for t, ws in enumerate(index.words):
            miss = len(ws) - next(k for k in range(len(ws) + 1) if k / len(ws) >= COVER)
            held = 0
            for w in sorted(set(ws.tolist()), key=lambda w: (-weight[w], w)):
                at = np.flatnonzero(ws == w).tolist()
                posts += [(w, t, q) for q in at]
                held += len(at)
                if held > miss:
                    break
            self.votes.append(held - miss)
        self.votes = np.array(self.votes, dtype=np.int64)
        self.post = np.array(sorted(posts), dtype=np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.post[:, 0], np.arange(len(index.vocabulary) + 1))
        self.need = np.array([WEIGHT * np.sort(weight[np.unique(ws)])[::-1][:RARE].sum() for ws in index.words])
        self.longest = max((len(ws) for ws in index.words), default=0)


def hashes_of(text: bytes) -> np.ndarray:
    return split_words(pa.array([text.decode()], pa.large_string()), ALNUM).hashes()


@lru_cache(4)
def index_of(templates: tuple) -> Index:
    return Index(templates)


def _frequency(batches: Iterator[pa.RecordBatch], templates: tuple) -> Iterator[pa.RecordBatch]:
    index = index_of(templates)
    size = len(index.vocabulary)
    for batch in batches:
        n = np.zeros(size + 1, dtype=np.int64)
        for _, part in slices(batch.column("text")):
            words = split_words(part, ALNUM)
            number = index.numbers(words.hashes())
            some = np.flatnonzero(number >= 0)
            doc = np.searchsorted(words.first, some, side="right") - 1
            n[:size] += np.bincount(np.unique(doc * size + number[some]) % size, minlength=size)
            n[size] += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(n)], names=["word", "n"])


def idf(docs: DataFrame, templates: tuple = TEMPLATES) -> np.ndarray:
    """IDF of each word of the templates over all documents; one row a word reaches the driver."""
    counts = map_arrow(docs.select(F.col("text").cast("string").alias("text")), lambda b: _frequency(b, templates), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = np.zeros(len(index_of(templates).vocabulary) + 1)
    for r in counts.collect():
        n[r["word"]] = r["n"]
    return np.log1p(n[-1] / (n[:-1] + 1))


def _runs(number: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand consecutively."""
    n = len(number) - len(phrase) + 1
    hit = np.ones(max(0, n), dtype=bool)
    for j, w in enumerate(phrase):
        hit &= number[j : j + max(0, n)] == w
    return np.flatnonzero(hit)


def _matches(index: Index, postings: Postings, weight: np.ndarray, number: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(document, template, its start, share of its words in place) of the templates that stand."""
    some = np.flatnonzero(number >= 0)
    w = number[some]
    n = postings.first[w + 1] - postings.first[w]
    some, w, n = some[n > 0], w[n > 0], n[n > 0]
    if not len(some):
        return
    doc = np.searchsorted(first, some, side="right") - 1
    # Votes: a row per posting of each indexed word.
    post = postings.post[np.repeat(postings.first[w], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    start = np.repeat(some, n) - post[:, 2]
    # Places are unique in the slice, and a template word's place has one word: each vote of a start is another word's place.
    key = (post[:, 1] * (len(number) + 2 * postings.longest) + start + postings.longest) * (len(first) + 1) + np.repeat(doc, n)
    key, at, votes = np.unique(key, return_index=True, return_counts=True)
    template, start, doc = post[at, 1], start[at], np.repeat(doc, n)[at]
    enough = votes >= postings.votes[template]
    template, start, doc = template[enough], start[enough], doc[enough]
    for t in np.unique(template).tolist():
        ws = index.words[t]
        of = np.flatnonzero(template == t)
        for lo in range(0, len(of), max(1, COMPARED // len(ws))):
            part = of[lo : lo + max(1, COMPARED // len(ws))]
            place = start[part, None] + np.arange(len(ws))
            low, high = first[doc[part], None], first[doc[part] + 1, None]
            same = (place >= low) & (place < high) & (number[np.clip(place, 0, len(number) - 1)] == ws)
            cover = same.sum(axis=1) / len(ws)
            for i in np.flatnonzero((cover >= COVER) & (same @ weight[ws] >= postings.need[t] - 1e-9)).tolist():
                d, s = int(doc[part[i]]), int(start[part[i]])
                inside = number[max(s, int(first[d])) : min(s + len(ws), int(first[d + 1]))]
                if all(len(_runs(inside, p)) for p in index.phrases[t]):
                    yield d, t, s, float(cover[i])


def _share(hits: list[tuple[int, int]], lengths: dict[int, int], phrases: list[np.ndarray], number: np.ndarray) -> float:
    """The largest share of a full text's words in different passages that begin within SPAN times its length, phrases between the first and the last of them; hits are (start, passage)."""
    total, best, held, words, lo = sum(lengths.values()), 0.0, {}, 0, 0
    hits = sorted(hits)
    for start, p in hits:
        held[p] = held.get(p, 0) + 1
        words += lengths[p] if held[p] == 1 else 0
        while start - hits[lo][0] > SPAN * total:
            gone = hits[lo][1]
            held[gone] -= 1
            words -= 0 if held[gone] else lengths[gone]
            lo += 1
        if words >= TEXT * total and words / total > best:
            inside = number[max(0, hits[lo][0]) : max(0, start + lengths[p])]
            if all(len(_runs(inside, x)) for x in phrases):
                best = words / total
    return best


def _scan(batches: Iterator[pa.RecordBatch], weight: np.ndarray, templates: tuple, texts: tuple) -> Iterator[pa.RecordBatch]:
    parts, text_of = passages(texts)
    index = index_of(templates + parts)
    postings = Postings(index, weight)
    lengths = [{int(p): len(index.words[len(templates) + p]) for p in np.flatnonzero(text_of == t)} for t in range(len(texts))]
    phrases = [[index.numbers(hashes_of(p.encode())) for p in must] for _, _, must in texts]
    base = [(hashes_of(p.encode()), label) for p, label in BASE]
    for batch in batches:
        for lo, part in slices(batch.column("text")):
            words = split_words(part, ALNUM)
            hashes, first = words.hashes(), words.first
            n = len(part)
            n_base, low, high = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_labels, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
            for phrase, label in base:
                at = _runs(hashes, phrase)
                doc = np.searchsorted(first, at, side="right") - 1
                inside = at + len(phrase) <= first[doc + 1]
                at, doc = at[inside], doc[inside]
                n_base += np.bincount(doc, minlength=n)
                np.minimum.at(low, doc, at - first[doc])
                np.maximum.at(high, doc, at - first[doc])
                for d in np.unique(doc).tolist():
                    base_labels[d].add(label)
                    labels[d].add(label)
                    score[d] = 1.0
            number, hits = index.numbers(hashes), {}
            for d, t, start, cover in _matches(index, postings, weight, number, first):
                if t < len(templates):
                    labels[d].add(templates[t][0])
                    score[d] = max(score[d], cover)
                else:
                    hits.setdefault((d, int(text_of[t - len(templates)])), []).append((start, t - len(templates)))
            for (d, t), places in hits.items():
                places = [(s - int(first[d]), p) for s, p in places]
                share = _share(places, lengths[t], phrases[t], number[first[d] : first[d + 1]])
                if share:
                    labels[d].add(texts[t][0])
                    score[d] = max(score[d], share)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, n), pa.array(np.diff(first)), pa.array(n_base),
                    pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([",".join(sorted(x)) for x in base_labels]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def scan(docs: DataFrame, templates: tuple = TEMPLATES, texts: tuple = TEXTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document. texts are plain full texts, of any length."""
    bad = [w for _, t, phrases in templates for x in (t, *phrases) for w in x.split() if not re.fullmatch(ALNUM_WORD, w) or w != w.lower()]
    if bad:
        raise ValueError(f"not words of a template: {bad}")
    known = [set(words_of(text)) for _, text, _ in texts]
    bad = [p for have, (_, _, phrases) in zip(known, texts, strict=True) for p in phrases if not set(p.split()) <= have]
    if not all(known):
        raise ValueError("a full text without words")
    if bad:
        raise ValueError(f"phrases that are not in their texts: {bad}")
    weight = idf(docs, templates + passages(texts)[0])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(rows, lambda b: _scan(b, weight, templates, texts), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
