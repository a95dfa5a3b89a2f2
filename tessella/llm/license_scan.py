"""Licence scan with a generalised suffix automaton over licence tokens.

All templates and base phrases are token sequences of one automaton. A
document's words stream through it and give matching statistics: at each word
the length and state of the longest suffix that occurs in some template, and
with the state the places in the templates where it ends. Long matches that
cannot be extended are chained: in a chain both the document's words and the
template's words rise, and no word of either counts twice. A chain's cover is
the share of the template's words that it has. A base phrase occurs wherever
its state is on the suffix path of the match.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.exchange import release, small_batches
from tessella.llm.textkernel import ALNUM_WORD, split_words

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of public licences, label: text.
TEMPLATES = {
    "mit": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-terms": "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-terms": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "cc": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-terms": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}
#: A match of so many words is long; chained matches may be so many words apart.
LONG, GAP = 5, 3


def tokens_of(text: str) -> list[bytes]:
    w = split_words(pa.array([text]), ALNUM_WORD, lower=True)
    return [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]


class SuffixAutomaton:
    """Generalised suffix automaton: one automaton for the substrings of many sequences."""

    def __init__(self, sequences):
        self.next, self.link, self.length = [{}], [-1], [0]
        #: for each state the (owner, end) places of its strings
        self.places: list[set] = [set()]
        for owner, sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
            state = 0
            for end, symbol in enumerate(sequence, 1):
                walk = state = self.next[state][symbol]
                while walk > 0:
                    self.places[walk].add((owner, end))
                    walk = self.link[walk]

    def _new(self, edges, link, length) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, p: int, symbol) -> int:
        """The state for p + symbol whose longest string is exactly that of p and the symbol."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.places[clone] = set(self.places[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        state = self._new({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = state
            p = self.link[p]
        self.link[state] = self._split(p, symbol) if p >= 0 else 0
        return state

    def statistics(self, symbols):
        """(state, length) of the longest match that ends at each symbol."""
        state = length = 0
        edges, link, longest = self.next, self.link, self.length
        for symbol in symbols:
            while state and symbol not in edges[state]:
                state = link[state]
                length = longest[state]
            if symbol in edges[state]:
                state = edges[state][symbol]
                length += 1
            else:
                length = 0
            yield state, length


class Scanner:
    def __init__(self, templates=None, base=None, long: int = LONG, gap: int = GAP):
        templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
        seqs = [((label, True), tokens_of(t)) for label, t in templates.items()] + [((label, False), tokens_of(p)) for p, label in base.items()]
        words = sorted({w for _, s in seqs for w in s})
        ident = {w: i for i, w in enumerate(words)}
        self.vocab = pa.array(words, pa.large_binary())
        self.auto = SuffixAutomaton([(owner, [ident[x] for x in s]) for owner, s in seqs])
        self.sizes = {label: len(s) for (label, template), s in seqs if template}
        self.long, self.gap = long, gap
        phrases = []
        for p, label in base.items():
            state = 0
            sequence = [ident[x] for x in tokens_of(p)]
            for symbol in sequence:
                state = self.auto.next[state][symbol]
            phrases.append((state, len(sequence), label))
        # base phrases on the suffix path of each state
        self.phrases = []
        for state in range(len(self.auto.next)):
            found, walk = [], state
            while walk > 0:
                found += [(n, label) for s, n, label in phrases if s == walk]
                walk = self.auto.link[walk]
            self.phrases.append(found)

    def identify(self, w):
        """Vocabulary number of each word, compared by its bytes; -1 for others."""
        return pc.fill_null(pc.index_in(w.column(), self.vocab), -1).to_numpy()

    def matches(self, ids):
        """Base places as (start, label), and (label, template start, document start, length) of the long matches that cannot be extended."""
        base, long = [], []
        inside = np.flatnonzero(ids >= 0)
        for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1) if len(inside) else ():
            if len(run) < 2:
                continue
            found = list(self.auto.statistics(ids[run].tolist()))
            for k, (state, length) in enumerate(found):
                if length < 2:
                    continue
                i = int(run[k])
                base += [(i - n + 1, label) for n, label in self.phrases[state] if length >= n]
                if length >= self.long and (k + 1 == len(found) or found[k + 1][1] <= length):
                    long += [(label, end - length, i + 1 - length, length) for (label, template), end in sorted(self.auto.places[state]) if template]
        return base, long

    def chains(self, long):
        """(label, document start, document end, words of the template) of the best chains that do not overlap, by label.

        A match follows another if it starts and ends later in both, with at
        most ``gap`` words of the document between them; what overlaps counts
        once. Only matches that near are looked at.
        """
        out = []
        for label in sorted({m[0] for m in long}):
            own = sorted((d, t, n) for x, t, d, n in long if x == label)
            best = []  # (words, chain start, previous)
            ends, back = [d + n for d, _, n in own], 0
            for i, (d, t, n) in enumerate(own):
                while back < i and ends[back] + self.gap < d - self.sizes[label]:
                    back += 1
                words, start = n, d
                for j in range(back, i):
                    pd, pt, pn = own[j]
                    if pd < d and pt < t and pd + pn < d + n and pt + pn < t + n and d - pd - pn <= self.gap:
                        gain = n - max(0, pd + pn - d, pt + pn - t)
                        if best[j][0] + gain > words:
                            words, start = best[j][0] + gain, best[j][1]
                best.append((words, start))
            starts, stops = [], []
            for words, start, end in sorted(((w, s, e) for (w, s), e in zip(best, ends)), key=lambda c: (-c[0], c[1], c[2])):
                at = bisect.bisect_left(starts, start)
                if (at == 0 or stops[at - 1] <= start) and (at == len(starts) or starts[at] >= end):
                    starts.insert(at, start)
                    stops.insert(at, end)
                    out.append((label, start, end, words))
        return sorted(out, key=lambda c: (c[1], c[2], c[0]))

    def scan(self, ids):
        """Base places as (start, label) and covered template spans as (label, start, end, words) of one document."""
        base, long = self.matches(ids)
        return base, self.chains(long)


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,words:long>>"


def _scan(scanner: dict):
    def run(batches):
        s = Scanner(**scanner)
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            w = split_words(batch.column("text"), ALNUM_WORD, lower=True)
            ids = s.identify(w)
            rows = []
            for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                base, spans = s.scan(ids[i:j])
                at = [a for a, _ in base]
                own = {x for _, x in base}
                score = 1.0 if base else max([n / s.sizes[x] for x, _, _, n in spans], default=0.0)
                rows.append((len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for x, _, _, _ in spans})), score, [dict(zip(("label", "start", "end", "words"), x)) for x in spans]))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts, pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[x for x in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")])
        release()

    return run


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **scanner) -> DataFrame:
    """Base places, labels, spans and a score in 0..1 for each row of ``docs``.

    The score is 1 with a base phrase, else the largest share of a template's
    words that one chain of matches covers; a fragment that repeats counts
    once. spans are the chains, from word to word, with that number of words. Null, empty and word-less texts have no words, no places, empty
    labels and score 0; repeated rows are scanned each; an empty table gives
    an empty table; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_scan(scanner), _OUT)
