"""License detection with a generalised suffix automaton over the words of license templates.

The automaton accepts every run of words that occurs in any template. A file's words stream through it and give, at each
word, the longest such run ending there (its matching statistics). Long runs of one template that follow one another in
the file and in the template, with short gaps, are chained; a chain that covers enough of its template is a license span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Words, by_text_size, hash_of, texts_of

#: Phrases that the base reports, and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Public license texts and usual notices. (label, text)
TEMPLATES = (
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-text", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

#: Words of the shortest run that counts, words of a file between two runs of a chain, share of a template to be covered.
MIN_RUN, MAX_GAP, COVERAGE = 5, 12, 0.6

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans string"
)


class SuffixAutomaton:
    """Of several sequences of symbols. State 0 is the empty run."""

    def __init__(self, sequences: list[list[int]]):
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        reached = []
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
                reached.append(last)
        #: per state: the places (sequence, end) where its runs end
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.link]
        at = iter(reached)
        for number, sequence in enumerate(sequences):
            for end in range(1, len(sequence) + 1):
                self.ends[next(at)].add((number, end))
        for state in sorted(range(1, len(self.link)), key=lambda x: -self.length[x]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int) -> int:
        self.follow.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The state of exactly the runs of `state` followed by `symbol`."""
        target = self.follow[state][symbol]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1)
        self.follow[copy] = dict(self.follow[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while state >= 0 and self.follow[state].get(symbol) == target:
            self.follow[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.follow[last]:
            return self._split(last, symbol)
        new, state = self._state(self.length[last] + 1), last
        while state >= 0 and symbol not in self.follow[state]:
            self.follow[state][symbol] = new
            state = self.link[state]
        self.link[new] = self._split(state, symbol) if state >= 0 else 0
        return new

    def long_runs(self, symbols: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, end, state) of the runs of `least` symbols or more that no further symbol extends."""
        found, state, length = [], 0, 0
        for k, symbol in enumerate(symbols):
            if symbol in self.follow[state]:
                state, length = self.follow[state][symbol], length + 1
                continue
            if length >= least:
                found.append((k - length, k, state))
            while state >= 0 and symbol not in self.follow[state]:
                state = self.link[state]
            if state < 0:
                state, length = 0, 0
            else:
                state, length = self.follow[state][symbol], self.length[state] + 1
        if length >= least:
            found.append((len(symbols) - length, len(symbols), state))
        return found


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in templates]
        split = Words([text for _, text in templates])
        self.vocabulary = np.unique(np.concatenate([split.hash, [np.uint64(hash_of(w)) for p, _ in phrases for w in p.split()]]))
        numbers = np.searchsorted(self.vocabulary, split.hash).tolist()
        sequences = [numbers[a:b] for a, b in zip(split.first, split.first[1:], strict=False)]
        self.sizes = [len(x) for x in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.phrases = [
            (label, [int(np.searchsorted(self.vocabulary, np.uint64(hash_of(w)))) for w in phrase.split()]) for phrase, label in phrases
        ]

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word in the vocabulary of the templates, or -1."""
        at = np.searchsorted(self.vocabulary, words.hash)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words.hash, at, -1)

    def spans(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, label, covered share) of the chains that cover enough of a template."""
        chains: dict[int, list[int]] = {}  # template: first word, end, end in the template, words covered
        closed = []
        for start, end, state in runs:
            ends: dict[int, list[int]] = {}
            for template, at in self.automaton.ends[state]:
                ends.setdefault(template, []).append(at)
            for template, places in ends.items():
                chain = chains.get(template)
                if chain and start - chain[1] <= MAX_GAP:
                    fresh = end - max(start, chain[1])
                    later = [at for at in places if at - fresh >= chain[2]]
                    if fresh > 0 and later:
                        chains[template] = [chain[0], end, min(later), chain[3] + fresh]
                        continue
                if chain:
                    closed.append((template, chain))
                chains[template] = [start, end, min(places), end - start]
        closed += chains.items()
        return sorted(
            (c[0], c[1], self.labels[t], c[3] / self.sizes[t]) for t, c in closed if c[3] >= COVERAGE * self.sizes[t]
        )


_scanners: dict[tuple, Scanner] = {}


def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    if (templates, phrases) not in _scanners:
        _scanners[templates, phrases] = Scanner(templates, phrases)
    return _scanners[templates, phrases]


def detect(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """One row (`RESULT`) per row of `docs` (doc_id, text), over the whole text.

    n_base, first_word, last_word, base_labels: places, first and last start (words from 0, null if none) and labels of
    the phrases. labels adds those of the license spans; spans lists them as label:first word:word after the last.
    score: the largest covered share of a template, 0.5 at least where a phrase occurs. A null or empty text has no
    words, no places, empty labels and score 0. Repeated rows give repeated rows; other columns are ignored. Words are
    compared by 64-bit hash. One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, phrases)
        for batch in by_text_size(batches):
            words = Words(texts_of(batch))
            number, rows = scanner.numbers(words), batch.num_rows
            first = words.first
            # base: phrases that stand within one text
            text_end = np.repeat(first[1:], np.diff(first))
            place = np.arange(len(number))
            n_base, low, high = np.zeros(rows, np.int64), np.full(rows, 2**62), np.full(rows, -1)
            base: list[set[str]] = [set() for _ in range(rows)]
            for label, phrase in scanner.phrases:
                hit = place + len(phrase) <= text_end
                for k, symbol in enumerate(phrase):
                    hit[: max(0, len(number) - k)] &= number[k:] == symbol
                at = np.flatnonzero(hit)
                row = np.searchsorted(first, at, "right") - 1
                np.add.at(n_base, row, 1)
                np.minimum.at(low, row, at - first[row])
                np.maximum.at(high, row, at - first[row])
                for k in set(row.tolist()):
                    base[k].add(label)
            # stretches of template words, long enough to hold a run
            known = number >= 0
            cut = np.ones(len(number), bool)
            cut[1:] = ~(known[1:] & known[:-1])
            cut[first[first < len(number)]] = True
            opens = np.flatnonzero(cut)
            closes = np.append(opens[1:], len(number))
            long = (closes - opens >= MIN_RUN) & known[opens] if len(opens) else np.zeros(0, bool)
            spans: dict[int, list] = {}
            for a, b in zip(opens[long].tolist(), closes[long].tolist(), strict=True):
                row = int(np.searchsorted(first, a, "right")) - 1
                shift = a - int(first[row])
                runs = scanner.automaton.long_runs(number[a:b].tolist(), MIN_RUN)
                spans.setdefault(row, []).extend((s + shift, e + shift, state) for s, e, state in runs)
            found = {row: scanner.spans(runs) for row, runs in spans.items() if runs}
            score = np.where(n_base > 0, 0.5, 0.0)
            for row, chains in found.items():
                score[row] = max([score[row], *(min(c[3], 1.0) for c in chains)])
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(first)),
                    pa.array(n_base),
                    pa.array(low, mask=none),
                    pa.array(high, mask=none),
                    pa.array([",".join(sorted(x)) for x in base]),
                    pa.array([",".join(sorted(x | {c[2] for c in found.get(k, ())})) for k, x in enumerate(base)]),
                    pa.array(score),
                    pa.array([",".join(f"{c[2]}:{c[0]}:{c[1]}" for c in found.get(k, ())) for k in range(rows)]),
                ],
                [x.split()[0] for x in RESULT.split(", ")],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, RESULT)
