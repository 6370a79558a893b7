"""License scans: a generalised suffix automaton over the words of license templates.

The automaton is built once in each task from the templates, which are a fixed list, and
files are streamed through it: after each word it knows the longest run of words, ending
there, that stands in some template (the matching statistics). Runs of `min_run` words or
more are chained, template by template, into spans: runs that follow each other in file
and template with at most `max_gap` words between. A span covering `coverage` of its
template, or `min_span` words of it, labels the file. Base phrases are found beside it, wherever
their words stand consecutively.

A null or empty text has no words, no labels, null places and score 0. Repeated rows and ids
each get their row. Ties between templates give both labels. Columns other than id and
text are not read.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame

from tillfloor.llm.common import by_document, text_rows

# The phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening or notice texts of public licenses, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    " associated documentation files (the \"Software\"), to deal in the Software without restriction, including"
    " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
    " following conditions: The above copyright notice and this permission notice shall be included in all copies"
    " or substantial portions of the Software.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
    " compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
    " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS"
    " OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
    " limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
    " (at your option) any later version. This program is distributed in the hope that it will be useful, but"
    " WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR"
    " PURPOSE. See the GNU General Public License for more details.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met: Redistributions of source code must retain the above copyright notice,"
    " this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
    " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
    " materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
    " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
    " MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy,"
    " modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
    " binary, for any purpose, commercial or non-commercial, and by any means.",
}

# Further paragraphs of the same licenses, by label: conditions, disclaimers, terms.
PARAGRAPHS = {
    "mit": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
        " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO"
        " EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER"
        " IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR"
        " THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache": (
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby"
        " grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"
        " to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute"
        " the Work and such Derivative Works in Source or Object form.",
        "Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the"
        " Work (and each Contributor provides its Contributions) on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or"
        " conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "gpl": (
        "You should have received a copy of the GNU General Public License along with this program. If not, see"
        " <https://www.gnu.org/licenses/>.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that"
        " you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all"
        " notices stating that this License and any non-permissive terms added in accord with section 7 apply to the"
        " code; keep intact all notices of the absence of any warranty; and give all recipients a copy of this"
        " License along with the Program.",
    ),
    "bsd": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
        " promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED"
        " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
        " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY"
        " DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
        " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
        " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING"
        " NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE"
        " POSSIBILITY OF SUCH DAMAGE.",
    ),
    "isc": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
        " INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR"
        " ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF"
        " USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF"
        " OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation; either version 2.1 of the License, or"
        " (at your option) any later version.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version.",
    ),
    "unlicense": (
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all"
        " copyright interest in the software to the public domain. We make this dedication for the benefit of the"
        " public at large and to the detriment of our heirs and successors.",
    ),
}

#: Every byte to itself, A-Z to a-z, and ASCII that is no letter or digit to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Of several word sequences; each state knows, by template, one place where its words end."""

    def __init__(self, templates: dict[str, list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[str, set[int]]] = [defaultdict(set)]
        for label, words in templates.items():
            last = 0
            for i, word in enumerate(words):
                last = self._add(last, word)
                self.ends[last][label].add(i + 1)
        # a state's words also end wherever those of the states below it end
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for label, ends in self.ends[state].items():
                self.ends[self.link[state]][label] |= ends

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(defaultdict(set))
        return len(self.next) - 1

    def _add(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _split(self, p: int, q: int, word: bytes) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def runs(self, words: list[bytes], known: set[bytes], least: int) -> list[tuple[int, int, int]]:
        """(start, end, state) of the matches of `least` words or more that no further word extends."""
        out, state, length = [], 0, 0
        after, link, lengths = self.next, self.link, self.length
        for i, word in enumerate(words):
            to = after[state].get(word)
            if to is not None:
                state, length = to, length + 1
                continue
            if length >= least:
                out.append((i - length, i, state))
            if word not in known:
                state = length = 0
                continue
            while state and word not in after[state]:
                state = link[state]
                length = lengths[state]
            if word in after[state]:
                state, length = after[state][word], length + 1
        if length >= least:
            out.append((len(words) - length, len(words), state))
        return out


def chains(runs: list[tuple[int, int, dict[str, set[int]]]], max_gap: int) -> dict[str, list[tuple[int, int, int]]]:
    """By template, (start, end, words covered): the best chains of runs in the order of file and template.

    Exact over the runs of one neighbourhood; runs further apart than max_gap are never joined,
    so the open chains are the few that end within max_gap words.
    """
    done: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    open_: dict[str, list[tuple[int, int, int, int]]] = defaultdict(list)
    for start, end, ends in runs:
        for label, places in ends.items():
            near = []
            for chain in open_[label]:
                if chain[1] + max_gap >= start:
                    near.append(chain)
                else:
                    done[label].append((chain[0], chain[1], chain[2]))
            grown = []
            for place in places:
                first = place - (end - start)
                best = (start, end, end - start, place)
                for s, e, covered, at in near:
                    # the overlap of two runs counts once
                    over = max(0, e - start, at - first)
                    if at <= first + over and first - at <= max_gap and over < end - start:
                        best = max(best, (s, end, covered + end - start - over, place), key=lambda c: c[2])
                grown.append(best)
            open_[label] = near + grown
    for label, rest in open_.items():
        done[label] += [(s, e, n) for s, e, n, _ in rest]
    return done


def scan(
    phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
    min_run: int = 4, max_gap: int = 8, min_span: int = 20, coverage: float = 0.5,
    paragraphs: dict[str, tuple[str, ...]] = PARAGRAPHS,
):
    """The function of one text: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Every paragraph is a template of its own, named `label` or `label#number`; all name their label.
    """
    texts = {label: words_of(t.encode()) for label, t in templates.items()}
    texts |= {f"{label}#{k}": words_of(t.encode()) for label, more in paragraphs.items() for k, t in enumerate(more, 2)}
    automaton = SuffixAutomaton(texts)
    known = {w for words in texts.values() for w in words}
    wanted = defaultdict(list)
    for phrase, label in phrases.items():
        parts = words_of(phrase.encode())
        wanted[parts[0]].append((parts, label))

    def places(words: list[bytes]) -> list[tuple[int, str]]:
        out = []
        for head, options in wanted.items():
            at = -1
            for _ in range(words.count(head)):
                at = words.index(head, at + 1)
                out += [(at, label) for parts, label in options if words[at : at + len(parts)] == parts]
        return out

    def of(text: bytes) -> tuple:
        words = words_of(text)
        base = places(words)
        base_labels = {label for _, label in base}
        best: dict[str, tuple[float, int, int]] = {}
        if not known.isdisjoint(words):
            found = [(s, e, automaton.ends[q]) for s, e, q in automaton.runs(words, known, min_run)]
            for label, spans in chains(found, max_gap).items():
                for start, end, covered in spans:
                    share = covered / len(texts[label])
                    if (share >= coverage or covered >= min_span) and (share, start, end) > best.get(label, (0, 0, 0)):
                        best[label] = (share, start, end)
        labels = base_labels | {name.split("#")[0] for name in best}
        score = max([0.5 if base else 0.0, *(min(1.0, s) for s, _, _ in best.values())])
        starts = [at for at, _ in base]
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
            ",".join(f"{k}:{s}:{e}" for k, (_, s, e) in sorted(best.items())),
        )

    return of


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Words, base places, labels, score and template spans (label:first word:end) of every file."""
    return by_document(
        text_rows(docs, id_col, text_col),
        lambda: scan(**settings),
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " score double, template_spans string",
    )
