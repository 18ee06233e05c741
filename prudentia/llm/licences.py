"""Licence texts found by matching statistics against a suffix automaton, and chains of long matches.

The templates make one generalised suffix automaton over words. A document streams
through it word by word, which gives for each place the longest run of words ending
there that stands in any template (the matching statistics). Runs that cannot be made
longer are chained, template by template, into spans in the same order in document and
template; a span that covers enough of its template is a licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.llm.common import rows
from prudentia.llm.licence_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Shortest run of words that is chained, and most words of the document between two runs of a chain.
LEAST_RUN = 4
MOST_GAP = 24
#: Share of a template's words that a span has to cover.
COVERED = 0.75
_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """``text`` with A-Z in lower case and nothing else changed."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words(text: str) -> Iterator[str]:
    return (m[0] for m in WORD.finditer(lowered(text)))


class Automaton:
    """Generalised suffix automaton of templates given as lists of words.

    ``moves``, ``links`` and ``sizes`` are the automaton; ``ends`` lists per state the
    (template, end) places of its longest string, ``phrases`` the phrases that end there.
    """

    def __init__(self, templates: list[list[str]], phrases: list[list[str]]):
        self.moves: list[dict[str, int]] = [{}]
        self.links, self.sizes = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, template in enumerate([*templates, *phrases]):
            last = 0
            for end, word in enumerate(template, 1):
                last = self._extended(last, word, own)
                if number < len(templates):
                    own[last].append((number, end))
        by_size = sorted(range(1, len(self.sizes)), key=lambda s: -self.sizes[s])
        for state in by_size:  # what ends in a state ends in all its suffixes, too
            if self.links[state] > 0:
                own[self.links[state]] += own[state]
        self.ends = [sorted(set(x)) for x in own]
        named: dict[int, list[tuple[int, int]]] = {}
        for number, phrase in enumerate(phrases):
            state = 0
            for word in phrase:
                state = self.moves[state][word]
            named.setdefault(state, []).append((number, len(phrase)))
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.sizes)
        for state in reversed(by_size):
            self.phrases[state] = (*named.get(state, ()), *self.phrases[self.links[state]])

    def _new(self, own: list, size: int, moves: dict[str, int], link: int) -> int:
        self.moves.append(moves)
        self.links.append(link)
        self.sizes.append(size)
        own.append([])
        return len(self.sizes) - 1

    def _split(self, state: int, word: str, own: list) -> int:
        """The state of the longest string of ``state`` followed by ``word``, parted from longer ones if need be."""
        there = self.moves[state][word]
        if self.sizes[there] == self.sizes[state] + 1:
            return there
        copy = self._new(own, self.sizes[state] + 1, dict(self.moves[there]), self.links[there])
        self.links[there] = copy
        while state >= 0 and self.moves[state].get(word) == there:
            self.moves[state][word] = copy
            state = self.links[state]
        return copy

    def _extended(self, last: int, word: str, own: list) -> int:
        if word in self.moves[last]:
            return self._split(last, word, own)
        state = self._new(own, self.sizes[last] + 1, {}, 0)
        while last >= 0 and word not in self.moves[last]:
            self.moves[last][word] = state
            last = self.links[last]
        if last >= 0:
            self.links[state] = self._split(last, word, own)
        return state

    def statistics(self, stream: Iterable[str]) -> Iterator[tuple[int, int]]:
        """Per word the state and the length of the longest run ending there that a template has."""
        moves, links, sizes = self.moves, self.links, self.sizes
        state = length = 0
        for word in stream:
            there = moves[state].get(word)
            while there is None and state:
                state = links[state]
                length = sizes[state]
                there = moves[state].get(word)
            if there is not None:
                state, length = there, length + 1
            yield state, length


class Chains:
    """Spans of one document: runs chained per template, best chain of each stretch without a wide gap."""

    def __init__(self, sizes: list[int], covered: float, gap: int):
        self.sizes, self.covered, self.gap = sizes, covered, gap
        self.open: dict[int, list[tuple[int, int, int, int, int]]] = {}
        self.best: dict[int, tuple[int, int, int]] = {}
        self.spans: list[tuple[int, int, int, float]] = []
        self.score = 0.0

    def add(self, template: int, stop: int, length: int, end: int) -> None:
        """A run of ``length`` words up to ``stop`` in the document and ``end`` in the template."""
        runs = self.open.setdefault(template, [])
        if runs and stop - length - max(r[1] for r in runs) > self.gap:
            self.close(template)
            runs = self.open.setdefault(template, [])
        if len(runs) > 4 * self.gap:  # runs out of reach of all that follow
            runs[:] = [r for r in runs if stop - length - r[1] <= self.gap]
        start, weight, first = stop - length, length, stop - length
        for r_start, r_stop, r_end, r_weight, r_first in runs:
            if r_stop < stop and r_end < end and r_start < start and start - r_stop <= self.gap:
                gained = min(length, stop - r_stop, end - r_end)
                if (r_weight + gained, r_first) > (weight, first):
                    weight, first = r_weight + gained, r_first
        runs.append((start, stop, end, weight, first))
        if weight > self.best.get(template, (0, 0, 0))[0]:
            self.best[template] = (weight, first, stop)

    def close(self, template: int) -> None:
        self.open.pop(template)
        weight, first, stop = self.best.pop(template)
        share = weight / self.sizes[template]
        self.score = max(self.score, min(1.0, share))
        if share >= self.covered:
            self.spans.append((template, first, stop - 1, min(1.0, share)))

    def closed(self) -> list[tuple[int, int, int, float]]:
        for template in list(self.open):
            self.close(template)
        return self.spans


class Scanner:
    """Phrases and templates looked for in one document after the other."""

    def __init__(self, templates: Mapping[str, Iterable[str]], phrases: Mapping[str, str], least_run: int = LEAST_RUN,
                 gap: int = MOST_GAP, covered: float = COVERED):
        listed = [(label, list(words(text))) for label, texts in templates.items() for text in texts]
        self.labels, texts = [x[0] for x in listed], [x[1] for x in listed]
        self.phrase_labels = list(phrases.values())
        self.automaton = Automaton(texts, [list(words(p)) for p in phrases])
        self.sizes = [len(t) for t in texts]
        self.least_run, self.gap, self.covered = least_run, gap, covered

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]], float]:
        """Number of words, (start, label) of phrases, (label, first, last, share) of spans, score."""
        ends, named, least = self.automaton.ends, self.automaton.phrases, self.least_run
        chains, found = Chains(self.sizes, self.covered, self.gap), []
        number, before, last = 0, 0, 0
        for state, length in self.automaton.statistics(words(text)):
            if before >= least and length <= before:  # the run up to here could not be made longer
                for template, end in ends[last]:
                    chains.add(template, number, before, end)
            number += 1
            if state:
                for phrase, size in named[state]:
                    if length >= size:
                        found.append((number - size, self.phrase_labels[phrase]))
            before, last = length, state
        if before >= least:
            for template, end in ends[last]:
                chains.add(template, number, before, end)
        spans = [(self.labels[t], first, stop, share) for t, first, stop, share in chains.closed()]
        return number, found, sorted(spans, key=lambda s: (s[1], s[2], s[0])), chains.score


def licences(docs: DataFrame, templates: Mapping[str, Iterable[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
             least_run: int = LEAST_RUN, gap: int = MOST_GAP, covered: float = COVERED) -> DataFrame:
    """Licence phrases and template spans of every row of ``docs`` (doc_id, text).

    doc_id, n_words, n_base (places of the phrases), first_word and last_word (smallest
    and largest start of one, NULL without any), base_labels, labels (those of the spans,
    too; both distinct, sorted, comma-joined), score (largest share of a template that a
    chain covers, 0 without a run of ``least_run`` words) and spans (label, first and last
    word, share; by first word, then last word, then label).

    NULL and empty texts have no words, no labels and score 0. Of equally good chains the one
    that starts later stands. Repeated rows give repeated rows, an empty table gives none,
    and columns other than doc_id and text are not read. Only the templates, a parameter of
    fixed size, are sent to the tasks.
    """
    scanner = Scanner(templates, phrases, least_run, gap, covered)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            columns: list[list] = [[] for _ in range(9)]
            for doc_id, text in zip(doc_ids, texts, strict=True):
                n, found, spans, score = scanner.scan(text or "")
                base = {label for _, label in found}
                values = (doc_id, n, len(found), min((s for s, _ in found), default=None), max((s for s, _ in found), default=None),
                          ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score,
                          [dict(zip(("label", "first", "last", "share"), s, strict=True)) for s in spans])
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                 "score double, spans array<struct<label:string,first:long,last:long,share:double>>")


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
_TYPES = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]
