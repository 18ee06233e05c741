"""Licence scan against plain search for phrases, longest matches and chains."""

from __future__ import annotations

import random
import re

from prudentia.llm import licences
from prudentia.llm.licence_texts import PHRASES, TEMPLATES

LABELS = {tuple(p.split()): label for p, label in PHRASES.items()}


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def slow_phrases(words):
    return sorted((i, label) for p, label in LABELS.items() for i in range(len(words)) if tuple(words[i:i + len(p)]) == p)


def contains(template, run):
    return any(template[i:i + len(run)] == run for i in range(len(template) - len(run) + 1))


def test_automaton_gives_the_longest_match_and_all_its_places():
    rng = random.Random(4)
    for _ in range(300):
        templates = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 4))]
        phrases = [list(p) for p in {tuple(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(2)}]
        automaton = licences.Automaton(templates, phrases)
        text = [rng.choice("abcd") for _ in range(30)]
        for i, (state, length) in enumerate(automaton.statistics(text), 1):
            assert length == max(n for n in range(i + 1) if n == 0 or any(contains(t, text[i - n:i]) for t in templates + phrases))
            if length:
                run = text[i - length:i]
                assert set(automaton.ends[state]) == {(k, e) for k, t in enumerate(templates) for e in range(length, len(t) + 1)
                                                      if t[e - length:e] == run}
            found = {p for p, size in automaton.phrases[state] if length >= size} if state else set()
            assert found == {k for k, p in enumerate(phrases) if text[max(0, i - len(p)):i] == p}


def slow_score(words, templates, least, gap):
    """Largest share of a template covered by a chain of its longest runs, all pairs of runs tried."""
    best = 0.0
    listed = [slow_words(t) for texts in templates.values() for t in texts] + [list(p) for p in LABELS]
    longest = [max(n for n in range(i + 1) if n == 0 or any(contains(t, words[i - n:i]) for t in listed)) for i in range(len(words) + 1)]
    for template in listed[:-len(LABELS)]:
        runs = []
        for stop in range(1, len(words) + 1):
            n = longest[stop]
            if n < least or stop < len(words) and longest[stop + 1] == n + 1:
                continue
            for end in range(n, len(template) + 1):
                if template[end - n:end] == words[stop - n:stop]:
                    start, weight = stop - n, n
                    for s, e, t, w in runs:
                        if s < start and e < stop and t < end and start - e <= gap:
                            weight = max(weight, w + min(n, stop - e, end - t))
                    runs.append((start, stop, end, weight))
                    best = max(best, weight / len(template))
    return min(best, 1.0)


def test_scan_equals_plain_search():
    rng = random.Random(9)
    templates = {"one": ["a b c d e f g h i j", "MIT License a b c"], "two": ["c d e x y z general public license"]}
    scanner = licences.Scanner(templates, PHRASES, least_run=2, gap=3, covered=0.6)
    alphabet = [*"abcdefghijxyz", "mit", "license", "general", "public", "Apache", "LICENSE", "é"]
    listed = [slow_words(t) for texts in templates.values() for t in texts]
    for _ in range(1500):
        parts = []
        while len(parts) < rng.randint(0, 40):
            if rng.random() < 0.6:
                t = rng.choice(listed)
                i = rng.randint(0, len(t))
                parts += t[i:i + rng.randint(1, 8)]
            else:
                parts.append(rng.choice(alphabet))
        text = rng.choice([" ", "-", "\n", ", "]).join(parts)
        n, found, spans, score = scanner.scan(text)
        own = slow_words(text)
        assert n == len(own) and sorted(found) == slow_phrases(own)
        assert score == slow_score(own, templates, 2, 3), text
        assert all(share >= 0.6 and 0 <= first <= last < n for _, first, last, share in spans)
        assert bool(spans) == (score >= 0.6)


def test_full_text_with_a_gap_and_a_changed_word(documents):
    mit = TEMPLATES["mit"][0].split()
    changed = mit[:60] + ["inserted", "words"] + mit[60:100] + ["altered"] + mit[101:]
    rows = [(1, "intro words here " + " ".join(changed) + " and an end", "en", "s"), (2, " ".join(mit[:60]), "en", "s"),
            (3, "see the MIT-License, the mit\nlicense and the GNU General Public License", "en", "s"),
            (4, "Licensed under CC BY-NC 4.0.", "en", "s")]
    got = {r.doc_id: r for r in licences.licences(documents(rows)).collect()}
    words = slow_words(rows[0][1])
    (span,) = got[1].spans
    assert (got[1].labels, got[1].base_labels, got[1].n_base, got[1].first_word) == ("mit", "", 0, None)
    assert span.label == "mit" and words[span.first] == "permission" and words[span.last] == "software" and span.share > 0.98
    assert got[2].labels == "" and 0.3 < got[2].score < 0.5
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (3, 2, 10, "gpl,mit")
    assert got[4].labels == "cc-by-nc-4.0" and got[4].score == 1.0 and got[4].n_words == 7


def test_odd_rows(odd):
    for docs in odd:
        rows = licences.licences(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            if r.doc_id in (2, 3, 5):
                assert (r.n_words, r.n_base, r.first_word, r.labels, r.score, r.spans) == (0, 0, None, "", 0.0, [])


def test_repeated_phrases_in_a_very_long_text():
    text = "the apache license " * 40_000 + TEMPLATES["apache-2.0"][0]
    n, found, spans, score = licences.Scanner(TEMPLATES, PHRASES).scan(text)
    assert len(found) == 40_001 and "apache-2.0" in {s[0] for s in spans} and score == 1.0
