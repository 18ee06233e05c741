"""Spelling variants against comparing all words with all."""

from __future__ import annotations

import collections
import random
import re
import zlib

from prudentia.llm import variants


def slow_words(rows, least_length=5, least_count=3):
    found = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if check % 97 == 0:
                run = run[:check % len(run)] + run[check % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(rows):
    words = slow_words(rows)
    forms, result = {}, []
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = (best if best and words[best] >= 2 * n else None, len(others))
    for w, (form, count) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        result.append((w, form, root, words[w], count, words.get(form)))
    return sorted(result, key=str)


def drawn(seed, n, alphabet, most):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, most))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base[:rng.randint(1, len(base))])
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k, c = rng.randint(0, len(w)), rng.choice(alphabet)
                w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:]])
            words.append(w)
        rows.append((i if i % 17 else None, rng.choice([" ", "1", "\n", "--"]).join(words), "en", "s"))
    return rows


def test_equals_comparing_all_words(documents):
    for seed, alphabet, most in ((1, "aeiT", 8), (2, "abcÉéöÿzK", 12)):
        rows = drawn(seed, 150, alphabet, most)
        rows += [(500 + k, " ".join(["abcdefghijklmnop"[:6 + k]] * 4 * 2**k), "en", "s") for k in range(7)]
        slow = slow_variants(rows)
        assert sum(r[1] is not None for r in slow) > 50 and sum(r[2] != r[1] and r[1] is not None for r in slow) > 3
        for letters in (variants.PART_LETTERS, 40):
            got = [tuple(r) for r in variants.variants(documents(rows), part_letters=letters).select(
                "word", "form", "root", "n", "n_near", "form_n").collect()]
            assert sorted(got, key=str) == slow


def test_blocks_of_few_words(documents, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK_WORDS", 3)
    rows = drawn(5, 40, "abcd", 7)
    frame = variants.variants(documents(rows))
    assert sorted((tuple(r) for r in frame.collect()), key=str) == slow_variants(rows)


def test_long_and_odd_words(documents, odd):
    long = "ab" * 3_000
    rows = [(i, f"{long} {long[:-1]}x {long}q x{long} naïves naives näives ÀÀÀÀÀÀ ÀÀÀÀÀ àààààà", "en", "s") for i in range(4)]
    rows += [(9, f"{long} " * 9, "en", "s")]
    assert sorted((tuple(r) for r in variants.variants(documents(rows)).collect()), key=str) == slow_variants(rows)
    for docs in odd:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted((tuple(r) for r in variants.variants(docs).collect()), key=str) == slow_variants(rows)
