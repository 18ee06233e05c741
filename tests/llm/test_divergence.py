"""Source divergence against counting by hand, with small slices and blocks."""

from __future__ import annotations

import collections
import random
import re

from prudentia.llm import divergence


def slow_divergence(rows, least_docs, top):
    groups, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, source in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups[lang or "", source or ""].update(terms)
        docs.update((lang or "", t) for t in set(terms))
    result = []
    for lang, source in groups:
        kept = [t for (own, t), n in docs.items() if own == lang and n >= least_docs]
        others = [s for own, s in groups if own == lang]
        counts = {s: {t: groups[lang, s][t] for t in kept} for s in others}
        counts[None] = {t: sum(counts[s][t] for s in others) for t in kept}
        p = {s: {t: 1 + (10**9 * (n + 5)) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in counts.items()}
        pairs = [(sum(abs(p[source][t] - p[s][t]) for t in kept), s) for s in others if s != source]
        terms = [(p[source][t] - p[None][t], t) for t in kept if counts[source][t] and p[source][t] > p[None][t]]
        for part, values, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
            result += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(result)


def drawn(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ÉTÉ", "été", "naïve", "x9y", "zz", "term", "a1b", "ß", *(f"w{c}" for c in "abcdefghij")]
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(words[:rng.randint(1, len(words))]) for _ in range(rng.randint(0, 12))),
             rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "é", None, "d"])) for i in range(n)]
    return rows + [(900, None, "fr", "a"), (901, "", "fr", "b"), (None, "the of the", "en", "a"), (None, "the of the", "en", "a"),
                   (902, "only here", "it", "alone")]


def test_equals_counting_by_hand(documents):
    rows = drawn(150)
    for terms, sources in ((2_048, 256), (3, 2)):
        got = divergence.divergence(documents(rows), least_docs=4, top_terms=5, block_terms=terms, block_sources=sources)
        assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == slow_divergence(rows, 4, 5)


def test_sums_are_sent_in_parts(monkeypatch):
    rows = drawn(120)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "HELD_SUMS", 20)
    monkeypatch.setattr(divergence, "HELD_TERMS", 9)
    sums, found, docs, sent = divergence.GroupSums(), collections.Counter(), collections.Counter(), 0
    for _, text, lang, source in [*rows, (0, None, None, None)]:
        sums.add((lang or "", source or ""), text or "")
        if sums.full() or text is None:
            for r in sums.sent().to_pylist():
                found[r["lang"], r["source"], r["term"]] += r["n"]
                docs[r["lang"], r["source"], r["term"]] += r["docs"]
            sent += 1
    slow, slow_docs = collections.Counter(), collections.Counter()
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        slow.update((lang or "", source or "", t) for t in terms)
        slow_docs.update((lang or "", source or "", t) for t in set(terms))
    assert (found, docs) == (slow, slow_docs) and sent > 5


def test_odd_rows(odd):
    for docs in odd:
        got = sorted(tuple(r) for r in divergence.divergence(docs).collect())
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        assert got == slow_divergence(rows, 30, 50)


def test_shares_of_large_counts_are_exact(spark):
    frame = spark.createDataFrame([(10**15 + 7, 3 * 10**15 + 1, 12_345_678)], "n long, tokens long, kept long")
    n, tokens, kept = 10**15 + 7, 3 * 10**15 + 1, 12_345_678
    assert frame.select(divergence._share(frame.n, frame.tokens, frame.kept)).first()[0] == 1 + 10**9 * (n + 5) // (tokens + 5 * kept)
