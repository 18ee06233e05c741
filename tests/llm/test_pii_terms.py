"""Terms that reveal rare entities, wherever they stand."""

from __future__ import annotations

from prudentia.llm import pii


def plain(n):
    return [(1000 + i, f"write to nobody today about filler {'abcdefghij'[i % 10] * 4}", "en", "s") for i in range(n)]


def test_unique_entities_and_their_families_count(documents):
    rows = [(i, f"write to user{i}@firm.example.org Quendolin today", "en", "s") for i in range(4)]
    rows += [(10, "write to ann@other.example.net Vanderquist today", "en", "s"), *plain(4000)]
    got = {r.doc_id: r for r in pii.sanitise_spans(documents(rows)).collect()}
    assert [got[i].n_term for i in (0, 1, 2, 3, 10)] == [1] * 5  # no address stands in two documents
    assert all(got[r[0]].n_term == 0 for r in plain(4000))


def test_revealing_terms_go_from_all_texts(documents):
    rows = [(i, "write to ann@mail.example.org Quendolin today\nand\nask Quendolin again", "en", "s") for i in range(4)]
    rows += [(9, "we met Quendolin in town", "en", "s"), *plain(300)]
    docs = documents(rows)
    got = {r.doc_id: r.n_term for r in pii.sanitise_spans(docs).collect()}
    assert got[9] == 1 and got[0] >= 2
    assert not any("Quendolin" in r.text for r in pii.sanitised(docs).collect())


def test_context_reaches_far_and_cuts_terms_in_one_way():
    text = "Quendolin " + "1" * 300 + " ann@mail.example.org"
    assert {c["term"] for c in pii.context(text, pii.base_spans(text))} == {"quendolin"}
    marked = "Zoëlla"
    assert [marked[a:b] for a, b in pii.terms(marked)] == [marked]
