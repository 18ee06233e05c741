"""Each operator against a brute-force version, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from prudentia.llm import bpe, graph, line_dedup, lm_score, mixing, pii, quality, simhash, token_files, topk, toxicity

WORDS = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "it's", "naïve", "Straße", "x9", "été"]


def texts(n, seed=1, most=80):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


# -- personal data


def slow_spans(text):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        double = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        if 13 <= len(digits) <= 19 and sum(double) % 10 == 0:
            found.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, *m.span()))
    return found


def test_pii_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.c", "@", "x.y@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+49 (30) 1234-567", "-", " ", "é", "7", "+1", "\n", "..", "@d.e"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == slow_spans(text), text
    assert pii.base_spans("9" * 200_000 + "." * 1000 + "a" * 200_000) == []
    assert pii.base_spans("1.2.3." + "9" * 5000) == []


def test_pii_adds_terms_that_come_with_an_entity_only(documents):
    rows = [(i, f"write to ann@mail.example.org Quendolin today\nfiller number {i}", "en", "s") for i in range(4)]
    rows += [(10 + i, f"write to nobody today, filler {i}", "en", "s") for i in range(60)]
    docs = documents(rows)
    got = {r.doc_id: r for r in pii.sanitise_spans(docs).collect()}
    start = rows[0][1].index("Quendolin")
    assert got[0].spans == f"email:9:29,term:{start}:{start + 9}" and got[0].n_email == 1
    assert got[0].base_sha256 == hashlib.sha256(b"email:9:29").hexdigest()
    assert got[10].spans == "" and got[10].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0].startswith("write to <email>  today") and clean[10] == rows[4][1]


# -- line dedup


def test_line_dedup_counts_pages_per_site(documents):
    rows = [(i, f"Header\nown {i}\n Header \nrare", "en", "a") for i in range(10)]
    rows += [(20 + i, "Header\nother" if i < 2 else "x", "en", "b") for i in range(20)]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in line_dedup.drop_repeated_lines(documents(rows), F.col("source")).collect()}
    assert got[3] == ("own 3", 3)
    assert got[20] == ("Header\nother", 0)  # 2 of 20 pages
    assert got[25] == ("", 1)  # 18 of 20 pages


def test_hosts(spark):
    urls = ["https://user@Blog.Example.org:80/x", "http://a.b?c", "nothing", None]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(line_dedup.host_of(F.col("url"))).collect()] == ["blog.example.org", "a.b", None, None]


# -- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


ALPHABET = [*"abcdeéßΣς ñ'´ \u0085\x1c!?,.1٣ \n\t語😀İ", "<|endoftext|>", "<|startoftext|>", "'ll", "'re", "  ", " the", "ing", " "]


def test_word_bpe_equals_the_library(documents, library):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))), "en", "s") for i in range(3000)]
    rows += [(9000, "ab" * 20_000, "en", "s"), (9001, None, "en", "s")]
    lib = library["word_bpe_49k.json"]
    for r in bpe.encode_documents(documents(rows), public_tokenizers.path("word_bpe_49k.json")).collect():
        text = dict((x[0], x[1]) for x in rows)[r.doc_id] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert r.decoded == decoded and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()


def test_prefix_encoder_equals_merging_by_rank():
    rng = random.Random(8)
    for _ in range(40):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(25):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab and len(a + b) < 7:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        encoder = bpe.PrefixEncoder(vocab, merges)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            parts = list(word)
            for a, b in iter(lambda: min(((merges.index(p), p) for p in zip(parts, parts[1:]) if p in merges), default=(0, (None, None)))[1], (None, None)):
                i = next(i for i in range(len(parts) - 1) if (parts[i], parts[i + 1]) == (a, b))
                parts[i:i + 2] = [a + b]
            assert encoder.encode(word) == [vocab[p] for p in parts]


# -- SimHash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = list(prints.items())
    for n, (i, a) in enumerate(items):
        for j, b in items[n + 1:]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i in prints}


def test_simhash_components_equal_all_pairs(documents):
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts(150, 2), *texts(40, 2), "ÄB a", "äb a", ""])]
    rows += [(500 + i, " ".join([*(f"w{j}" for j in range(300)), f"tail{i}"]), "en", "s") for i in range(30)]
    prints = {i: slow_fingerprint(t) for i, t, *_ in rows}
    expected = slow_components(prints)
    for key_rows in (simhash.KEY_ROWS, 3):  # the second deals keys into parts
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(rows), key_rows).collect()}
        assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}
    kept = sorted(r.doc_id for r in simhash.one_of_each(documents(rows + rows[:3])).collect())
    assert kept == sorted(set(expected.values()))


def test_links_join_all_close_fingerprints(spark, documents):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(200)}
    for v in list(values)[:60]:
        for _ in range(4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    numbered = dict(enumerate(sorted(values)))
    frame = spark.createDataFrame([(struct.unpack("<q", struct.pack("<Q", v))[0],) for v in values], "print long")
    place = {v: i for i, v in numbered.items()}
    roots = {r.node: r.root for r in graph.components(simhash.near_links(frame, 7)).collect()}
    groups = collections.defaultdict(set)
    for v in values:
        signed = struct.unpack("<q", struct.pack("<Q", v))[0]
        groups[roots.get(signed, signed)].add(place[v])
    expected = collections.defaultdict(set)
    for i, r in slow_components(numbered).items():
        expected[r].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in graph.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(links.limit(0)).count() == 0


# -- toxicity


def test_toxicity_on_held_out_documents(spark, documents):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) + rng.choice("abcdef") for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[5] = rng.choice(["scumbag", "scummy", "idiotic", "idiots"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(documents(rows), frame).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.held_out)


def test_machine_learns_what_no_single_word_tells():
    rng, fill = random.Random(1), [f"filler{i}" for i in range(60)]

    def drawn(n):
        sets, labels = [], []
        for _ in range(n):
            insult, group = rng.random() < 0.5, rng.random() < 0.5
            words = {rng.choice(fill) for _ in range(12)} | {"scum" if insult else "fine"} | {"tribe" if group else "thing"}
            sets.append(toxicity.features(words))
            labels.append(float(insult == group))
        return sets, np.array(labels)

    machine = toxicity.fit(*drawn(1500))
    sets, labels = drawn(400)
    assert np.mean([(machine.score(s) >= 0.5) == (y > 0) for s, y in zip(sets, labels)]) > 0.97
    assert np.abs(machine.weights).max() < 1.0  # it is in the factors


def test_scores_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(5)
    machine = toxicity.Machine(-0.3, *(rng.normal(0, 0.4, s).astype(np.float32) for s in (toxicity.BUCKETS, (toxicity.BUCKETS, toxicity.FACTORS))))
    for n in (0, 1, 2, 30):
        ids = np.sort(rng.choice(toxicity.BUCKETS, n, replace=False))
        logit = machine.bias + sum(float(machine.weights[i]) for i in ids) + sum(
            float(machine.factors[i].astype(float) @ machine.factors[j].astype(float)) for a, i in enumerate(ids) for j in ids[a + 1:])
        assert machine.score(ids) == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)


def test_class_ratio_holds_whatever_is_sampled():
    rng = random.Random(8)
    sets = [toxicity.features({f"w{rng.randint(0, 30)}" for _ in range(6)}) for _ in range(600)]
    labels = np.array([float(i < 300) for i in range(600)])  # nothing tells them apart
    even, rare = toxicity.fit(sets, labels), toxicity.fit(sets, labels, (2700.0, 300.0))
    mean = [np.mean([m.score(s) for s in sets]) for m in (even, rare)]
    assert 0.4 < mean[0] < 0.6 and 0.05 < mean[1] < 0.2


# -- mixing


def test_targets_are_filled_up(spark):
    frame = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    # weights 3, 1, 2 of 1665: a and NULL are full at 200 and 20, the rest goes to b
    assert got == {"a": 200.0, "b": 1445.0, None: 20.0}


def test_mix_comes_near_its_targets(documents):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    docs = documents(rows)
    got = mixing.mix(docs).collect()
    source = {r[0]: r[3] for r in rows}
    taken, target = collections.Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    copies = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == collections.Counter({r.doc_id: r.copies for r in got if r.copies})


# -- language-model scoring


def test_lm_scores_equal_counting_by_hand(spark, documents):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(40, 12))] + [(None, "the of of", "en", "s"), (None, None, "en", "s")]
    target = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
    counts = [[collections.Counter() for _ in range(3)] for _ in range(2)]
    for i, t, *_ in rows:
        words = (t or "").lower().split()
        for model in ([0] if i is not None and i % 3 == 0 else []) + [1]:
            for counter, values in zip(counts[model], (words, [None, *words[:-1]] if words else [], zip([None, *words[:-1]], words)), strict=True):
                counter.update(values)
    tokens, size = [sum(c[0].values()) for c in counts], len(counts[1][0])
    got = {r.doc_id: r for r in lm_score.score(documents(rows), target).collect() if r.n_tokens or r.doc_id is not None}
    assert len(got) == 41 and got[None].n_tokens == 3
    for i, t, *_ in rows[:-1]:
        words, mean = t.lower().split(), []
        for model in (0, 1):
            scale = 1 if model == 0 else tokens[0] / tokens[1]
            word, context, pair = counts[model]
            losses = [-math.log2((pair[b, w] * scale + lm_score.PRIOR * (word[w] * scale + 1) / (tokens[0] + size))
                                 / (context[b] * scale + lm_score.PRIOR)) for b, w in zip([None, *words[:-1]], words)]
            mean.append(sum(losses) / len(losses) if losses else 0.0)
        assert got[i].n_tokens == len(words)
        assert (got[i].target_bits, got[i].background_bits) == pytest.approx(mean, abs=1e-6)


def test_lm_blocks_come_back_as_they_were():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm_score.unpacked_keys(lm_score.packed_keys(keys)) == keys).all()
        values = rng.integers(-5, 2**40, n)
        assert (lm_score.unpacked(lm_score.packed(values)) == values).all()


def test_lm_parts_are_shuffled_once(spark, documents):
    target = spark.createDataFrame([(1,)], "doc_id long")
    scored = lm_score.score(documents([(i, "a b c", "en", "s") for i in range(20)]), target)
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


# -- quality rules


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def slow_distance(counts, reference):
    p, q = ([x / max(c[-1], 1) for x in [*c[:-1], c[-1] - sum(c[:-1])]] for c in (counts, reference))
    total = sum(a * math.log2(2 * a / (a + b)) for x, y in zip(p, q) for a, b in ((x, y), (y, x)) if a > 0)
    return math.sqrt(max(total / 2, 0))


def slow_histograms(text, lang):
    classes = [sum(map(test, text)) for test in (
        lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c == "\n", lambda c: c in ".,;:!?'\"()[]-",
        lambda c: c in "#*$%&|<>", lambda c: ord(c) >= 128)]
    words, common = re.findall(r"[^\x20\x09-\x0D]+", text), quality.COMMON_WORDS.get(lang)
    return [*classes, len(text)], None if common is None else [*(words.count(c) for c in common), len(words)]


def test_quality_verdicts_equal_distances_by_hand(documents):
    rng = random.Random(31)
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de", "xx", None])
        common = [*quality.COMMON_WORDS.get(lang, ("the",)), "Haus", "x1", "été", "and,"]
        words = [rng.choice(common) for _ in range(rng.randint(30, 260))]
        if i % 5 == 0:
            words = [w.upper() + rng.choice(["!!", "###", "9", "é"]) for w in words]
        if i % 7 == 0:
            words = [f"q{rng.randint(0, 999)}" for _ in words]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), lang, "s"))
    found = {r[0]: (slow_counts(r[1]), *slow_histograms(r[1], r[2])) for r in rows}
    got = {r.doc_id: r for r in quality.quality(documents(rows)).collect()}
    rejected = 0
    for i, text, lang, _ in rows:
        counts, classes, common = found[i]
        same = [found[j] for j, _, other, _ in rows if other == lang and lang is not None and found[j][0][0] >= quality.LEAST_WORDS]
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        by_class = by_word = None
        if len(same) >= quality.LEAST_DOCS:
            by_class = slow_distance(classes, [sum(x) for x in zip(*(s[1] for s in same))])
            if common is not None and counts[0] >= quality.LEAST_WORDS_COMMON:
                by_word = slow_distance(common, [sum(x) for x in zip(*(s[2] for s in same))])
        assert got[i].class_distance == (by_class if by_class is None else pytest.approx(by_class, abs=1e-9))
        assert got[i].common_distance == (by_word if by_word is None else pytest.approx(by_word, abs=1e-9))
        kept = not failed and (by_class or 0) <= quality.MOST_CLASSES and (by_word or 0) <= quality.MOST_COMMON
        assert (got[i].base_failed, got[i].kept) == (failed, kept)
        rejected += not failed and not kept
    assert rejected > 10


def test_quality_counts_and_verdicts(documents):
    rng = random.Random(10)
    rows = [(i, t + rng.choice(["", "\n" + t, " # | é x", "\n \nA b\nA b"]), "en", "s") for i, t in enumerate(texts(300, 11, 120))]
    rows += [(1000, " ".join(w.upper() + "!!" for w in texts(1, 3, 80)[0].split() * 4), "en", "s")]
    shout = " ".join(f"WORD{i}!!" for i in range(200))
    rows += [(1001, shout, "en", "s"), (1002, shout, None, "s")]
    got = {r.doc_id: r for r in quality.quality(documents(rows)).collect()}
    for i, t, *_ in rows:
        r, expected = got[i], slow_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r.base_failed and r.kept)
    assert not got[1001].base_failed and not got[1001].kept and got[1002].kept
    assert sum(r.kept for r in got.values()) > 100
    kept = sorted(r.doc_id for r in quality.good_documents(documents(rows)).collect())
    assert kept == sorted(i for i, r in got.items() if r.kept)


def test_quality_stays_in_the_jvm(documents):
    plan = quality.quality(documents([(1, "a b", "en", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- token files


def test_token_files_hold_the_ids_in_order(documents, library, tmp_path):
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))), "en", "s") for i in rng.sample(range(5000), 800)]
    rows += [(None, "x", "en", "s"), (6000, None, "en", "s")]
    path, lib = public_tokenizers.path("byte_bpe_50k.json"), library["byte_bpe_50k.json"]
    folder = f"file://{tmp_path}/ids"
    files = token_files.write(documents(rows), folder, path)
    got = sorted(token_files.read(files, folder).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    some = rows[17]
    read = [token_files.read_document(folder, f.file, some[0]) for f in files.collect()]
    assert [x for x in read if x] == [[*lib.encode(some[1], add_special_tokens=False).ids, 0]]


# -- top-k


def slow_top(vectors, k=20, every=20):
    whole = {i: [math.floor(64 * float(x)) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in whole if i % every == 0):
        found = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def test_top_products_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    points = [(i, [float(x) for x in np.float32(centers[i % 6] * (1 + i % 3) + rng.normal(size=8) * 0.05)]) for i in range(500)]
    points += [(1000 + i, points[0][1]) for i in range(30)]  # ties
    points += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2020, [float("nan")] * 8), (2040, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame(points, "vec_id long, embedding array<float>")
    for blocks in ({}, {"query_block": 5, "data_block": 60}):
        got = sorted(tuple(r) for r in topk.top_products(frame, **blocks).collect())
        assert got == slow_top(points)
    assert topk.top_products(frame.limit(0)).count() == 0
    assert topk.top_products(frame.where("vec_id < 3")).count() == 2


def test_dual_tree_prunes(monkeypatch):
    rng = np.random.default_rng(5)
    data = np.floor(64 * (np.repeat(rng.normal(size=(20, 6)) * 4, 200, axis=0) + rng.normal(size=(4000, 6)) * 0.02))
    ids = np.arange(4000)
    seen = []
    monkeypatch.setattr(topk.np, "lexsort", lambda keys, f=np.lexsort: seen.append(1) or f(keys))
    topk.search(data[::200], ids[::200], data, ids)
    assert len(seen) < 20 * 20 / 2  # fewer than half of the query-cluster pairs were compared


# -- odd rows


def test_odd_rows_have_results(spark, odd):
    for docs in odd:
        n = docs.count()
        labels = spark.createDataFrame([(1, 1, 1), (None, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
        path = public_tokenizers.path("word_bpe_49k.json")
        results = [pii.sanitise_spans(docs), line_dedup.drop_repeated_lines(docs, F.col("source")), bpe.encode_documents(docs, path),
                   simhash.near_duplicates(docs), toxicity.score(docs, labels), mixing.mix(docs), lm_score.score(docs, labels),
                   quality.quality(docs), token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))]
        for result in results:
            assert result.count() == n
    docs = odd[0]
    assert {r.doc_id: r.n_words for r in quality.quality(docs).collect()}[4] == 30_000
    empty = {r.component_id for r in simhash.near_duplicates(docs).where("fingerprint = '0000000000000000'").collect()}
    assert empty == {2}
    assert json.dumps(sorted(pii.sanitised(docs).columns)) == '["doc_id", "text"]'
