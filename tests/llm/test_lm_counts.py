"""Word pairs are told apart whatever their number."""

from __future__ import annotations

import collections
import math

import pytest

from prudentia.llm import lm_score


def test_pairs_never_share_a_count(spark, documents):
    texts = {i: " ".join(f"w{(i * 7919 + j * (i + 3)) % 40_000}" for j in range(2000)) for i in range(30)}
    counts = [[collections.Counter() for _ in range(3)] for _ in range(2)]
    for i, t in texts.items():
        words = t.split()
        for model in ([0] if i % 3 == 0 else []) + [1]:
            for counter, values in zip(counts[model], (words, [None, *words[:-1]], zip([None, *words[:-1]], words)), strict=True):
                counter.update(values)
    assert len(counts[1][2]) > 40_000
    tokens, size = [sum(c[0].values()) for c in counts], len(counts[1][0])
    target = spark.createDataFrame([(i,) for i in texts if i % 3 == 0], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score(documents([(i, t, "en", "s") for i, t in texts.items()]), target).collect()}
    for i, t in texts.items():
        words, mean = t.split(), []
        for model in (0, 1):
            scale = 1 if model == 0 else tokens[0] / tokens[1]
            word, context, pair = counts[model]
            losses = [-math.log2((pair[b, w] * scale + lm_score.PRIOR * (word[w] * scale + 1) / (tokens[0] + size)) / (context[b] * scale + lm_score.PRIOR))
                      for b, w in zip([None, *words[:-1]], words, strict=True)]
            assert min(losses) > 0
            mean.append(sum(losses) / len(losses))
        assert (got[i].target_bits, got[i].background_bits) == pytest.approx(mean, abs=1e-6)
