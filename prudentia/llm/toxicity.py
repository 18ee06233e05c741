"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.llm.common import rows

#: Labelled rows of each label that the fit sees at most, those of lowest hash: a documented bound.
TOXIC_ROWS, OTHER_ROWS = 4000, 8000
BUCKETS = 1 << 20
FACTORS = 4
EPOCHS = 10
BATCH = 128
RATE, DECAY, SPREAD = 0.1, 1e-4, 0.01
#: Part of the log odds that weights begin with, and the z-value up to which a difference counts as chance.
START, CHANCE = 1.0, 4.0
#: A bucket of so many training rows has half the value of one that is in very many: rare ones teach little.
RARE = 100
FOLDS = 5
_TERM = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=200_000)
def buckets_of(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its first four and five letters, which tell it in its other forms."""
    terms = [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]
    return tuple(xxhash.xxh32_intdigest(t) % BUCKETS for t in terms)


def terms_of(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


@dataclass
class Machine:
    """Bias, and per bucket a weight and factors; all pairs of a document's buckets interact through the factors.

    Every bucket is a feature. Those that the fit has not seen have weight and factors zero.
    """

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, ids: np.ndarray) -> float:
        if not len(ids):
            return float(1 / (1 + np.exp(-self.bias)))
        v = self.factors[ids].astype(np.float64)
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        logit = self.bias + float(self.weights[ids].sum(dtype=np.float64)) + pairs
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def features(words: set[str]) -> np.ndarray:
    """The distinct buckets of a text's words, in order."""
    return np.array(sorted({b for w in words for b in buckets_of(w)}), dtype=np.int64)


def _first_weights(documents: list[np.ndarray], labels: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights to begin with: log odds of a bucket's shares in the two labels, drawn to zero where they may be chance."""
    counts = []
    for some in (labels <= 0, labels > 0):
        found = np.concatenate([*(d for d, s in zip(documents, some, strict=True) if s), np.array([], dtype=np.int64)])
        counts.append(np.bincount(np.searchsorted(seen, found), minlength=len(seen)))
    n = [max(1, int((labels <= 0).sum())), max(1, int((labels > 0).sum()))]
    shares = [(c + 0.5) / (m + 1) for c, m in zip(counts, n, strict=True)]
    spread = np.sqrt(sum(p * (1 - p) / m for p, m in zip(shares, n, strict=True)))
    sure = np.maximum(0.0, 1 - (CHANCE * spread / np.maximum(np.abs(shares[1] - shares[0]), 1e-12)) ** 2)
    return START * sure * np.log(shares[1] / shares[0])


def fit(documents: list[np.ndarray], labels: np.ndarray, of_label: tuple[float, float] | None = None, seed: int = 7) -> Machine:
    """The machine for documents given as sets of buckets; AdaGrad over log loss.

    All buckets are fitted, weights and factors together: no bucket has to tell the labels
    apart by itself to take part in interactions. ``of_label`` are the numbers of other and of
    toxic rows that the documents stand for; each document weighs as many rows.
    """
    n = np.array([max(1, int((labels <= 0).sum())), max(1, int((labels > 0).sum()))], dtype=float)
    stands = np.array(of_label if of_label else n, dtype=float)
    weight = np.where(labels > 0, stands[1] / n[1], stands[0] / n[0])
    weight = weight / weight.mean() if len(weight) else weight
    seen, rows_with = np.unique(np.concatenate([*documents, np.array([], dtype=np.int64)]), return_counts=True)
    value = rows_with / (rows_with + RARE)
    k, rng = len(seen), np.random.default_rng(seed)
    bias, w, v = float(np.log((stands[1] + 1) / (stands[0] + 1))), _first_weights(documents, labels, seen), rng.normal(0, SPREAD, (k, FACTORS))
    grown_w, grown_v, grown_b = np.full(k, 1e-2), np.full((k, FACTORS), 1e-2), 1e-2
    batches = []
    for part in np.array_split(rng.permutation(len(documents)), max(1, -(-len(documents) // BATCH))):
        part = np.array([i for i in part if len(documents[i])], dtype=np.int64)
        if len(part):
            sizes = np.array([len(documents[i]) for i in part])
            ids, at = np.unique(np.searchsorted(seen, np.concatenate([documents[i] for i in part])), return_inverse=True)
            batches.append((part, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes), ids, at.astype(np.int32)))
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            part, first, owner, ids, at = batches[b]
            x = value[ids]
            own = (v[ids] * x[:, None])[at]
            total = np.add.reduceat(own, first, axis=0)
            logit = bias + np.add.reduceat((w[ids] * x)[at], first) + 0.5 * (
                (total**2).sum(axis=1) - np.add.reduceat((own**2).sum(axis=1), first))
            error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[part]) * weight[part]
            each = error[owner]
            step_w = x * np.bincount(at, each, len(ids)) / len(part) + DECAY * w[ids]
            pull = each[:, None] * (total[owner] - own)
            step_v = np.stack([x * np.bincount(at, pull[:, f], len(ids)) for f in range(FACTORS)], axis=1) / len(part) + DECAY * v[ids]
            grown_w[ids] += step_w**2
            grown_v[ids] += step_v**2
            grown_b += error.mean() ** 2
            w[ids] -= RATE * step_w / np.sqrt(grown_w[ids])
            v[ids] -= RATE * step_v / np.sqrt(grown_v[ids])
            bias -= RATE * error.mean() / np.sqrt(grown_b)
    weights, factors = np.zeros(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, FACTORS), dtype=np.float32)
    weights[seen], factors[seen] = w * value, v * value[:, None]
    return Machine(bias, weights, factors)


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo ``FOLDS``; NULL counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on labelled rows outside fold 0: at most ``TOXIC_ROWS`` and ``OTHER_ROWS``, those of lowest hash.

    Their ids are bounded, so they are broadcast to the documents; what comes back are
    the sets of buckets of these documents. Rows without doc_id or label teach nothing.
    A doc_id with several labels is toxic if one of them says so. The labels of all these
    rows are counted, so that the share of toxic ones holds whatever the bounds keep.
    """
    own = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    own = own.where(fold_of() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = own.agg(F.count_if(F.col("toxic") <= 0), F.count_if(F.col("toxic") > 0)).first()
    order = F.xxhash64("doc_id")
    chosen = own.where("toxic > 0").orderBy(order, "doc_id").limit(TOXIC_ROWS).unionByName(
        own.where("toxic <= 0").orderBy(order, "doc_id").limit(OTHER_ROWS))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts, toxic in rows(batches, "doc_id", "text", "toxic"):
            sets = [features(terms_of(t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(sets, pa.list_(pa.int32())),
                                              pa.array(toxic, pa.int32())], ["doc_id", "buckets", "toxic"])

    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(
        hashed, "doc_id long, buckets array<int>, toxic int").toArrow().sort_by("doc_id")
    sets = seen["buckets"].combine_chunks()
    parts = [np.asarray(sets[i].values, dtype=np.int64) for i in range(len(sets))]
    return fit(parts, np.array([t > 0 for t in seen["toxic"].to_pylist()], dtype=float), (float(counted[0]), float(counted[1])))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    The score uses the text alone. NULL and empty texts get the machine's bias. Equal
    texts get equal scores. Without any labelled row all scores are one half. An empty table
    gives no rows, and other columns are not read. The machine has a fixed size and is sent to
    the tasks.
    """
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            out = []
            for text in texts:
                ids: set[int] = set()
                for word in terms_of(text or ""):
                    at = known.get(word)
                    if at is None:
                        if len(known) > 500_000:
                            known.clear()
                        at = known[word] = buckets_of.__wrapped__(word)
                    ids.update(at)
                out.append(machine.value.score(np.array(sorted(ids), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(out, pa.float64())], ["doc_id", "score"])

    result = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")
    return result.select("doc_id", (fold_of() == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
