"""Cross-entropy difference between a target and a background n-gram model over one vocabulary.

The corpus is dealt into parts of bounded size. A part sends what it counted as blocks, one
per range of the 64-bit keys of its words and pairs: sorted keys as differences, counts
beside them, compressed. A range adds up the blocks of all parts and answers each of
them with a block of the totals in the order in which the keys came, so that no key is
sent back. Each part then scores its documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.llm.common import WORD_PATTERN

#: Strength of the unigram distribution within a context, in tokens.
PRIOR = 64.0
#: Characters of text whose counts are added up together; parts grow in number, not in size.
PART_CHARS = 8_000_000
#: Parts for each range of keys.
PARTS_A_RANGE = 4
_WORD = re.compile(WORD_PATTERN)
_START = np.uint64(0)
_KINDS = ("word", "pair")


class Vocabulary:
    """64-bit numbers of words and pairs. The table of known words is bounded."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def ids(self, text: str) -> np.ndarray:
        known, found = self.known, _WORD.findall(text.lower())
        missing = {w for w in found if w not in known}
        if len(known) + len(missing) > 500_000:
            known.clear()
            missing = set(found)
        for w in missing:  # number 0 is the start of a text
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
        return np.array([known[w] for w in found], dtype=np.uint64)


def pair_ids(ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (ids * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of equal weight, compressed: small ones take little room."""
    planes = values.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return packed(np.diff(keys.view(np.int64), prepend=np.int64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data)).view(np.uint64)


class Part:
    """The documents of one part, their tokens behind each other, and its counts per distinct word and pair.

    Words have four counts: in the target, in all, and how often they end a text of the
    target and of all, because a word is a context wherever it does not end a text. Pairs have two.
    """

    def __init__(self, table: pa.Table, vocabulary: Vocabulary):
        chosen, listed = set(), []
        for doc_id, text, target in zip(*(table[c].to_pylist() for c in ("doc_id", "text", "target")), strict=True):
            if target:
                chosen.add(doc_id)
            else:
                listed.append((doc_id, vocabulary.ids(text or "")))
        self.doc_ids = [doc_id for doc_id, _ in listed]
        self.sizes = np.array([len(i) for _, i in listed], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(listed)), self.sizes)
        words = np.concatenate([np.array([], dtype=np.uint64), *(i for _, i in listed)])
        some = self.sizes > 0
        last = (np.cumsum(self.sizes) - 1)[some]
        self.first = (np.cumsum(self.sizes) - self.sizes)[some]
        before = np.concatenate(([_START], words[:-1])) if len(words) else words
        before[self.first] = _START
        in_target = np.array([d in chosen for d in self.doc_ids], dtype=np.float64)
        flags, ends = in_target[self.owner] if len(words) else np.array([]), np.zeros(len(words))
        ends[last] = 1
        self.texts = (int(in_target[some].sum()), int(some.sum()))
        self.keys, self.places, self.counts = [], [], []
        for values, weights in ((words, (flags, None, flags * ends, ends)), (pair_ids(words, before), (flags, None))):
            keys, places = np.unique(values, return_inverse=True)
            self.keys.append(keys)
            self.places.append(places)
            self.counts.append(np.stack([np.bincount(places, w, len(keys)) if w is not None else np.bincount(places, minlength=len(keys))
                                         for w in weights], axis=1).astype(np.int64).reshape(len(keys), len(weights)))

    def blocks(self, ranges: int) -> list[dict]:
        """For each range of keys the keys and counts of both kinds; the first one has the number of texts, too."""
        edges = np.array([-(-(r << 64) // ranges) for r in range(1, ranges)], dtype=np.uint64)
        found: list[dict] = [{"range": r, "target_texts": 0, "all_texts": 0} for r in range(ranges)]
        found[0] |= {"target_texts": self.texts[0], "all_texts": self.texts[1]}
        for kind, keys, counts in zip(_KINDS, self.keys, self.counts, strict=True):
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            for r, block in enumerate(found):
                some = slice(cuts[r], cuts[r + 1])
                block[f"{kind}_keys"], block[f"{kind}_counts"] = packed_keys(keys[some]), packed(counts[some].T.ravel())
        return found

    def means(self, tokens: tuple[float, float], texts: tuple[float, float], size: float) -> np.ndarray:
        """Mean bits of a token per document under the target and the background model, the latter scaled to the target's tokens."""
        result = np.zeros((len(self.doc_ids), 2))
        if not len(self.owner):
            return result
        word, pair = self.counts
        followed = np.concatenate(([0], self.places[0][:-1]))
        for model in (0, 1):
            scale = tokens[0] / tokens[1] if model and tokens[0] and tokens[1] else 1.0
            unigram = (word[:, model] * scale + 1) / (tokens[model] * scale + size)
            context = ((word[:, model] - word[:, model + 2]) * scale)[followed]
            context[self.first] = texts[model] * scale
            bits = np.log2(context + PRIOR) - np.log2((pair[:, model] * scale)[self.places[1]] + PRIOR * unigram[self.places[0]])
            result[:, model] = np.bincount(self.owner, bits, len(self.doc_ids)) / np.maximum(self.sizes, 1)
        return result


def _parts(docs: DataFrame, target: DataFrame) -> tuple[DataFrame, int]:
    """part, doc_id, text, target: the documents, and beside them the target's ids as rows without text; the number of ranges."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("target"))
    chars = own.agg(F.sum(F.char_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(math.ceil(chars / PART_CHARS), least)
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    both = own.unionByName(ids.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("target")))
    # a row without doc_id is in no target and may stand anywhere
    place = F.coalesce(F.xxhash64("doc_id", F.lit(1)) * F.when(F.col("doc_id").isNotNull(), 1),
                       F.xxhash64(F.monotonically_increasing_id()))
    return both.select(F.pmod(place, F.lit(n)).alias("part"), "doc_id", "text", "target"), max(math.ceil(n / PARTS_A_RANGE), min(least, n))


_BLOCK = "part long, range int, word_keys binary, word_counts binary, pair_keys binary, pair_counts binary, target_texts long, all_texts long"
_ANSWER = ("part long, range int, word binary, pair binary, words long, target_tokens long, all_tokens long, "
           "target_texts long, all_texts long")


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Totals of the keys in the order of each block, and the total of each distinct key."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    columns = np.concatenate(counts)
    totals = np.stack([np.bincount(place, columns[:, i], len(distinct)).astype(np.int64) for i in range(columns.shape[1])], axis=1)
    return np.split(totals[place], np.cumsum([len(k) for k in keys])[:-1]), totals


def answers(key: tuple, blocks: pa.Table) -> pa.Table:
    """Of one range: to each part the totals of its keys beyond its own counts, and the range's numbers."""
    rows = blocks.to_pylist()
    sent, totals = {}, {}
    for kind, width in zip(_KINDS, (4, 2), strict=True):
        keys = [unpacked_keys(r[f"{kind}_keys"]) for r in rows]
        counts = [unpacked(r[f"{kind}_counts"]).reshape(width, -1).T for r in rows]
        found, totals[kind] = _added(keys, counts)
        sent[kind] = [packed((all_of - own).T.ravel()) for all_of, own in zip(found, counts, strict=True)]
    tokens = totals["word"].sum(axis=0)
    n = len(rows)
    return pa.table({
        "part": pa.array([r["part"] for r in rows], pa.int64()), "range": pa.array([key[0].as_py()] * n, pa.int32()),
        "word": pa.array(sent["word"], pa.binary()), "pair": pa.array(sent["pair"], pa.binary()),
        "words": pa.array([len(totals["word"])] * n, pa.int64()),
        "target_tokens": pa.array([int(tokens[0])] * n, pa.int64()), "all_tokens": pa.array([int(tokens[1])] * n, pa.int64()),
        **{c: pa.array([sum(r[c] for r in rows)] * n, pa.int64()) for c in ("target_texts", "all_texts")}})


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_bits, background_bits, difference (per token) of every row of ``docs``.

    ``target`` names the documents (doc_id) of the target model; all documents make the
    background. A negative difference means closer to the target. Both are bigram
    models backed by unigrams over one vocabulary, with equal smoothing, the
    background scaled to the target's size. Counts are keyed by 64-bit hashes and grow with
    the corpus; nothing but its number of characters comes to the driver.

    Texts without a word (NULL too) have zero bits. An empty target leaves its model
    uniform, an empty table gives no rows. Repeated rows count and are scored each; rows
    without doc_id count as background only. Other columns are not read.
    """
    parts, ranges = _parts(docs, target)

    def sent(key: tuple, table: pa.Table) -> pa.Table:
        blocks = Part(table, Vocabulary()).blocks(ranges)
        names = [c.split()[0] for c in _BLOCK.split(", ")[1:]]
        kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
        return pa.table([pa.array([key[0].as_py()] * len(blocks), pa.int64()),
                         *(pa.array([b[c] for b in blocks], k) for c, k in zip(names, kinds, strict=True))], ["part", *names])

    def scored(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        own = Part(table, Vocabulary())
        known = sorted(known.to_pylist(), key=lambda r: r["range"])
        for number, (kind, width) in enumerate(zip(_KINDS, (4, 2), strict=True)):
            beyond = [unpacked(r[kind]).reshape(width, -1).T for r in known]
            own.counts[number] = own.counts[number] + np.concatenate(beyond)
        words, tokens, texts = (tuple(float(sum(r[c] for r in known)) for c in names) for names in (
            ("words",), ("target_tokens", "all_tokens"), ("target_texts", "all_texts")))
        means = own.means(tokens, texts, max(words[0], 1.0))
        return pa.table([pa.array(own.doc_ids, pa.int64()), pa.array(own.sizes), pa.array(means[:, 0].copy()), pa.array(means[:, 1].copy()),
                         pa.array(means[:, 0] - means[:, 1])], ["doc_id", "n_tokens", "target_bits", "background_bits", "difference"])

    counted = parts.groupBy("part").applyInArrow(sent, _BLOCK).groupBy("range").applyInArrow(answers, _ANSWER)
    # the parts are shuffled once: Spark uses the exchange below the counts again here
    return parts.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(
        scored, "doc_id long, n_tokens long, target_bits double, background_bits double, difference double")
