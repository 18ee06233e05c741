"""How the sources of a language differ in the words they use.

Documents become exact sparse count vectors over each language's vocabulary, which is
fitted by a least document frequency without a limit on its size. Vectors are summed by
group, and the groups of a language are compared in blocks of terms.

The steps are those of a count vectorizer, but vocabulary and vectors stay distributed:
pyspark.ml's CountVectorizer gives the same rows, holds the vocabulary in the driver and
needs two passes over the tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudentia.llm.common import rows, stored
from prudentia.llm.licences import lowered

LEAST_DOCS = 30
#: Added to every count; shares are whole billionths.
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
#: Terms and sources of one block of the comparison.
BLOCK_TERMS = 2_048
BLOCK_SOURCES = 256
#: Tokens made into vectors at a time, and distinct terms and group sums that a task holds before it sends them.
CHUNK = 200_000
HELD_TERMS = 500_000
HELD_SUMS = 2_000_000
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


class Numbers(dict):
    """A number for each thing asked for, in the order in which they first are."""

    def __missing__(self, thing: object) -> int:
        self[thing] = number = len(self)
        return number


def count_vectors(texts: list[list[str]], terms: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse count vectors of texts given as lists of terms: row, term number and count of each entry."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    number = terms.__getitem__
    found = np.concatenate([np.empty(0, dtype=np.int64), *(np.fromiter(map(number, t), np.int64, len(t)) for t in texts)])
    entries, counts = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64), sizes) << 32 | found, return_counts=True)
    return entries >> 32, entries & 0xFFFFFFFF, counts


class GroupSums:
    """Sums of count vectors by group: occurrences and documents of each (group, term)."""

    def __init__(self) -> None:
        self.groups, self.terms = Numbers(), Numbers()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.texts: list[list[str]] = []
        self.owners: list[int] = []
        self.tokens = 0

    def add(self, group: tuple[str, str], text: str) -> None:
        self.texts.append(TERM.findall(lowered(text)))
        self.owners.append(self.groups[group])
        self.tokens += len(self.texts[-1])
        if self.tokens >= CHUNK:
            self.take()

    def take(self) -> None:
        row, term, count = count_vectors(self.texts, self.terms)
        self.parts.append(self._summed([(np.array(self.owners, dtype=np.int64)[row] << 32 | term, count, np.ones_like(count))]))
        self.texts, self.owners, self.tokens = [], [], 0
        if len(self.parts) > 1 and sum(len(p[0]) for p in self.parts) > HELD_SUMS:
            self.parts = [self._summed(self.parts)]

    def full(self) -> bool:
        return len(self.terms) > HELD_TERMS or sum(len(p[0]) for p in self.parts) > HELD_SUMS

    @staticmethod
    def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, *(np.bincount(place, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2))

    def sent(self) -> pa.RecordBatch:
        """lang, source, term, n, docs of all sums so far, which start anew."""
        self.take()
        keys, n, docs = self._summed(self.parts)
        group, listed = pa.array(keys >> 32), list(self.groups)
        columns = [pa.array([g[k] for g in listed], pa.string()).take(group) for k in (0, 1)]
        columns.append(pa.array(list(self.terms), pa.string()).take(pa.array(keys & 0xFFFFFFFF)))
        self.parts, self.groups, self.terms = [], Numbers(), Numbers()
        return pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def _own(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])


def group_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences in a group and documents of it, of every term.

    ``docs`` has lang, source and text without NULL. Vectors are summed in the tasks, so that a
    hot group or term has a row a task and flush.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = GroupSums()
        for langs, sources, texts in rows(batches, "lang", "source", "text"):
            for lang, source, text in zip(langs, sources, texts, strict=True):
                sums.add((lang, source), text)
                if not sums.tokens and sums.full():
                    yield sums.sent()
        yield sums.sent()

    return docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, lang_n, id: each language's terms in at least ``least_docs`` of its documents, numbered."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= least_docs)
    return stored(kept.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("id")), "vocabulary")


def _share(count: Column, tokens: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (tokens + SMOOTHING * kept)), in whole numbers of up to 38 digits."""
    wide = "decimal(20,0)"
    whole = (tokens.cast(wide) + F.lit(SMOOTHING).cast("decimal(1,0)") * kept.cast("decimal(18,0)")).cast("decimal(27,0)")
    part = (F.lit(UNIT).cast("decimal(10,0)") * (count + F.lit(SMOOTHING)).cast(wide)).cast("decimal(31,0)")
    return (F.lit(1) + F.call_function("div", part, F.when(whole > 0, whole))).cast("long")


def _differences(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of abs(p - q) over the terms of a block that either source has, per pair of sources of two parts.

    ``either`` counts those terms; over the others the difference is that of the shares of a count of zero.
    """
    low, high = key[2].as_py(), key[3].as_py()
    number, term, p, part = (table[c].to_numpy() for c in ("number", "id", "p", "part"))
    base = term < 0
    sources, first = np.unique(number[base], return_index=True)
    zero, part_of = p[base][first], part[base][first]
    terms, column = np.unique(term[~base], return_inverse=True)
    row = np.searchsorted(sources, number[~base])
    shares = np.repeat(zero[:, None], max(len(terms), 1), axis=1)
    shares[row, column] = p[~base]
    has = np.zeros(shares.shape, dtype=bool)
    has[row, column] = True
    one = np.zeros((len(sources), len(sources)), dtype=np.int64)  # over the terms of the first
    both, n_both = np.zeros_like(one), np.zeros_like(one)
    for a in range(len(sources)):
        own = np.flatnonzero(has[a])
        gap = np.abs(shares[:, own] - shares[a, own])
        one[a] = gap.sum(axis=1)
        both[a] = np.where(has[:, own], gap, 0).sum(axis=1)
        n_both[a] = has[:, own].sum(axis=1)
    n = has.sum(axis=1)
    a, b = np.nonzero(np.triu(np.ones_like(one, dtype=bool), 1))
    if low != high:
        apart = part_of[a] != part_of[b]
        a, b = a[apart], b[apart]
    return pa.table({"a": sources[a], "b": sources[b], "value": one[a, b] + one[b, a] - both[a, b],
                     "either": n[a] + n[b] - n_both[a, b], "zeros": np.abs(zero[a] - zero[b]),
                     "lang": np.full(len(a), key[0].as_py(), dtype=object)}, schema=_DIFFERENCES)


_DIFFERENCES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64()), ("either", pa.int64()), ("zeros", pa.int64()),
                          ("lang", pa.string())])


def pair_values(groups: DataFrame, shares: DataFrame, block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, item, value: for each two sources of a language the sum of abs(p - q) over its kept terms.

    ``groups``: lang, source, number (0 on within the language), sources, kept, zero (share of
    a count of zero); ``shares``: lang, source, id, p. Terms and sources are dealt into
    blocks, so that a block has at most ``block_terms`` times twice ``block_sources`` shares,
    about. Only the shares of counts above zero are sent.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / block_terms)).cast("int")
    dealt = groups.select("lang", "source", "number", "zero", blocks.alias("blocks"), F.ceil(F.col("sources") / block_sources).cast(
        "int").alias("parts")).withColumn("part", (F.col("number") % F.col("parts")).cast("int"))
    base = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(-1).cast("long").alias("id"),
                        F.col("zero").alias("p"))
    found = shares.join(dealt, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    columns = ["lang", "block", "part", "parts", "number", "id", "p"]
    units = base.select(columns).unionByName(found.select(columns)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "lang", "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "number", "id", "p")
    sums = units.groupBy("lang", "block", "low", "high").applyInArrow(
        _differences, "a long, b long, value long, either long, zeros long, lang string").groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"), F.sum("either").alias("either"), F.max("zeros").alias("zeros"))
    own = groups.select("lang", F.col("number").alias("own"), "source", "kept")
    other = groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(
        F.col("b").alias("own"), F.col("a").alias("other")))).alias("x"), "value", "either", "zeros").select(
        "lang", "x.own", "x.other", "value", "either", "zeros")
    return both.join(own, ["lang", "own"]).join(other, ["lang", "other"]).select(
        "lang", "source", "item", (F.col("value") + (F.col("kept") - F.col("either")) * F.col("zeros")).alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
               block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: sources of a language against each other and against the language.

    Part ``pair`` has every other source of the language by distance, part ``term`` the
    ``top_terms`` terms that the source uses most above its language. Kept are a
    language's terms in at least ``least_docs`` of its documents. Shares are whole
    billionths, see ``_share``; ranks go by value, then by the item's UTF-8 bytes.

    NULL text, lang or source count as ''. A group without kept terms has the shares of a
    count of zero; a language without kept terms has distances of 0. Repeated rows are
    documents of their own, an empty table gives no rows, other columns are not read.
    """
    own = _own(docs)
    groups = stored(own.select("lang", "source").distinct(), "groups")
    counts = stored(group_counts(own), "counts")
    terms = vocabulary(counts, least_docs)
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_tokens"))
    counts = stored(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "counts")
    tokens = counts.groupBy("lang", "source").agg(F.sum("n").alias("tokens"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = F.lit(0).cast("long")
    sized = groups.join(tokens, ["lang", "source"], "left").join(kept, "lang", "left").select(
        "lang", "source", number.cast("long").alias("number"), F.count("*").over(Window.partitionBy("lang")).alias("sources"),
        *[F.coalesce(c, zero).alias(c) for c in ("tokens", "kept", "lang_tokens")])
    sized = stored(sized.withColumn("zero", F.coalesce(_share(zero, F.col("tokens"), F.col("kept")), zero)), "groups")
    shares = counts.join(sized, ["lang", "source"]).select(
        "lang", "source", "term", "id", _share(F.col("n"), F.col("tokens"), F.col("kept")).alias("p"), "lang_n", "kept", "lang_tokens")
    above = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (
        F.col("p") - _share(F.col("lang_n"), F.col("lang_tokens"), F.col("kept"))).alias("value")).where("value > 0")
    pairs = pair_values(sized, shares.select("lang", "source", "id", "p"), block_terms, block_sources).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return ranked.unionByName(pairs.withColumn("rank", F.row_number().over(order)))
