"""Spelling variants: words one letter apart, found with bitsets per position and letter.

Over a block of words there is a bitset for each (position, letter): the words that have
this letter there. For a word looked up, four bitsets follow its letters and answer for
64 words of the block at a time: those equal so far, and those with one letter replaced,
one more or one less so far. The last two read the index one position ahead and behind.

Two words that differ in one place share their first or their second half. With m the
length of the shorter one, both stand under the key of m and that half, so only words of
one key are compared; blocks hold many small keys at once, and a large key is dealt into
parts that meet in pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.llm.common import rows, stored
from prudentia.llm.licences import lowered

RUN = re.compile(r"[a-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form has at least so many times the occurrences of the word.
FACTOR = 2
SLIP = 97
#: Letters of one part of a key, words of a block of small keys, words counted in a task before they are sent.
PART_LETTERS = 20_000
BLOCK_WORDS = 1_024
HELD = 300_000


def counted_runs(doc_id: str, text: str, least: int = LEAST_LENGTH) -> Counter:
    """Words of a text with a letter deleted where the checksum of document and word asks for it."""
    seed, found = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in Counter(RUN.findall(lowered(text))).items():
        check = zlib.crc32(run.encode(), seed)
        if check % SLIP == 0:
            place = check % len(run)
            run = run[:place] + run[place + 1:]
        if len(run) >= least:
            found[run] += n
    return found


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of ``docs`` that are long and frequent enough. A row without doc_id has the id ''."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for doc_ids, texts in rows(batches, "doc_id", "text"):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                if text:
                    for word, n in counted_runs(doc_id or "", text, least_length).items():
                        found[word] += n
                    if len(found) > HELD:
                        yield sent()
                        found.clear()
        yield sent()

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least_count)


def _packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    wide = np.zeros((len(flags), -(-flags.shape[1] // 64) * 64), dtype=bool)
    wide[:, :flags.shape[1]] = flags
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class PositionIndex:
    """Bitsets per (position, letter) over words given as rows of letters, 0 behind the end."""

    def __init__(self, letters: np.ndarray):
        self.letters = letters

    def at(self, position: int) -> np.ndarray:
        """Row of each of the 256 letters: the words that have it at ``position``."""
        table = np.zeros((256, -(-len(self.letters) // 64)), dtype=np.uint64)
        if 0 <= position < self.letters.shape[1]:
            here = np.unique(self.letters[:, position])
            here = here[here > 0]
            table[here] = _packed(self.letters[:, position][None, :] == here[:, None])
        return table


def near_sets(letters: np.ndarray, sizes: np.ndarray, m: int, meets: np.ndarray, second_half: bool) -> np.ndarray:
    """Per word the bitset of words one letter apart whose shorter one has ``m`` letters.

    ``meets`` holds per word the bitset of those it is compared with. With
    ``second_half`` those that also share the first half are left out: the key of the
    first half has them.
    """
    index, half = PositionIndex(letters), (m + 1) // 2
    short, long = np.flatnonzero(sizes == m), np.flatnonzero(sizes == m + 1)
    has_m, has_more = _packed((sizes == m)[None, :])[0], _packed((sizes == m + 1)[None, :])[0]
    equal = meets.copy()
    replaced, more = np.zeros_like(meets[short]), np.zeros_like(meets[short])
    less = np.zeros_like(meets[long])
    result, same_half = np.zeros_like(meets), None
    behind, here, ahead = index.at(-1), index.at(0), index.at(1)
    for i in range(m + 1):
        now = here[letters[:, i]]
        less = less & behind[letters[long, i]] | equal[long]
        if i < m:
            before = equal[short]
            more = (more | before) & ahead[letters[short, i]]
            replaced = replaced & now[short] | before & ~now[short]
        equal = equal & now
        if i + 1 == half:
            same_half = equal.copy()
        if i + 1 == m:
            result[short] = replaced & has_m | (more | equal[short]) & has_more
        behind, here, ahead = here, ahead, index.at(i + 2)
    result[long] = less & has_m
    return result & ~same_half if second_half else result


def _first_bits(sets: np.ndarray) -> np.ndarray:
    """Place of the lowest bit of each row that has one."""
    word = (sets != 0).argmax(axis=1)
    value = sets[np.arange(len(sets)), word]
    return word * 64 + np.bitwise_count((value & (~value + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def _compared(m: int, second_half: bool, words: list[str], counts: np.ndarray, unit: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Words of several units against those of the same unit: near words and the most frequent of them."""
    order = np.array(sorted(range(len(words)), key=lambda i: (-counts[i], words[i])))
    words, counts, unit, part = [words[i] for i in order], counts[order], unit[order], part[order]
    sizes = np.array([len(w) for w in words])
    joined = b"".join(w.encode("latin-1").ljust(m + 1, b"\0") for w in words)
    letters = np.frombuffer(joined, dtype=np.uint8).reshape(len(words), m + 1)
    meets = _packed((unit[:, None] == unit[None, :]) & ((part[:, None] < 0) | (part[:, None] != part[None, :])))
    sets = near_sets(letters, sizes, m, meets, second_half)
    n_near = np.bitwise_count(sets).sum(axis=1, dtype=np.int64)
    some = np.flatnonzero(n_near)
    best = _first_bits(sets[some]) if len(some) else some
    return pa.RecordBatch.from_arrays([
        pa.array([words[i] for i in some], pa.string()), pa.array(n_near[some]),
        pa.array([words[i] for i in best], pa.string()), pa.array(counts[best].astype(np.int64))],
        ["word", "n_near", "form", "form_n"])


def _near_of_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units come sorted by m and half; neighbouring ones of the same kind share a block.

    In a unit of two parts of a key words of one part meet those of the other only.
    """
    kind, unit, held, number = None, None, [], 0

    def flushed() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            words, counts, units, parts = zip(*held, strict=True)
            yield _compared(kind[0], kind[1] == 1, list(words), np.array(counts), np.array(units), np.array(parts))
        held.clear()

    for columns in rows(batches, "m", "half", "letters", "low", "high", "part", "word", "n"):
        for m, half, letters, low, high, part, word, n in zip(*columns, strict=True):
            if (m, half, letters, low, high) != unit:
                if (m, half) != kind or len(held) >= BLOCK_WORDS:
                    yield from flushed()
                kind, unit, number = (m, half), (m, half, letters, low, high), number + 1
            held.append((word, n, number, part if low != high else -1))
    if held:
        yield from flushed()


def near_words(words: DataFrame, part_letters: int = PART_LETTERS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n_near, form, form_n: per word and key its number of near words and the most frequent of them.

    ``words`` has distinct words (word) of Latin letters, ``least_length`` at least, and their counts (n). A near word
    is reported under one key only. No pair is listed; a key whose words have more than
    ``part_letters`` letters is dealt into parts, and each pair of parts is a unit of its own.
    """
    size = F.char_length("word")

    def key(m: F.Column) -> list:
        return [F.struct(m.alias("m"), F.lit(0).alias("half"), F.expr("word").substr(F.lit(1), F.ceil(m / 2).cast("int")).alias("letters")),
                F.struct(m.alias("m"), F.lit(1).alias("half"), F.right("word", F.floor(m / 2).cast("int")).alias("letters"))]

    keyed = words.select("word", "n", F.explode(F.array(*key(size), *key(size - 1))).alias("k")).select(
        "word", "n", "k.*").where(F.col("m") >= least_length)
    met = keyed.groupBy("m", "half", "letters").agg(
        F.ceil(F.sum(size) / part_letters).cast("int").alias("parts"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    units = (keyed.join(met, ["m", "half", "letters"]).withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("m", "half", "letters", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                     "part", "word", "n"))
    dealt = ["m", "half", "letters", "low", "high"]
    return units.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(
        _near_of_units, "word string, n_near long, form string, form_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the links word -> form end, by doubling the steps. Links must not form a ring."""
    links = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR,
             part_letters: int = PART_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text).

    A word's form is its near word (one letter inserted, deleted or replaced) with the
    most occurrences, of equal ones the smallest, if it has at least ``factor`` times the
    word's; root is where the forms end. Both hold over the whole vocabulary.

    NULL texts have no words, repeated rows count again, a row without doc_id has the id ''
    in the checksum, an empty table has no words, and other columns are not read. Of the
    corpus only distinct words are compared; a form has more occurrences than its word, so
    links cannot form a ring.
    """
    words = stored(vocabulary(docs, least_length, least_count), "words")
    found = near_words(words, part_letters, least_length)
    best = F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(
        "struct<less:bigint,form:string>").alias("best"))
    named = none.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("best"))).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.less") >= F.lit(factor) * F.col("n")
    named = stored(named.select("word", F.when(fits, F.col("best.form")).alias("form"), "n", "n_near",
                                F.when(fits, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
