"""Quality rules on repetition, and divergence of letters and words from each language's references.

Column expressions only: nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.llm.common import own_columns, stored, text_of, words_of

#: The most frequent words of the languages, in the order of frequency.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with"),
    "de": ("der", "die", "und", "das", "den", "von", "ist", "des", "mit", "sich", "ein", "für"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "est", "que"),
    "es": ("de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con"),
}
#: Fewest words for any judgement, and for one by common words.
LEAST_WORDS = 50
LEAST_WORDS_COMMON = 100
#: Largest Jensen-Shannon distances (base 2, 0 to 1) from the references of the language.
MOST_CLASSES = 0.25
MOST_COMMON = 0.27
#: Fewest documents of a language that make a reference.
LEAST_DOCS = 20

#: Capitals, digits, line feeds, marks, symbols, beyond ASCII. Small letters, blanks and other controls are the rest.
_CLASSES = ("A-Z", "0-9", r"\n", ".,;:!?'\"()\\[\\]-", "#*$%&|<>", r"\x{80}-\x{10FFFF}")
_SYMBOLS = 4


def _count(text: Column, chars: str) -> Column:
    """Characters of a class: what is left without the runs of all others."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def class_counts(rest: Column, text: Column) -> Column:
    """Characters by class and in all; ``rest`` is the text without small letters and spaces."""
    return F.array(*[_count(rest, c) for c in _CLASSES], F.char_length(text).cast("long"))


def common_counts(words: Column, lang: Column) -> Column:
    """Occurrences of each common word of the language, and of all words; NULL for another language.

    Words count as written: a text in capitals has no common ones. The few words that
    any list holds are picked first.
    """
    listed = F.create_map(*[x for name, words in COMMON_WORDS.items()
                            for x in (F.lit(name), F.array(*map(F.lit, words)))])
    hits = F.filter(words, lambda w: w.isin(sorted({w for listed in COMMON_WORDS.values() for w in listed})))
    of_word = F.transform(F.element_at(listed, lang), lambda c: F.size(F.filter(F.col("_hits"), lambda w: w == c)).cast("long"))
    return hits, F.concat(of_word, F.array(F.size(words).cast("long")))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is read.

    A generator of one row keeps the optimizer from copying the expression into each place that reads it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_features(docs: DataFrame, text: str = "text", lang: str = "lang", repetition: bool = True) -> DataFrame:
    """``docs`` with ``_q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common."""
    body = _once(docs.withColumn("_text", text_of(text)), "_words", words_of(F.col("_text")))
    hits, common = common_counts(F.col("_words"), F.col(lang).cast("string"))
    body = _once(_once(body, "_hits", hits), "_rest", F.regexp_replace("_text", "[a-z ]+", ""))
    counts = [F.size("_words").cast("long").alias("n_words"), class_counts(F.col("_rest"), F.col("_text")).alias("classes"),
              common.alias("common")]
    if repetition:
        lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        body = body.withColumn("_lines", lines).withColumn("_hashes", F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size("_words") - 2), lambda i: F.xxhash64(
                F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)))))
        twice = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
        body = body.withColumn("_sorted", F.when(twice, F.sort_array(F.arrays_zip(
            F.col("_hashes").alias("h"), F.sequence(F.lit(1), F.size("_hashes")).alias("i")))))
        n = F.size("_sorted")
        # a window is repeated if its neighbour before or behind has the same hash
        shifted = F.zip_with(F.slice("_sorted", 1, n - 1), F.slice("_sorted", 2, n - 1),
                             lambda a, b: F.when(a["h"] == b["h"], F.struct(a["i"].alias("a"), b["i"].alias("b"))))
        body = body.withColumn("_pairs", F.filter(shifted, lambda x: x.isNotNull()))
        body = body.withColumn("_places", F.array_union(F.col("_pairs.a"), F.col("_pairs.b")))
        covered = F.array_union(F.array_union("_places", F.transform("_places", lambda i: i + 1)),
                                F.transform("_places", lambda i: i + 2))
        counts += [
            F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.when(twice, F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words")]
    return _once(body, "_q", F.struct(*counts)).select(*[F.col(f"`{c}`") for c in docs.columns], "_q")


def references(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """_lang, ref_classes, ref_common: sums over all documents of a language with enough words."""
    long = measured.where((F.col("_q.n_words") >= LEAST_WORDS) & F.col(lang).isNotNull())

    def sums(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.col(f"_q.{name}")[i]) for i in range(n)])

    n_common = max(map(len, COMMON_WORDS.values())) + 1
    summed = long.groupBy(F.col(lang).cast("string").alias("_lang")).agg(
        sums("classes", len(_CLASSES) + 1).alias("ref_classes"), sums("common", n_common).alias("ref_common"),
        F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).drop("n")
    return stored(summed, "references")


def _shares(counts: Column) -> Column:
    """Counts followed by their whole, as an array of shares; the last is what the counts leave of the whole."""
    parts = F.slice(counts, 1, F.size(counts) - 1)
    whole = F.element_at(counts, -1)
    rest = whole - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(parts, F.array(rest)), lambda x: x / F.greatest(whole, F.lit(1)).cast("double"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance, base 2, of two histograms given as arrays of shares."""
    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judged(measured: DataFrame, known: DataFrame, lang: str = "lang") -> DataFrame:
    """``measured`` with ``_verdict``: base_failed, class_distance, common_distance, kept.

    A document of fewer than ``LEAST_WORDS`` words fails the base rules. Without a
    reference (NULL or rare language) a distance is NULL and does not reject; common
    words count for languages that have a list and for texts of ``LEAST_WORDS_COMMON``
    words. ``known`` has one row per language.
    """
    both = measured.join(known, F.col(lang).cast("string") == F.col("_lang"), "left")
    classes = jensen_shannon(_shares(F.col("_q.classes")), _shares(F.col("ref_classes")))
    common = jensen_shannon(_shares(F.col("_q.common")), _shares(F.col("ref_common")))
    failed = (F.col("_q.n_words") < LEAST_WORDS) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    both = _once(both, "_d", F.struct(
        failed.alias("base_failed"), F.when(F.col("ref_classes").isNotNull(), classes).alias("class_distance"),
        F.when(F.col("ref_common").isNotNull() & F.col("_q.common").isNotNull()
               & (F.col("_q.n_words") >= LEAST_WORDS_COMMON), common).alias("common_distance")))
    kept = (~F.col("_d.base_failed") & (F.coalesce("_d.class_distance", F.lit(0.0)) <= MOST_CLASSES)
            & (F.coalesce("_d.common_distance", F.lit(0.0)) <= MOST_COMMON))
    return both.withColumn("_verdict", F.struct("_d.*", kept.alias("kept")))


def quality(docs: DataFrame) -> DataFrame:
    """The counts, distances and verdict of every row of ``docs`` (doc_id, text, lang).

    Texts are read once: the counts are stored, the references of the languages are
    sums of them. NULL and empty texts have no words and fail. Rows are judged one by
    one, so repeated rows are judged alike; other columns are not read.
    """
    own = docs.select("doc_id", F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    measured = stored(with_features(own).drop("text"), "counts")
    return judged(measured, references(measured)).select(
        "doc_id", "_q.n_words", "_q.word_chars", F.col("_q.classes")[_SYMBOLS].alias("n_symbols"), "_q.n_dup_lines",
        "_q.n_repeat_words", "_verdict.base_failed", "_verdict.kept", "_verdict.class_distance", "_verdict.common_distance")


def good_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, their columns as they came, whatever their names.

    The references are summed in a first pass over the texts; the second measures and
    judges each row where it stands, so that no text is shuffled. An empty table gives none.
    """
    known = references(with_features(docs.select("text", "lang"), repetition=False))
    packed = docs.select(own_columns(docs), "text", "lang")
    return judged(with_features(packed), known).where("_verdict.kept").select("own.*")
