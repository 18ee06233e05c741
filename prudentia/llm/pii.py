"""Personal data by pattern, and terms that reveal it by how often they come with it."""

from __future__ import annotations

import bisect
import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.llm.common import rows, stored

KINDS = ("email", "ip", "card", "phone")
#: A term belongs to the context of an entity within so many terms before and after it.
WINDOW = 5
#: Log-likelihood ratio from which a term and an entity stand together more often than by chance: odds of one in a thousand.
SIGNIFICANCE = 6.9
#: Shares of an entity's information that a term may give: above the first it is generalised, above the second removed.
GENERALISE = 0.9
REMOVE = 0.99

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Bits of the table that tells most terms apart from revealing ones before the exact join; its size bears on speed only.
FILTER_BITS = 22
_TERM = re.compile(r"[^\W\d_]{3,}")
#: Combining marks, read as a letter where terms are cut.
_MARKS = dict.fromkeys((c for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"), "a")
_MARK_SET = frozenset(map(chr, _MARKS))
_CONTEXT = "array<struct<entity: string, term: string>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses: the run of local characters that ends at an @, and at least two labels behind it.

    An address can only end its local part at an @, so each @ is looked at once and no
    run is scanned twice.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start; leftmost, non-overlapping within a kind."""
    found = [(0, *span) for span in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((3, *m.span()))
    return found


def entity(kind: int, value: str) -> str:
    """A found value in one spelling."""
    return f"{KINDS[kind]}:" + (value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9+]", "", value))


def entities(kind: int, value: str) -> list[str]:
    """What a found value stands for: itself, those of its domain or first digits, and its kind."""
    name = entity(kind, value)
    bare = name.partition(":")[2]
    family = (bare.partition("@")[2], ".".join(bare.split(".")[:2]), bare[:6], bare[:4])[kind]
    return [name, f"{KINDS[kind]} of {family}", KINDS[kind]]


def terms(text: str) -> list[tuple[int, int]]:
    """Spans of the terms: three letters or more, with their combining marks."""
    bare = text if text.isascii() or _MARK_SET.isdisjoint(text) else text.translate(_MARKS)
    return [m.span() for m in _TERM.finditer(bare)]


def outside(text: str, spans: list[tuple[int, int, int]], found: list[tuple[int, int]]) -> list[bool]:
    """Whether each found term lies outside all spans."""
    covered = bytearray(len(text))
    for _, start, end in spans:
        covered[start:end] = b"\1" * (end - start)
    return [1 not in covered[a:b] for a, b in found]


def context(text: str, spans: list[tuple[int, int, int]], window: int = WINDOW) -> list[dict]:
    """The terms around each span on its line, outside all spans."""
    listed, found = terms(text), []
    free, starts, ends = outside(text, spans, listed), [a for a, _ in listed], [b for _, b in listed]
    for kind, start, end in spans:
        names = entities(kind, text[start:end])
        line = text.rfind("\n", 0, start) + 1
        stop = text.find("\n", end)
        before, after = bisect.bisect_right(ends, start), bisect.bisect_left(starts, end)
        for i in (*range(max(0, before - window), before), *range(after, min(len(listed), after + window))):
            a, b = listed[i]
            if free[i] and a >= line and (stop < 0 or b <= stop):
                found += [{"entity": name, "term": text[a:b].lower()} for name in names]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame) -> DataFrame:
    """Base spans of every row: doc_id, key (of the text), the four counts, base_sha256, base_spans, context."""
    names = ["doc_id", "key", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans", "context"]
    schema = "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string, context " + _CONTEXT
    item = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [item]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(doc_ids, texts, strict=True):
                text = text or ""
                spans = base_spans(text)
                listed = joined([(KINDS[k], s, e) for k, s, e in spans])
                row = [doc_id, xxhash.xxh3_64_intdigest(text) - 2**63,
                       *(sum(k == kind for k, _, _ in spans) for kind in range(4)),
                       hashlib.sha256(listed.encode()).hexdigest(), listed, context(text, spans) if spans else []]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(found, schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n_term: the number of documents that hold a term; a task sends partial sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows(batches, "text"):
            seen = Counter()
            for text in texts:
                seen.update({text[a:b].lower() for a, b in terms(text or "")})
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n_term"])

    return docs.select(F.col("text").cast("string")).mapInArrow(counted, "term string, n_term long").groupBy("term").agg(
        F.sum("n_term").alias("n_term"))


def revealing(found: DataFrame, docs: DataFrame, significance: float = SIGNIFICANCE, threshold: float = GENERALISE) -> DataFrame:
    """term, disclosure: the terms that give more than ``threshold`` of an entity's information.

    An entity is a single value, the values of one domain or number prefix, or a kind.
    With N documents, n(t) holding a term, n(e) an entity and n(t,e) both side by side,
    the pointwise mutual information log2(N n(t,e) / (n(t) n(e))) is put in relation to
    the information of the entity, log2(N / n(e)): 1 means that who reads the term knows
    the entity. Against chance counts the log-likelihood ratio n(t,e) ln(n(t,e) / x) - n(t,e) + x
    with x = n(t) n(e) / N, so that a single meeting counts if both are rare. All documents count for n(t). Pairs exist only within
    the window, so their number follows that of the entities found; counts are partial
    sums, and a frequent entity or term sends one row a task.
    """
    near = found.select(F.explode(F.array_distinct("context")).alias("x")).select("x.*")
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    named = F.array_distinct(F.transform("context", lambda c: c["entity"]))
    # Both sides are stored: a kind stands with very many terms, and Spark splits only joins of plain shuffles.
    holding = stored(found.select(F.explode(named).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")), "entities")
    pairs = stored(pairs, "pairs")
    n = F.lit(found.count())
    known = pairs.join(holding, "entity").join(term_counts(docs), "term")
    both, of_entity = F.col("n_both"), F.col("n_entity")
    chance = F.col("n_term") * of_entity / n
    share = F.log2(both / chance) / F.log2(n / of_entity)
    sure = both * F.log(both / chance) - both + chance
    return known.where((n > of_entity) & (sure >= significance)).select("term", share.alias("disclosure")).where(
        F.col("disclosure") >= threshold).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, key, start, end, disclosure of every place outside base spans where a term of ``wanted`` stands, in all texts.

    A table of bits lets through the revealing terms and a few others; the join by term is exact.
    """

    def bucket(term: str) -> int:
        return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) & ((1 << FILTER_BITS) - 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (listed,) in rows(batches, "term"):
            yield pa.RecordBatch.from_arrays([pa.array({bucket(t) for t in listed}, pa.int32())], ["bucket"])

    set_bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    set_bits[wanted.select("term").mapInArrow(dealt, "bucket int").distinct().toArrow()["bucket"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(set_bits))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = np.unpackbits(shared.value).view(bool), {}
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            out: list[tuple] = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                found = []
                for a, b in terms(text or ""):
                    term = text[a:b].lower()
                    if (hit := known.get(term)) is None:
                        if len(known) > 500_000:
                            known.clear()
                        hit = known[term] = bool(bits[bucket(term)])
                    if hit:
                        found.append((a, b, term))
                if found:
                    key = xxhash.xxh3_64_intdigest(text) - 2**63
                    free = outside(text, base_spans(text), [x[:2] for x in found])
                    out += [(doc_id, key, *x) for x, f in zip(found, free, strict=True) if f]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["doc_id", "key", "start", "end", "term"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        placed, "doc_id long, key long, start int, end int, term string").join(wanted, "term").drop("term").distinct()


def sanitise_spans(docs: DataFrame, significance: float = SIGNIFICANCE, threshold: float = GENERALISE) -> DataFrame:
    """Per row doc_id, key, counts, base_sha256, spans, n_term, and terms (start, end, disclosure).

    The base spans stay; the revealing terms are added wherever they stand, with or without an entity.
    NULL and empty texts have no spans. Rows are told apart by doc_id (NULL too) and
    text, so repeated rows have equal results; each row counts as a document.
    """
    found = stored(find(docs), "pii")
    wanted = stored(revealing(found, docs, significance, threshold), "revealing")
    marked = (occurrences(docs, wanted)
              .groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
              .withColumnsRenamed({"doc_id": "_id", "key": "_key"}))
    both = found.drop("context").join(
        marked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").drop("_id", "_key")
    added = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    listed = F.concat(F.when(F.col("base_spans") == "", F.array().cast("array<string>")).otherwise(F.array("base_spans")),
                      F.coalesce(added, F.array().cast("array<string>")))
    return both.withColumn("spans", F.array_join(listed, ",")).withColumn(
        "n_term", F.coalesce(F.size("terms"), F.lit(0)).cast("long")).drop("base_spans")


def sanitised(docs: DataFrame, significance: float = SIGNIFICANCE, threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, text: base spans replaced by their kind, revealing terms by ``<term>`` or nothing."""
    marked = sanitise_spans(docs, significance, threshold).select("doc_id", "key", "spans", "terms").distinct()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts, spans, terms in rows(batches, "doc_id", "text", "spans", "terms"):
            out = []
            for text, listed, weighed in zip(texts, spans, terms, strict=True):
                strong = {(t["start"], t["end"]) for t in weighed or () if t["disclosure"] >= remove}
                cuts, pieces, end = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in listed.split(",") if x)), [], 0
                for start, stop, kind in cuts:
                    if start >= end:
                        pieces += [text[end:start], "" if (start, -stop) in strong else f"<{kind}>"]
                        end = -stop
                    end = max(end, -stop)
                out.append("".join(pieces) + (text or "")[end:])
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            keys = [xxhash.xxh3_64_intdigest(t or "") - 2**63 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(texts, pa.string())],
                                             ["_id", "_key", "text"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(keyed, "_id long, _key long, text string")
    both = own.join(marked, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")))
    return both.select("doc_id", "text", "spans", "terms").mapInArrow(clean, "doc_id long, text string")
