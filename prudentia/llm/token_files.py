"""Token ids in files: one zstandard frame a document, a shared dictionary, an index of offsets.

A file ``part-NNNNN.ids`` holds, in ascending doc_id order,

* the head: ``MAGIC`` and the SHA-256 of the dictionary (``dictionary.zdict`` in the folder);
* a frame for each document: its ids as little-endian unsigned 32-bit integers;
* the index, itself a frame: per document doc_id (int64, NULL as the smallest), start
  (uint64, ids before it in the file), n_tokens (uint32), offset (uint64) and length (uint32);
* the tail: offset and length of the index, number of documents (3 x uint64) and ``MAGIC``.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudentia.llm.common import new_path, rows, stored

MAGIC = b"TOKIDS01"
END_ID = 0
#: Documents of lowest hash whose ids train the dictionary, and its size: a bound that affects size only, never content.
DICTIONARY_DOCS = 2000
DICTIONARY_BYTES = 1 << 16
#: Bytes of frames that a reader asks for at a time.
READ_BYTES = 4 << 20
LEVEL = 3
MEMO_PIECES = 1_000_000
INDEX = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("n_tokens", "<u4"), ("offset", "<u8"), ("length", "<u4")])
_TAIL = "<QQQ8s"
_TAIL_BYTES = struct.calcsize(_TAIL)
_NO_ID = -(2**63)
#: Unicode white space, at which the tokenizer's words begin and end.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Texts in ASCII and Latin-1 letters fall into the tokenizer's own words; of these the ones of letters only.
_PLAIN = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PLAIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r\x20A-Za-z0-9À-ÖØ-öø-ÿ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_LETTERS = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")


class ByteBpe:
    """The tokenizers library over pieces between white space, each different piece encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of a blank and ASCII letters, which the byte-level alphabet leaves as they are but for the blank."""
        merged, pack = self.library.model.tokenize, struct.pack
        found = ([t.id for t in merged("\u0120" + w[1:])] for w in words)
        return [pack(f"<{len(ids)}I", *ids) for ids in found]

    def _words(self, words: list[str], together: int = 2000) -> list[bytes]:
        """Ids of words of a blank and letters: written one after the other they stay the words that they are."""
        out = []
        for begin in range(0, len(words), together):
            part = words[begin:begin + together]
            found = self.library.encode("".join(part), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            edges = np.searchsorted(np.array(found.word_ids), np.arange(len(part) + 1))
            out += [ids[i:j].tobytes() for i, j in itertools.pairwise(edges.tolist())]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts; the pieces that memory lacks are encoded in one go."""
        special = [any(s in text for s in self.special) for text in texts]
        memo = self.memo
        split = [[] if s else (_PLAIN_PIECE if _PLAIN.fullmatch(t) else _PIECE).findall(t) for s, t in zip(special, texts, strict=True)]
        distinct = set().union(*split)
        missing = distinct.difference(memo)
        if missing:
            if len(memo) + len(missing) > MEMO_PIECES:
                memo.clear()
                missing = distinct
            words = list(filter(_LETTERS.fullmatch, missing))
            others = list(missing.difference(words))
            plain = list(filter(str.isascii, words))
            words = list(set(words).difference(plain))
            memo.update(zip(plain, self._plain_words(plain), strict=True))
            memo.update(zip(words, self._words(words), strict=True))
            memo.update(zip(others, self._encoded(others), strict=True))
        known = memo.__getitem__
        return [self._encoded([t])[0] if s else b"".join(map(known, pieces))
                for s, t, pieces in zip(special, texts, split, strict=True)]


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _some(found: Iterator[tuple], most: int = 1500) -> Iterator[tuple]:
    """The rows in parts of at most ``most``."""
    for columns in found:
        for begin in range(0, len(columns[0]), most):
            yield tuple(c[begin:begin + most] for c in columns)


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary for the ids of ``DICTIONARY_DOCS`` documents; empty where there are too few."""
    own = _own(docs)
    chosen = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            ids = byte_bpe(tokenizer).encode_all([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    seen = own.join(F.broadcast(chosen), "doc_id").mapInArrow(encoded, "doc_id long, ids binary").toArrow()
    samples = sorted(x for x in seen["ids"].to_pylist() if x)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write ``docs`` to ``folder``; returns file, number, n_docs, n_tokens, base (ids in the files before it).

    Rows are dealt into ranges of doc_id and sorted within each; files are numbered in
    the order of the ranges. Each document's ids end in ``END_ID``; a NULL text is
    empty, rows without doc_id come first, rows of one doc_id in the order of their
    texts. A file is written under a name of the attempt and then takes its final name,
    so that a repeated task replaces it by an equal one. A task holds some 1,500
    documents and the index.
    """
    dictionary = train_dictionary(docs, tokenizer)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(dictionary)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        bpe, task = byte_bpe(tokenizer), TaskContext.get()
        name = f"part-{task.partitionId():05d}.ids"  # the number orders files, not the name
        draft = f"{root}/_{name}.{task.taskAttemptId()}"
        shared = _dictionary(dictionary)
        packer = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": shared} if shared else {}))
        index, start, out, at = [], 0, None, 0
        for doc_ids, texts in _some(rows(batches, "doc_id", "text")):
            if out is None:
                out = store.open_output_stream(draft)
                out.write(MAGIC + hashlib.sha256(dictionary).digest())
                at = len(MAGIC) + 32
            entries = np.zeros(len(doc_ids), dtype=INDEX)
            encoded = bpe.encode_all([t or "" for t in texts])
            for k, (doc_id, ids) in enumerate(zip(doc_ids, encoded, strict=True)):
                ids += END_ID.to_bytes(4, "little")
                frame = packer.compress(ids)
                out.write(frame)
                entries[k] = (_NO_ID if doc_id is None else doc_id, start, len(ids) // 4, at, len(frame))
                start, at = start + len(ids) // 4, at + len(frame)
            index.append(entries)
        if out is None:
            return
        entries = np.concatenate(index)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(entries.tobytes())
        out.write(packed + struct.pack(_TAIL, at, len(packed), len(entries), MAGIC))
        out.close()
        store.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([
            pa.array([name]), pa.array([task.partitionId()], pa.int64()), pa.array([len(entries)], pa.int64()), pa.array([start], pa.int64())],
            ["file", "number", "n_docs", "n_tokens"])

    ranged = _own(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(ranged.mapInArrow(filed, "file string, number long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def index_of(source: pa.NativeFile) -> np.ndarray:
    """The index of an open file; only its tail and the index are read."""
    size = source.size()
    at, length, n, magic = struct.unpack(_TAIL, source.read_at(_TAIL_BYTES, size - _TAIL_BYTES))
    if magic != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a file of token ids")
    packed = zstandard.ZstdDecompressor().decompress(source.read_at(length, at), max_output_size=n * INDEX.itemsize)
    return np.frombuffer(packed, dtype=INDEX)


def _reader(dictionary: bytes, digest: bytes) -> zstandard.ZstdDecompressor:
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("the file was written with another dictionary")
    shared = _dictionary(dictionary)
    return zstandard.ZstdDecompressor(**({"dict_data": shared} if shared else {}))


def read_document(folder: str, file: str, doc_id: int) -> list[int] | None:
    """Ids of one document: the tail, the index and one frame are read."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/dictionary.zdict") as source:
        dictionary = source.read()
    with store.open_input_file(f"{root}/{file}") as source:
        index = index_of(source)
        place = int(np.searchsorted(index["doc_id"], doc_id))
        if place == len(index) or index["doc_id"][place] != doc_id:
            return None
        digest = source.read_at(32, len(MAGIC))
        frame = source.read_at(int(index["length"][place]), int(index["offset"][place]))
    return list(struct.unpack(f"<{index['n_tokens'][place]}I", _reader(dictionary, digest).decompress(frame)))


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files that ``write`` returned.

    A task opens a file and reads its index, then its frames a few MB at a time.
    """
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/dictionary.zdict") as source:
        dictionary = source.read()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for files, bases in rows(batches, "file", "base"):
            for file, base in zip(files, bases, strict=True):
                with store.open_input_file(f"{root}/{file}") as source:
                    index = index_of(source)
                    reader = _reader(dictionary, source.read_at(32, len(MAGIC)))
                    for part in _stretches(index):
                        first = int(part["offset"][0])
                        data = memoryview(source.read_at(int(part["offset"][-1] + part["length"][-1]) - first, first))
                        crc = [zlib.crc32(reader.decompress(data[o - first:o - first + n]))
                               for o, n in zip(part["offset"].tolist(), part["length"].tolist(), strict=True)]
                        ids = pa.array([None if i == _NO_ID else i for i in part["doc_id"].tolist()], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array((part["start"] + np.uint64(base)).astype(np.int64)), pa.array(part["n_tokens"].astype(np.int64)),
                             pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "base").repartition("file").mapInArrow(
        unpacked, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _stretches(index: np.ndarray) -> Iterator[np.ndarray]:
    """Entries whose frames are read at once: some MB of a file, and one document at least."""
    ends = (index["offset"] + index["length"]).astype(np.int64)
    begin = 0
    while begin < len(index):
        stop = max(begin + 1, int(np.searchsorted(ends, int(index["offset"][begin]) + READ_BYTES, side="right")))
        yield index[begin:min(stop, begin + 10_000)]
        begin = min(stop, begin + 10_000)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "token-files")
    files = write(docs, folder, tokenizer)
    if files.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(files, folder)
