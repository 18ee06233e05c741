"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one last token of its encoding. A
token that is a suffix of the prefix is that token if the encoding of what is
left of it ends in a token with which it can stand side by side. The tokens
that are suffixes of a prefix come from an automaton over the vocabulary; the
encoding of the whole word follows the stored tokens back from its end.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.llm.common import BLANK_CLASS, rows

#: Words kept with their encoding per Python worker.
MEMO_WORDS = 500_000
_BLANKS = re.compile(BLANK_CLASS + "+")
#: Texts that lower-case letter by letter and are in composed form already, and how these fall into words.
_PLAIN = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r\x20a-z0-9ß-öø-ÿ]+")
#: Moves a character to the private area: the symbol of a character that ends its word.
_END = 0xF0000


class PrefixEncoder:
    """Ids of one pre-tokenized word; ``encode`` equals merging by rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_suffix: str = ""):
        self._suffix = end_suffix
        symbols = {self._symbols(token): i for token, i in vocab.items()}
        self.rank = {i: -1 for i in symbols.values()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = symbols[self._symbols(a)], symbols[self._symbols(b)]
            whole = symbols[self._symbols(a) + self._symbols(b)]
            self.pairs.setdefault((left, right), rank)
            if self.rank[whole] < 0:
                self.rank[whole], self.halves[whole] = rank, (left, right)
        # a token whose halves or whose border another merge takes first never comes out of merging
        reached = {i for i in symbols.values() if i not in self.halves}
        for i in sorted(self.halves, key=self.rank.__getitem__):
            if reached.issuperset(self.halves[i]) and self._side_by_side(*self.halves[i], self.rank[i]):
                reached.add(i)
        self.automaton = ahocorasick.Automaton()
        for text, i in symbols.items():
            if text and i in reached and (len(text) == 1 or i in self.halves):
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self._known: dict[tuple[int, int], bool] = {}

    def _symbols(self, token: str) -> str:
        """A token as a string of base symbols, one character each."""
        if self._suffix and token.endswith(self._suffix) and len(token) > len(self._suffix):
            body = token[: -len(self._suffix)]
            return body[:-1] + chr(_END + ord(body[-1]))
        return token

    def _side_by_side(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether merging leaves the border between two tokens alone.

        Merges of both sides are undone, newest first. A pair that stands at the
        border until rank ``before`` must have no merge that comes earlier; of equal
        ranks the leftmost comes first.
        """
        rank, halves, pairs = self.rank, self.halves, self.pairs
        while True:
            merged = pairs.get((left, right))
            if merged is not None and merged < before:
                return False
            if rank[left] > rank[right]:
                before, left = rank[left], halves[left][1]
            elif rank[right] >= 0:
                before, right = rank[right] + 1, halves[right][0]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Ids of a word; linear in its length times the tokens ending at a place."""
        text = word
        if self._suffix and word:
            text = word[:-1] + chr(_END + ord(word[-1]))
        last, length = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        known = self._known
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                fits = known.get((before, token))
                if fits is None:
                    if len(known) > 2_000_000:
                        known.clear()
                    fits = known[before, token] = self._side_by_side(before, token)
                if not fits:
                    continue
            last[end], length[end] = token, size
        ids, at = [], len(text)
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no encoding of {word!r}")
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]


class WordBpe:
    """Encoding and decoding of whole texts with a tokenizer file whose words end at blanks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.encoder = PrefixEncoder(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.token = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.byte_letters = {b: letter for letter, b in _byte_letters()}
        self.memo: dict[str, tuple[bytes, str]] = {}

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a blank, as the file names no decoder."""
        return " ".join([self.token[i] for i in ids])

    def word(self, letters: str) -> tuple[bytes, str]:
        """A pre-tokenized word in byte letters: its ids as little-endian 32-bit integers, decoded."""
        ids = self.encoder.encode(letters)
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def plain_words(self, span: str) -> list[tuple[bytes, str]]:
        """Words of a text in ASCII and composed Latin-1 letters, for which no Unicode table is needed."""
        memo = self.memo
        words = _PLAIN_WORDS.findall(span.lower())
        missing = {w for w in words if w not in memo}
        if missing:
            if len(memo) + len(missing) > MEMO_WORDS:
                memo.clear()
                missing = set(words)
            for w in missing:
                memo[w] = self.word(w if w.isascii() else w.encode().decode("latin-1").translate(self.byte_letters))
        return [memo[w] for w in words]

    def any_words(self, span: str) -> list[tuple[bytes, str]]:
        """Words of any text, cut and normalized by the tokenizer file's own rules."""
        found = []
        for piece in _BLANKS.split(span):
            if _PLAIN.fullmatch(piece):
                found += self.plain_words(piece)
            else:
                found += [self.word(letters) for letters, _ in self.split(self.normalize(piece))]
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """All ids of a text as little-endian 32-bit integers, and the decoded text."""
        found = []
        for k, span in enumerate(self.specials.split(text) if self.specials and "<|" in text else (text,)):
            if k % 2:
                found.append((self.special[span].to_bytes(4, "little"), span))
            else:
                found += self.plain_words(span) if _PLAIN.fullmatch(span) else self.any_words(span)
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found])


def _byte_letters() -> Iterator[tuple[str, int]]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    further = 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            yield chr(byte), byte
        else:
            yield chr(further), byte
            further += 1


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, *, with_values: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``with_values`` adds ``ids`` (little-endian 32-bit integers) and ``decoded``.
    A NULL text counts as empty: no ids, decoded to the empty text. Repeated rows
    each give their row, in no order; other columns are not read. A text of any
    length is encoded whole, and words that memory knows are not encoded again.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_values:
        schema, names = schema + ", ids binary, decoded string", [*names, "ids", "decoded"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids, decoded = bpe.encode(text or "")
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                       hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded)
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encoded, schema)
