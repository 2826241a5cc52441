"""Byte-pair encoding and decoding of whole texts with a public vocabulary.

Merges come from a priority queue of ranks over a doubly linked list of symbols; entries whose symbols have
changed meanwhile are skipped. A text is cut at white space, where no merge can cross, and each distinct piece is
encoded once in a task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import table

#: Pieces and words remembered in a task, and the letters of the longest that is.
REMEMBERED, LONGEST_REMEMBERED = 300_000, 64
#: Fixed by the vocabulary file: its pattern and the end of a word.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "</w>"
#: White space as Unicode has it; str.split() would also cut at these four controls.
_CONTROLS = regex.compile("[\x1c-\x1f]")
_PIECES = regex.compile("[^\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.letters = byte_letters()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """The text between white space, and special tokens where they stand."""
        if self.cut is not None and self.cut.search(text):
            return [p for part in self.cut.split(text) for p in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        return _PIECES.findall(text) if _CONTROLS.search(text) else text.split()

    def word(self, word: str) -> list[int]:
        """The symbols of one word, the last with the end of word, merged by rank and then place."""
        letters = [self.letters[b] for b in word.encode("utf-8", "replace")]
        sym = [self.ids[c] for c in letters[:-1]] + [self.ids[letters[-1] + END]]
        n, merges = len(sym), self.merges
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(*merges[pair], i) for i, pair in enumerate(zip(sym, sym[1:], strict=False)) if pair in merges]
        queue = [(rank, i, new) for rank, new, i in queue]
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i]
            if sym[i] < 0 or j < 0 or merges.get((sym[i], sym[j]), (-1,))[0] != rank:
                continue  # stale
            sym[i], sym[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := merges.get((sym[a], sym[b]))):
                    heapq.heappush(queue, (m[0], a, m[1]))
        return [s for s in sym if s >= 0]

    @staticmethod
    def words(piece: str) -> list[str]:
        """The normalised words of a piece. Letters are lower-cased one by one: no final sigma."""
        if piece.isascii() and piece.isalpha():
            return [piece.lower()]
        return WORDS.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())

    def encode_piece(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        return [i for w in self.words(piece) for i in self.word(w)]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.encode_piece(p)]

    def decode(self, ids) -> str:
        """The vocabulary's strings one after the other; this vocabulary's decoder puts a space between them."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Memory(dict):
    """Piece to (ids as little-endian bytes, decoded bytes)."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece):
        words = self.vocabulary.words(piece) if piece not in self.vocabulary.special else [piece]
        if words == [piece]:
            ids = self.vocabulary.encode_piece(piece)
            out = array("I", ids).tobytes(), self.vocabulary.decode(ids).encode()
        else:  # a word is remembered on its own, for the other pieces that hold it
            got = [self[w] for w in words]
            out = b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def _memory(path: str) -> _Memory:
    return _Memory(load(path))


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary, decoded string) for each row of docs, ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Whole texts; repeated rows give repeated results.
    """
    return docs.select("doc_id", _both("ids binary, decoded string", path, lambda ids, text: (ids, text.decode()))("text").alias("r")).select("doc_id", "r.ids", "r.decoded")


def _both(schema: str, path: str | None, of):
    where = path or default_path()
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        memory = _memory(where)
        pieces, rows = memory.vocabulary.pieces, []
        for t in texts:
            got = [g for g in map(memory.__getitem__, pieces(t or "")) if g[0]]
            rows.append(of(b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])))
        return pd.DataFrame(rows, columns=names)

    return run


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are made where the ids are, so that neither ids nor texts travel."""

    def digest(ids: bytes, text: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    docs = table(spark, sf_dir, "documents")
    both = _both("n_tokens long, ids_sha256 string, decoded_sha256 string", None, digest)
    return docs.select("doc_id", both("text").alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
