"""Tokens of two tokenizers aligned by the bytes that they stand for, and how well the alignment holds corpus-wide.

The spans that the two libraries give (characters of tokenizers, bytes of sentencepiece's proto) are coarse cuts: a token
inside a character, a byte-fallback token and a trimmed span have none of their own. Those are refined with the
bytes that the tokens decode to. A text is cut before each space or line end that follows something else, and between a
Latin letter and a stop, where neither tokenizer has a token that goes across; each distinct part is aligned once in a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.bpe import byte_letters
from gleanline.llm.common import discard, small_batches, store, table

#: Parts remembered in a task, once more as many used before them, and the letters of the longest that is.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 32
#: The most frequent pairs of ids, this many at most (25 bytes each), are broadcast with their counts; the rest are joined by a shuffle.
BROADCAST_PAIRS = 100_000
#: Letters of the texts whose new parts are encoded at once.
BLOCK = 200_000
MARK = "▁"
#: Letters and stops between which is a cut, and a part of a text that stands before one for certain.
LETTERS, STOPS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
HOST = " a"
_SPACES = re.compile(r"(?<=\S)(?= )")
_PARTS = re.compile(rf"\s*+(?:[^\s{LETTERS}]++|[{LETTERS}]++(?![{STOPS}])|[^\S \n]\s*+)*+(?:[{LETTERS}]++)?+")
_ACROSS = re.compile(rf"[{LETTERS}][{STOPS}]|\n")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

Part = tuple[int, int, str, bytes]  # tokens of A, tokens of B, groups as text, links as pairs of ids (64-bit integers)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_ends(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte at which each token ends, of spans in bytes and of how many bytes the tokens decode to.

    A span that begins where the one before ended and is as long as the token's bytes is taken. Any other (part of a
    character, none of its own, trimmed) is refined by the bytes decoded up to it.
    """
    before = np.concatenate(([0], ends[:-1]))
    odd = (ends - begins != sizes) | (begins != before)
    return np.where(odd, np.cumsum(sizes), ends)


def byte_places(text: str) -> np.ndarray:
    """The byte at which each character begins, and the end."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))


class Aligner:
    """The two tokenizers; remembers the parts of texts that it has aligned."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: i for i, c in enumerate(byte_letters())}
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        entries = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for s, i in entries.items():
            self.a_bytes[i] = bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(s)) else s.replace(MARK, " ").encode() for s in names]
        self.ids = max(len(self.a_bytes), len(names))
        self.say = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]
        self.said_size = np.fromiter(map(len, self.say), np.int64, len(self.say))
        #: Whether no piece goes from something else to a space, so that parts can be encoded on their own.
        self.parted = not any(MARK in s.lstrip(MARK) for s in names)
        #: Whether none goes on from a letter to a stop or holds a line end either, and A cuts there as GPT-2's pattern does.
        gpt = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not spec.get("normalizer")
        whole = (s for i, s in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.fine = bool(self.parted and gpt) and not any(map(_ACROSS.search, whole))
        self.a_size = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_size = np.array([len(v) for v in self.b_bytes], np.int64)
        self.known: dict[str, Part | None] = {}  # and the parts used before these, which go when there are as many again
        self.older: dict[str, Part | None] = {}

    def _joint(self, parts: list[str]) -> list[Part] | None:
        """Parts that may follow one another, encoded as one text; None if either one's bytes are not the text's."""
        text = "".join(parts)
        raw = text.encode("utf-8", "replace")
        enc = self.a.encode(text, add_special_tokens=False)
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        a, b = enc.ids, [p.id for p in pieces]
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        spans = byte_places(text)[np.fromiter(chain.from_iterable(enc.offsets), np.int64, 2 * len(a))]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends = byte_ends(spans[::2], spans[1::2], self.a_size[a])
        begins = np.array([p.begin for p in pieces], np.int64) + 1  # the space that B adds is in no span
        begins[:1] = 0
        b_ends = byte_ends(begins, np.array([p.end for p in pieces], np.int64) + 1, self.b_size[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        at_a, at_b = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        links = (a[at_a] << 32 | b[at_b]).tobytes()
        # the groups as text: where each token stands among those of both, and the mark that follows it
        n_a, n_b = np.concatenate(([0], at_a + 1)), np.concatenate(([0], at_b + 1))
        said = np.empty(len(a) + len(b), np.int64)
        in_a, in_b = np.arange(len(a)), np.arange(len(b))
        in_a += n_b[np.searchsorted(cuts, a_ends)]
        in_b += n_a[np.searchsorted(cuts, b_ends) + 1]
        said[in_a], said[in_b] = a, b
        said[in_a[at_a]] += self.ids
        said[in_b[at_b]] += 2 * self.ids
        told = "".join(map(self.say.__getitem__, said.tolist()))
        until = np.concatenate(([0], np.cumsum(self.said_size[said])))
        closed = np.searchsorted(cuts, np.cumsum([len(p.encode("utf-8", "replace")) for p in parts]), side="right")
        n_a, n_b = n_a[closed], n_b[closed]
        out, g, s = [], 0, 0
        for p, q, h, e in zip(np.diff(n_a, prepend=0).tolist(), np.diff(n_b, prepend=0).tolist(), (8 * closed).tolist(), until[n_a + n_b].tolist(), strict=True):
            out.append((p, q, told[s : e - 1], links[g:h]))
            g, s = h, e
        return out

    @staticmethod
    def _led(parts: list[str]) -> list[str]:
        """With a host before the parts that begin with a stop, and in front if the first begins with no space."""
        out = []
        for p in parts:
            if p[0] in STOPS or (not out and p[0] != " "):
                out.append(HOST)
            out.append(p)
        return out

    def _learn(self, parts: list[str]) -> dict[str, Part | None]:
        """Each part aligned, as many as can be at once; None for one whose bytes do not come back."""
        if not parts:
            return {}
        last = [p for p in parts if p[-1].isspace()]  # nothing may follow these
        if last and len(parts) > 1:
            out = self._learn([p for p in parts if not p[-1].isspace()])
            for p in last:
                out |= self._learn([p])
            return out
        led = self._led(parts)
        got = self._joint(led)
        if got is not None:
            return dict(zip(led, got, strict=True))
        if len(parts) == 1:
            return {parts[0]: None}
        half = len(parts) // 2
        return self._learn(parts[:half]) | self._learn(parts[half:])

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, Counter]]:
        """Tokens of A and of B, groups, their text and how often each pair is linked; of each text."""
        for a, b, said, links in self.linked(texts):
            yield a, b, len(links), said, Counter(links.tolist())

    def linked(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        """Tokens of A and of B, the groups' text and the pair that each group links; of each text."""
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t or "")
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _cut(self, text: str | None) -> list[str]:
        """The parts of a text, of which the first begins with a space."""
        if not text:
            return []
        led = f" {text}"
        if self.fine:
            return _PARTS.findall(led)[:-1]  # the last is the empty one at the end
        return _SPACES.split(led) if self.parted else [led]

    def _block(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        cut = list(map(self._cut, texts))
        known, older = self.known, self.older
        new = []
        for p in [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in known]:
            if p in older:
                known[p] = older[p]
            else:
                new.append(p)
        own = self._learn(new)
        known.update(own)
        for t, parts in zip(texts, cut, strict=True):
            of = [*map(known.__getitem__, parts)]
            if None in of:  # the bytes of the whole text decide
                of = [v for v in self._learn([f" {t}"]).values() if v is not None]
            a, b, said, links = zip(*of, strict=True) if of else ((),) * 4
            yield sum(a), sum(b), ";".join(said), np.frombuffer(b"".join(links), np.int64)
        for p in own:
            if len(p) > LONGEST_REMEMBERED:
                del known[p]
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups string, pairs array<long>, times array<int>) for each row of docs.

    groups is as `a1,a2|b1;a3|b2,b3`; a pair is (id of A) << 32 | (id of B), times how often the text has it linked.
    Null, empty and texts that one of the tokenizers does not give back byte for byte have no tokens: zeros and ''.
    Whole texts; repeated rows give repeated results.
    """
    return _aligned(docs, paths, "groups", lambda said: said)


def _aligned(docs: DataFrame, paths: tuple[str, str] | None, name: str, of) -> DataFrame:
    where = paths or default_paths()
    names = ["n_a", "n_b", "n_groups", "n_links", name, "pairs", "times"]

    @F.pandas_udf(f"n_a long, n_b long, n_groups long, n_links long, {name} string, pairs array<long>, times array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, said, links in _aligner(*where).linked(list(texts)):
            pairs, times = np.unique(links, return_counts=True)
            rows.append((a, b, len(links), len(links), of(said), pairs, times.astype(np.int32)))
        return pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


def with_counts(aligned: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned (a stored table: pairs, times and a column row that is unique) with n_best and count_sum in place of pairs and times.

    A pair's count is how many links of all rows hold it; n_best is how many of a row's links have the highest count of
    all pairs with their B id (ties too), count_sum the sum of the counts over its links. Pairs are counted map-side
    first. Of the counts at most `most`, the highest, are broadcast, which is where nearly all links are; other links
    are joined by a shuffle, in which no pair is hot, since the hot ones have been met.
    """
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts, at = store(links.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    rated, rated_at = store(counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best")))
    # the count from which on pairs are broadcast: of a histogram by powers of two, which has 64 rows at most
    sizes = {r["p"]: r["n"] for r in rated.groupBy(F.floor(F.log2("count")).alias("p")).agg(F.count("*").alias("n")).collect()}
    least, n = 63, 0
    while least > 0 and n + sizes.get(least - 1, 0) <= most:
        least -= 1
        n += sizes.get(least, 0)
    often = F.col("count") >= F.lit(1 << least)
    met = links.join(F.broadcast(rated.where(often)), "pair", "left")
    partly = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    rare = met.where("count is null").select("row", "pair", "times").join(rated.where(~often), "pair") if least else None
    sums = met.where("count is not null").groupBy("row").agg(*partly)
    if rare is not None:
        sums = sums.union(rare.groupBy("row").agg(*partly)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out, out_at = store(sums)
    for path in (at, rated_at):
        discard(path)
    own = aligned.drop("pairs", "times").join(out, "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
    return own


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, repeated ones and those without doc_id too."""

    def digest(said: str) -> str:
        return hashlib.sha256(said.encode()).hexdigest() if said else ""

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with small_batches(spark, 500):
        aligned, _ = store(_aligned(docs, None, "groups_sha256", digest).withColumn("row", F.monotonically_increasing_id()))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return with_counts(aligned).select(*columns)
