"""Best-fit packing of documents into sequences, improved by a swap-based local search.

Pieces are dealt evenly into shards by a hash and each shard is packed on its own: first best fit, longest first,
then exchanges between the bins that are not full. Moves, one-for-one and two-for-one exchanges are taken if
they raise the sum of squared fills, which drains the emptier bins until they vanish.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.bpe import default_path, load
from gleanline.llm.common import free_name, keep, table

SEQUENCE = 4096
END_ID = 1
#: Pieces of a shard, about; each shard may waste part of one sequence.
SHARD = 50_000
#: Bins that may fail to give in a row, and partners that each looks at, fullest first: how long the search goes on.
TRIES = 200
#: Pieces and words remembered in a task, and the letters of the longest that is.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 64


def best_fit(lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that has room. One bit for each amount of room."""
    bins: list[list[int]] = []
    at: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            at[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def _exchange(own: list[tuple[int, int]], theirs: list[tuple[int, int]], room: int):
    """What to put from own and take from theirs so that theirs gains most, up to room: a move, one for one, or two for one."""
    k = bisect_right(own, (room, float("inf"))) - 1
    if k >= 0:
        return [own[k]], []
    put, take, gain = [], [], 0

    def better(given):
        nonlocal put, take, gain
        n = sum(x for x, _ in given)
        j = bisect_left(theirs, (n - room, -1))
        if j < len(theirs) and gain < n - theirs[j][0] <= room:
            put, take, gain = given, [theirs[j]], n - theirs[j][0]

    for x in own:
        better([x])
    for x in range(len(own) - 1):
        for y in range(x + 1, min(len(own), x + 33)):
            if gain < room:
                better([own[x], own[y]])
    return put, take


def local_search(bins: list[list[int]], lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Moves and exchanges from emptier to fuller bins, as long as one is found: each raises the sum of squared fills.

    The emptiest bin gives first; if it can give nothing, the next emptiest does. It ends when the documents of
    the bins that are not full could not do with fewer.
    """
    members = [sorted((lengths[i], i) for i in b) for b in bins]
    part = sorted((f, b) for b, m in enumerate(members) if 0 < (f := sum(n for n, _ in m)) < size)
    room, k = sum(size - f for f, _ in part), 0
    while k < min(len(part) - 1, TRIES) and room >= size:
        fill, low = part[k]
        for at in range(len(part) - 1, max(k, len(part) - 1 - TRIES), -1):
            f, b = part[at]
            put, take = _exchange(members[low], members[b], size - f)
            if put:
                break
        else:
            k += 1
            continue
        for x in put:
            members[low].remove(x)
            insort(members[b], x)
        for x in take:
            members[b].remove(x)
            insort(members[low], x)
        gain = sum(n for n, _ in put) - sum(n for n, _ in take)
        del part[at], part[k]
        for now, c in ((f + gain, b), (fill - gain, low)):
            if 0 < now < size:
                insort(part, (now, c))
        room, k = sum(size - f for f, _ in part), 0
    return [[i for _, i in m] for m in members if m]


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


class _Memory(dict):
    """Piece or word to its ids as little-endian bytes; each distinct word goes through the library's model once."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary, self.model = load(path), _library(path).model

    def __missing__(self, piece):
        v = self.vocabulary
        if piece in v.special:
            out = array("I", [v.special[piece]]).tobytes()
        else:
            words = v.words(piece)
            if words == [piece]:
                letters = piece if piece.isascii() and piece.isprintable() else "".join([v.letters[b] for b in piece.encode("utf-8", "replace")])
                out = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            else:
                out = b"".join([self[w] for w in words])
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def _memory(path: str) -> _Memory:
    return _Memory(path)


def library_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts by the tokenizers library, as little-endian bytes; words never merge across white space."""
    memory, cut = _memory(path), load(path).pieces
    return [b"".join(map(memory.__getitem__, cut(t))) for t in texts]


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and an end id, cut after every size ids. A null text counts as empty."""
    where, end = path or default_path(), END_ID.to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = library_ids([text or ""], where)[0] + end
                for p, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    rows.append((None if pd.isna(doc_id) else int(doc_id), p, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        _memory(where).clear()  # the worker lives on, beside those of later stages

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, size: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """parts (with a column length, at most size) with sequence_id and offset: each sequence is gapless from 0 and at most size long.

    Shards are dealt by a hash of the row's place in the kept table, so that equal rows spread over all shards. An
    empty table stays empty. Other columns stay as they are.
    """
    parts = keep(parts.drop("sequence_id", "offset"))
    shards = max(1, -(-parts.count() // shard))
    shard_col = free_name(parts, "shard__")
    plain, kinds = parts.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([c for c in plain], kind="stable", ignore_index=True)
        lengths = group["length"].tolist()
        seq, off = [0] * len(lengths), [0] * len(lengths)
        bins = local_search(best_fit(lengths, size), lengths, size)
        first = int(group[shard_col].iloc[0]) << 32
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                seq[i], off[i] = first + b, at
                at += lengths[i]
        return group[plain].assign(sequence_id=seq, offset=off)

    dealt = parts.withColumn(shard_col, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    return dealt.groupBy(shard_col).applyInPandas(run, f"{kinds}, sequence_id long, `offset` long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each row of documents; null text is empty and has its end id alone; a null doc_id stays null, repeated rows are packed each."""
    return pack(pieces(table(spark, sf_dir, "documents")))
