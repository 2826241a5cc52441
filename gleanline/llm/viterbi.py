"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each place; dynamic programming
carries the best score and how many tokens it takes. The rules for ties, unknown letters and bytes are those of
the unigram model of the tokenizers library, so the counts are its counts.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import table

#: Stands for a space; every word begins with one.
MARK = "▁"
#: Fixed by the library: how much worse an unknown letter is than the worst piece.
UNKNOWN_PENALTY = 10.0
INFINITY = float("inf")
#: Words remembered in a task, and the letters of the longest that is.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """The pieces of a public SentencePiece file with their scores, read as a unigram vocabulary; and the unknown's number."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter(dict):
    """Word (with its mark) to the number of its tokens."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.names = {p for p, _ in pieces}
        self.longest = max(map(len, self.names), default=0)
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces:
            if p:
                self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def count(self, text: str) -> int:
        """Tokens of a word on its best path.

        Carried for each place: the best score, the tokens before the run of unknown letters in which the path ends,
        where that run begins (-1: it ends in a known piece) and the run's bytes (-1: some byte is no piece). A tie
        leaves the path whose last piece begins first.
        """
        score, tokens, begin, raw = [0.0], [0], [-1], [0]
        hits = self.automaton.iter(text)
        hit = next(hits, None)
        for end in range(1, len(text) + 1):
            best, at, single = -INFINITY, -1, False
            while hit is not None and hit[0] == end - 1:
                size, own = hit[1]
                single = single or size == 1
                now, start = score[end - size] + own, end - size
                if now > best or (now == best and start < at):
                    best, at = now, start
                hit = next(hits, None)
            last = end - 1
            if not single and (at < 0 or score[last] + self.unknown > best):
                more = self._bytes(text[last])
                score.append(score[last] + self.unknown)
                tokens.append(tokens[last])
                begin.append(begin[last] if begin[last] >= 0 else last)
                raw.append(-1 if more < 0 or raw[last] < 0 else raw[last] + more)
            else:
                score.append(best)
                tokens.append(self._total(text, at, tokens[at], begin[at], raw[at]) + 1)
                begin.append(-1)
                raw.append(0)
        return self._total(text, len(text), tokens[-1], begin[-1], raw[-1])

    def _total(self, text: str, end: int, tokens: int, begin: int, raw: int) -> int:
        """Tokens up to a place: those before its run, and for the run one a byte, or one if it is a piece or lacks a byte."""
        if begin < 0:
            return tokens
        whole = end - begin <= self.longest and text[begin:end] in self.names
        return tokens + (1 if whole or raw < 0 else raw)

    def _bytes(self, letter: str) -> int:
        raw = letter.encode("utf-8", "replace")
        return len(raw) if all(f"<0x{b:02X}>" in self.names for b in raw) else -1

    def __missing__(self, word):
        n = self.count(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path)[0])


def words(text: str) -> list[str]:
    """Words as the library's Metaspace step has them: each space becomes the mark, a mark comes first, and each mark begins a word."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    head, *rest = marked.split(MARK)
    return ([head] if head else []) + [MARK + w for w in rest]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_words) for each row of docs. Null and empty texts have none; whole texts, one pass, no shuffle."""
    where = path or default_path()

    @F.pandas_udf("n_tokens long, n_words long")
    def run(texts: pd.Series) -> pd.DataFrame:
        counter, rows = _counter(where), []
        for t in texts:
            own = words(_led(t))
            rows.append((sum(map(counter.__getitem__, own)), len(own)))
        return pd.DataFrame(rows, columns=["n_tokens", "n_words"])

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.n_tokens", "r.n_words")


def _led(text: str | None) -> str:
    """With the mark in front, if it does not begin with one."""
    if not text:
        return ""
    return text if text[0] in (" ", MARK) else MARK + text


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
