"""Alignment, quality and ranking against brute force, with odd rows and odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from gleanline.llm import alignment, bpe, quality, queries, ranking

TEXTS = [
    None, "", " ", "one", "  two  spaces and one", "tab\tand\nlines\n\n  of words .\n", "héllo 😀 wörld 𐍈 <s> x <|endoftext|> </s>", "a▁b in a mark", "x " * 600, "don't 12345 ... !!! ￿ é é", "a\0b\x1c c \x85 d　e",
    "the cat sat on the mat", "the cat sat on the mat", "THE Cat, sat. naïve NAÏVE", "word" * 400,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score string, pair string, part int, term string, rated int, predicted string, item_id string"


def rows():
    return [(i, t, "en", "s", len(t or ""), 1, "own", "own", 1, "own", 1, "own", "own") for i, t in enumerate(TEXTS)] + [(None, TEXTS[11], *[None] * 11), (3, "one", *[None] * 11)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    items = [(1, "The cat"), (2, None), (3, ""), (4, "naïve 12345 one one"), (5, "absent terms solely"), (1, "mat"), (None, "spaces"), (6, "...")]
    spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string").write.parquet(f"{at}/benchmark.parquet")
    return at


def key(r):
    return tuple((v is None, v if v is not None else 0) for v in r)


def plainly_aligned(text, a, b):
    """Without parts and spans: decoded bytes only."""
    if not text:
        return None
    raw = f" {text}".encode()
    letters = {c: i for i, c in enumerate(bpe.byte_letters())}
    ids_a = a.encode(f" {text}", add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
    cuts = sorted(set(ends_a) & set(ends_b))
    low, said = 0, []
    for c in cuts:
        said.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= c) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
        low = c
    links = [(x, ids_b[ends_b.index(e)]) for x, e in zip(ids_a, ends_a, strict=True) if e in ends_b]
    return len(ids_a), len(ids_b), ";".join(said), links


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 5, 0])
def test_op11(spark, folder, monkeypatch, most):
    monkeypatch.setattr(alignment.with_counts, "__defaults__", (most,))
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    own = [(r[0], plainly_aligned(r[1], a, b)) for r in rows()]
    count = Counter(link for _, g in own if g for link in g[3])
    top = {y: max(n for (_, z), n in count.items() if z == y) for _, y in count}
    want = []
    for i, g in own:
        if g is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = g[3]
        want.append((i, g[0], g[1], g[2].count(";") + 1, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g[2].encode()).hexdigest()))
    assert sum(w[1] == 0 for w in want) >= 3 and max(w[3] for w in want) > 500
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in alignment.op11_alignment(spark, folder).select(*columns).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_align_and_spans(spark):
    docs = spark.createDataFrame([(1, "hi é", "x")], "doc_id long, text string, pairs string")
    r = alignment.align(docs).first()
    assert r["groups"].count(";") + 1 == r["n_groups"] and sum(r["times"]) == r["n_links"]
    assert alignment.align(docs.limit(0)).count() == 0
    # part of a character, a trimmed span and spans of their own
    ends = lambda spans, sizes: alignment.byte_ends(*np.array(spans).T, np.array(sizes)).tolist()
    assert ends([(0, 4), (0, 4), (5, 6)], [2, 2, 2]) == [2, 4, 6] and ends([(0, 2), (2, 5)], [2, 3]) == [2, 5]
    assert alignment.byte_places("aé😀").tolist() == [0, 1, 3, 7]


def test_parts_and_memory():
    """Parts encoded together, remembered ones and parts that cannot be encoded agree with whole texts."""
    own = alignment.Aligner(*alignment.default_paths())
    texts = ["the cat sat, the cat  sat\n on it ", "▁ bad the cat", "the cat ▁", "é the cat 😀 ", None, "", "x" * 500, " the  cat\t"] * 2
    got = list(own.align(texts))
    for t, g in zip(texts, got, strict=True):
        whole = own._joint([f" {t}"]) if t else None
        assert g[:2] + (g[3],) == ((whole[0][0], whole[0][1], whole[0][2]) if whole else (0, 0, "")) and g[2] == sum(g[4].values())
    assert got[:8] == got[8:] and own.known and own.known[" bad"] is not None


def test_parts_without_stops(monkeypatch):
    """A word is encoded once whatever stop or line end stands beside it."""
    own, joint, letters = alignment.Aligner(*alignment.default_paths()), alignment.Aligner._joint, []
    monkeypatch.setattr(own, "_joint", lambda parts: letters.append(sum(map(len, parts))) or joint(own, parts))
    words = ["".join(p) for p in itertools.product("ab", "eio", "nr", "éts")]
    texts = [" ".join(w + stop for w in words) + "\n" for stop in ("", ".", ",", "!!", "?", ";", ":", "...", ".\nB", "!\n\nC")]
    got = list(own.align(texts))
    assert sum(letters) < 2 * sum(len(w) + 1 for w in words)  # 215; 2,422 when stops were in the parts
    assert own.fine and [g[:2] + (g[3],) for g in got] == [joint(own, [f" {t}"])[0][:3] for t in texts]


def test_fine_cuts_at_random():
    """Texts of stops, spaces of all kinds, marks and contractions: as whole texts, and the parts make up the text."""
    own, draw = alignment.Aligner(*alignment.default_paths()), random.Random(11)
    of = [" ", " ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\r", ".", ",", ":", "!", "'", "'s", '"', "a", "B", "é", "×", "ª", "ж", "0", "½", "\u0308", "😀", "漢", "<s>", "<0x41>", "\0", "the", "U.S.", "\u200b"]
    texts = ["".join(draw.choices(of, k=draw.randint(1, 14))) for _ in range(600)] + ["a.▁", "▁.a", "a.b ▁,c"]
    for t, g in zip(texts, own.align(texts), strict=True):
        assert "".join(own._cut(t)) == f" {t}"
        whole = own._joint([f" {t}"])
        assert g[:2] + (g[3],) == (whole[0][:3] if whole else (0, 0, ""))
    own.fine = False  # as with a vocabulary that goes from letters to stops
    assert own._cut("a.b c\nd") == [" a.b", " c\nd"]


def best(docs, items, top=10):
    terms = lambda t: [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, length = len(own), sum(k for *_, k in own)
    df = Counter(w for _, c, _ in own for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ws in wanted.items():
        scores = []
        for d, c, k in own:
            m = 100 - 90 + (90 * k * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in ws if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=key)


def test_op13(spark, folder):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in ranking.op13_ranking(spark, folder).select("item_id", "rank", "doc_id", "score").collect()), key=key)
    assert got == best([r[:2] for r in rows()], items) and {g[0] for g in got} == {1, 4, None}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(queries.ORACLE_SQL["op13_ranking"]).fetchall(), key=key) == got


@pytest.mark.parametrize("block", [(1024, 10**6), (3, 10**6), (1024, 4)])
def test_ranking_in_blocks_with_ties(spark, block):
    rng = np.random.default_rng(2)
    docs = [(int(i) if i % 50 else None, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 6))))) for i in range(900)]
    docs += docs[:200]
    items = [(j, " ".join(rng.choice(list("abcdefghz"), 3))) for j in range(7)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ranking.search(d, spark.createDataFrame(items, "item_id int, text string"), 10, *block).collect()
    assert sorted(map(tuple, got), key=key) == best(docs, items)
    assert ranking.search(d.limit(0), spark.createDataFrame(items, "item_id int, text string")).count() == 0
    assert ranking.search(d, spark.createDataFrame([], "item_id int, text string")).columns == ["item_id", "rank", "doc_id", "score"]


def test_term_tiles_stay_exact():
    n = 300_000
    block = ranking.Block([0], {}, np.zeros(n, np.int64), np.arange(n))
    weights = np.full(n, 43_000, np.int64)
    tiles = ranking.term_tiles(block, weights, n)
    assert len(tiles) > 1 and all((b - a) * 43_000 * 1_000_000 < ranking.EXACT for a, b, _ in tiles) and tiles[-1][1] == n
    some = tiles[0][1] - 1, tiles[1][0] + 3
    got = ranking.tile_scores(tiles, np.array([5]), np.array([0, 0]), np.array(some), np.array([2, 1]), 10, 50)
    assert got.tolist() == [[43_000 * ((2 * 10**9) // (2000 + 8 * 100) + 10**9 // (1000 + 8 * 100))]]


@pytest.fixture(scope="module")
def rated(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(900)]
    texts, marks = [], []
    for i in range(1500):
        t = " ".join(rng.choice(words, int(rng.integers(20, 200)))) + "."
        bad = i % 6 == 0
        texts.append(t if not bad else [t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join([t[:9]] * 40)][i // 6 % 3])
        marks.append(int(not bad))
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([*enumerate(texts), (5000, None), (5001, ""), (None, "lone"), (7, texts[7])], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i % 5] + [(None, 1), (5, None), (9000, 1)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at, texts, marks


def test_op12(spark, rated):
    at, texts, marks = rated
    got = quality.op12_quality(spark, at).collect()
    assert len(got) == len(texts) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["held_out"] == (r["doc_id"] in held or (r["doc_id"] or 0) >= 5000 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    seen = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["doc_id"] in held]
    assert np.mean([p == m for p, m in seen]) > 0.95 and min(p for p, m in seen if m) >= 0
    # labels of held-out rows teach nothing
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    x, y = quality.learn(docs, labels), quality.learn(docs, turned)
    assert np.array_equal(x.weights, y.weights) and x.prior == y.prior and 0.7 < x.prior < 0.95
    by_id = {r["doc_id"]: r["score"] for r in got if r["doc_id"] is not None}
    for i in (0, 1, 2, 6, 12):
        z = x.weights[-1] + sum(w * (v > e) for w, v, e in zip(x.weights, (v for v, es in zip(quality.describe(texts[i]), x.edges, strict=True) for _ in es), np.concatenate(x.edges), strict=False))
        assert abs(by_id[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_on_odd_tables(spark, rated):
    at, texts, marks = rated
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    assert quality.learn(docs, labels.limit(0)) is None and quality.learn(docs, labels.where("quality = 0")) is None
    out = quality.rate(docs.limit(3).selectExpr("*", "'x' as rated", "'y' as SCORE"), None)
    assert out.columns == ["doc_id", "text", "rated", "score", "predicted"] and {(r["score"], r["predicted"]) for r in out.collect()} == {(0.5, 0)}
    only = quality.learn(docs, labels.where("quality = 1"))  # the prior comes from the texts
    assert 0.5 < only.prior < 0.98
    assert quality.rate(docs.limit(0), only).count() == 0
    assert quality.describe("a a a b") [quality.NAMES.index("longest_run")] == pytest.approx(math.log1p(3)) and quality.describe(None) == quality.describe("")


def test_nonnegative_risk():
    """With positives that cover all unlabelled texts the estimate of the negative risk falls below zero and is stepped back from."""
    rng = np.random.default_rng(0)
    p, u = rng.normal(size=(300, 3)), rng.normal(size=(300, 3))
    model = quality.fit(p, u, 0.9)
    assert np.isfinite(model.weights).all() and quality.score(model, u).mean() > 0.7
