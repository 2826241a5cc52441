"""Near copies of the pipeline: how the pairs grow with a group, and that no link is lost."""

import numpy as np
import pytest

from gleanline.llm import nearcopies


def group(n, seed=4):
    """Copies of a text of 200 words, each with one block of 10 words of its own."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        at = int(rng.integers(0, 190))
        out.append(" ".join(base[:at] + [f"own{i}x{j}" for j in range(10)] + base[at + 10 :]))
    return out


def brute(texts, similarity=0.8):
    sets = [set(nearcopies.shingle_set(t, 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and common >= similarity * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture()
def asked(monkeypatch):
    """Counts the pairs that are asked for after the first turn."""
    many = []
    for name in ("_turn_pairs", "_rest_pairs"):
        real = getattr(nearcopies, name)

        def counted(*a, real=real):
            pairs = real(*a)
            many.append(pairs.count())
            return pairs

        monkeypatch.setattr(nearcopies, name, counted)
    return many


def test_pairs_grow_with_the_group_and_not_its_square(spark, asked):
    each = {}
    for n in (150, 600):
        asked.clear()
        texts = group(n)
        got = nearcopies.near_copy_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert [r["component_id"] for r in sorted(got.collect())] == brute(texts)
        each[n] = sum(asked)
    print(each)
    assert each[600] <= 8 * each[150] and each[600] < 600 * 600 / 8


def test_a_group_of_strangers_loses_nothing(spark):
    """A common frame and changes at other places in each: some pairs are just alike, most just not."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(90):
        words = list(base[: 150 - int(rng.integers(0, 40))])
        for at in rng.choice(len(words), int(rng.integers(0, 6)), replace=False):
            words[at] = f"x{i % 30}y{at}"
        texts.append(" ".join(words))
    texts += [None, "", "w1 w2", "w1 w2", texts[3]]
    got = nearcopies.near_copy_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), leaders=1)
    want = brute([t or "" for t in texts])
    assert [r["component_id"] for r in sorted(got.collect())] == want and len(set(want)) > 5


def test_common_shingles_are_bounded(spark):
    counted = spark.createDataFrame([(i, 3 + i % 7) for i in range(700)], "h long, count long")
    for most in (0, 99, 100, 250, 699, 700, 1000):
        least = nearcopies._least(counted, most)
        assert counted.where(f"count >= {least}").count() <= most
    assert nearcopies._least(counted, 700) == 3 and nearcopies._least(counted, 100) == 9


def test_pipeline_stage_with_shared_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"z{i}" for i in range(30_000))
    rows = [(1, "a b c d e f g"), (1, "quite another text of that id"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "only here it is"), (None, "only here it is"), (3, long), (4, long + " end"), (2**62 + 5, "large number of its own"), (5, "quite another text of that id"), (6, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", 7, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, own_id int, component_id string")
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "-")[:5]) for r in out.collect())
    assert got == [(False, 1, "a b c"), (False, 1, "quite"), (False, 3, "z0 z1"), (False, 6, "-"), (False, 6, "-"), (False, 2**62 + 5, "large"), (True, 0, "only ")]
