"""Near copies by words: SimHash groups them first, exact prefixes of ordered shingle sets find what it missed.

SimHash over five-word shingles, searched by the generalised pigeonhole (simhash.py), gives candidates at a distance
at which that search stays cheap. Texts of similarity 0.8 differ in about ten of 64 bits, where it does not; so what
it leaves is completed by a join that misses nothing. After Xiao et al., "Efficient Similarity Joins for Near
Duplicate Detection" (WWW 2008): if all sets are put in one order, two sets of Jaccard similarity t share one of
their first n - ceil(t n) + 1 members. Every candidate is compared by its whole set.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanline.llm.common import discard, keep, small_batches, store
from gleanline.llm.components import connected_components
from gleanline.llm.simhash import hamming_edges, majority, shingle_hashes

#: Differing bits within which fingerprints are candidates.
DISTANCE = 2
#: Shingles are ordered by how often a sample has them, so that common ones are seldom in a prefix: this share of the
#: texts, and about so many at least. A fixed number would leave more of them unseen the more texts there are. Any
#: order finds all pairs.
ORDER_SHARE, ORDER_TEXTS = 1 / 8, 8000
#: Shingles in fewer of those texts count as equally rare; of the others so many are told apart at most (16 bytes each).
COMMON, COMMON_AT_MOST = 3, 200_000
#: A bucket's members meet so many of them first; each member is compared with the MET_MOST that it meets most often.
LEADERS, MET_MOST = 4, 3
#: Turns in which crowded keys meet leaders, of which there are twice LEADERS in the first and twice as many in each further one.
TURNS = 5
#: Others outside its key's main component that a point has on the average, up to which the last turn follows at once.
CROWDED = 64
#: Fewest bits of the parities by which pairs that are not alike are told without their sets; larger sets have more.
PARITIES = 1024
#: Up to so many ids (16 bytes each) are broadcast to find their texts; more are shuffled with them.
BROADCAST_IDS = 200_000


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of every k words in a row; of all of them if there are fewer."""
    return np.unique(shingle_hashes(text, k)).view(np.int64)


def _common(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a sample of the different texts have, in the order of their hashes, and how many have them."""

    def own(batches):
        for batch in batches:
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.int64), *(shingle_set(t, k) for t in batch["text"])])})

    share = min(1.0, max(ORDER_SHARE, ORDER_TEXTS / max(texts.count(), 1)))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select("text").distinct()
    with small_batches(texts.sparkSession):
        counted, at = store(some.mapInPandas(own, "h long").groupBy("h").count().where(F.col("count") >= COMMON))
    got = counted.where(F.col("count") >= _least(counted)).toPandas().sort_values("h")
    discard(at)
    return got["h"].to_numpy(np.int64), got["count"].to_numpy(np.int64)


def _least(counted: DataFrame, most: int = COMMON_AT_MOST) -> int:
    """The count from which on at most so many shingles are as frequent: of a histogram in eighths of powers of two, whose size is bounded."""
    sizes = counted.groupBy(F.floor(8 * F.log2("count")).alias("step")).agg(F.count("*").alias("n"), F.min("count").alias("least"), F.max("count").alias("top")).orderBy(F.desc("step")).collect()
    least, n = max((r["top"] for r in sizes), default=0) + 1, 0
    for r in sizes:
        n += r["n"]
        if n > most:
            break
        least = r["least"]
    return least


def parities(own: np.ndarray) -> np.ndarray:
    """Of classes of hashes whether an odd number of the set is in each. No more of them differ between two sets than members do.

    There are PARITIES classes, or the least power of two that the set does not exceed: with fewer, about half would
    differ between any two large sets. Of twice the classes each half, put together by exclusive or, gives the classes.
    """
    many = max(PARITIES, 1 << (len(own) - 1).bit_length()) if len(own) else PARITIES
    odd = np.bincount((own.view(np.uint64) >> np.uint64(20)) % np.uint64(many), minlength=many).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _differing(odd, odd2):
    """How many parities differ; of the longer array its halves are put together. Null if one has over twice the other's."""
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    x, y = F.when(F.size(odd) > F.size(odd2), half(odd)).otherwise(odd), F.when(F.size(odd2) > F.size(odd), half(odd2)).otherwise(odd2)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def prefix(own: np.ndarray, similarity: float, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first n - ceil(similarity n) + 1 members of a sorted set, the rare ones first; how many of them, the last, are common."""
    if not len(own):
        return own, 0
    often = np.zeros(len(own), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        often = np.where(hashes[at] == own, counts[at], 0)
    order = np.argsort(often, kind="stable")[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]
    return own[order], int((often[order] > 0).sum())


def _described(docs: DataFrame, k: int, similarity: float, common, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest of the shingle set or null without any, n shingles, fp, their parities, the first of them, how many of these are common)."""

    @F.pandas_udf("digest binary, n int, fp long, odd array<long>, first array<long>, m int")
    def described(texts: pd.Series) -> pd.DataFrame:
        digests, n, fp, odd, first, m = [], [], [], [], [], []
        for t in texts:  # one text's words at a time: a batch of them at once is what a worker's memory goes to
            hashes = shingle_hashes(t, k)
            own = np.unique(hashes).view(np.int64)
            digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            n.append(len(own))
            fp.append(majority(hashes))
            odd.append(parities(own))
            some, often = prefix(own, similarity, *common)
            first.append(some)
            m.append(often)
        return pd.DataFrame({"digest": digests, "n": n, "fp": fp, "odd": odd, "first": first, "m": m})

    return docs.select(F.col(id_col).alias("doc_id"), described(F.col(text_col)).alias("d")).select("doc_id", "d.*")


def _points(nodes: DataFrame) -> DataFrame:
    """(key, rep, n, left): the shingles of the prefixes, and how many of the set come after them.

    Most shingles are in one text only: they are counted, with partial sums first, and what others have too is joined, so
    that adaptive execution can split a key that many texts share. Those that the sample has need no count.
    """
    points = nodes.select("rep", "n", (F.size("first") - F.col("m")).alias("rare"), F.posexplode("first").alias("at", "key"))
    points = points.select("key", "rep", "n", (F.col("n") - F.col("at") - 1).alias("left"), (F.col("at") < F.col("rare")).alias("rare"))
    rare = points.where("rare").drop("rare")
    shared = rare.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    return rare.join(shared, "key", "left_semi").unionByName(points.where("not rare").drop("rare"))


def _may(n2, left2, similarity: float):
    """Whether two sets can be alike whose first common member is this one: by their sizes and what comes after it."""
    sizes = F.least("n", n2) >= similarity * F.greatest("n", n2) - 1e-9
    return sizes & (1 + F.least("left", left2) >= similarity / (1 + similarity) * (F.col("n") + n2) - 1e-9)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).where("a <> b").distinct()


def _near(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) but those whose parities (rep, n, odd) differ more than sets of that similarity can."""
    x, y = marks.toDF("a", "n", "odd"), marks.toDF("b", "n2", "odd2")
    both = pairs.join(x, "a").join(y, "b").where(F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9)
    return keep(both.where(_differing(F.col("odd"), F.col("odd2")) <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("n2")) + 1e-9).select("a", "b"))


def _alike(pairs: DataFrame, marks: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of ids whose sets of k-word shingles have that Jaccard similarity at least."""
    pairs = _near(pairs, marks, similarity)

    @F.pandas_udf("array<long>")
    def own_set(own: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, k) for t in own], dtype=object)

    ids = keep(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct())
    own = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rep", "left_semi")
    with small_batches(texts.sparkSession):
        sets, path = store(own.select("rep", own_set("text").alias("s")))
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
    both = both.where(F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")) - 1e-9)
    common = F.size(F.array_intersect("x", "y"))
    good = keep(both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b").distinct())
    discard(path)
    return good


def _simhash_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints are equal (each with the least of them) or linked by the pigeonhole search."""
    fps = keep(nodes.groupBy("fp").agg(F.min("rep").alias("rep")))
    same = nodes.select("fp", F.col("rep").alias("rep2")).join(fps, "fp").select("rep", "rep2")
    return _ordered(same.union(hamming_edges(fps, distance).toDF("rep", "rep2")))


def _with_component(points: DataFrame, good: DataFrame) -> DataFrame:
    found = connected_components(good)
    return points.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _mixed(points: DataFrame) -> tuple[DataFrame, str]:
    """The points of the keys at which different components meet, with the component that most of a key's points are in and how many are not; stored."""
    sizes = points.groupBy("key", "comp").agg(F.count("*").alias("many"))
    main = sizes.groupBy("key").agg(F.max(F.struct("many", "comp")).alias("m"), F.count("*").alias("comps"), F.sum("many").alias("all")).where("comps > 1")
    return store(points.join(main.select("key", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.many")).alias("outside")), "key"))


def _enough(pairs: DataFrame, similarity: float) -> DataFrame:
    """(rep, rep2) of rows (rep, rep2, both, rest), one for each common member in the prefixes of two sets, that may be alike.

    both is the sum of their sizes, rest how many members at most come after this one in both. So they have no more in
    common than the rows that they have and the least rest.
    """
    met = pairs.groupBy("rep", "rep2").agg(F.count("*").alias("met"), F.min("rest").alias("rest"), F.min("both").alias("both"))
    return met.where(F.col("met") + F.col("rest") >= similarity / (1 + similarity) * F.col("both") - 1e-9).select("rep", "rep2", "met")


def _leader_pairs(points: DataFrame, similarity: float, leaders: int) -> DataFrame:
    """Pairs of a text and the leaders it meets most often, MET_MOST a text at most.

    A key's leaders are those (one of each class by a hash) in whose order it comes first: texts that have little of
    their own before it. In a group of copies each with its own changes these are the least changed, and what links
    to any of the group nearly always links to them.
    """
    own = F.struct((F.lit(1.0) - F.col("left") / F.col("n")).cast("float").alias("place"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("rep").alias("rep2"))
    led = points.groupBy("key").agg(*(F.min(F.when(F.pmod(F.xxhash64("rep"), F.lit(leaders)) == j, own)).alias(f"l{j}") for j in range(leaders)))
    led = led.select("key", F.array_compact(F.array(*(f"l{j}" for j in range(leaders)))).alias("l"))
    met = points.join(led, "key").select("rep", "n", "left", F.filter("l", lambda x: (x.rep2 != F.col("rep")) & _may(x.n2, x.left2, similarity)).alias("l"))
    met = met.where(F.size("l") > 0).select("rep", F.explode(F.transform("l", lambda x: F.struct(x.rep2.alias("rep2"), (F.col("n") + x.n2).alias("both"), F.least("left", x.left2).alias("rest")))).alias("x")).select("rep", "x.*")
    most = _enough(met, similarity).groupBy("rep").agg(F.collect_list(F.struct((-F.col("met")).alias("d"), "rep2")).alias("all"))
    return _ordered(most.select("rep", F.explode(F.slice(F.sort_array("all"), 1, MET_MOST)).alias("x")).select("rep", "x.rep2"))


def _turn_pairs(points: DataFrame, similarity: float, leaders: int, turn: int) -> DataFrame:
    """Pairs of each point of a crowded key and the key's leaders of this turn that are in other components: so many a point at most.

    A leader is the first of its class by a hash that changes with the turn but not with the key, so that a group's keys have
    the same leaders and a pair that meets at many keys is one pair.
    """
    order = F.xxhash64("rep", F.lit(turn))
    own = F.struct(order.alias("order"), F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("comp").alias("comp2"))
    each = points.groupBy("key", F.pmod(order, F.lit(leaders)).alias("class")).agg(F.min(own).alias("l"))
    led = each.groupBy("key").agg(F.collect_list("l").alias("l"))
    met = points.join(led, "key").select("rep", F.filter("l", lambda x: (x.comp2 != F.col("comp")) & _may(x.n2, x.left2, similarity)).alias("l")).where(F.size("l") > 0)
    return _ordered(met.select("rep", F.explode(F.transform("l", lambda x: x.rep2)).alias("rep2")))


def _rest_pairs(points: DataFrame, similarity: float) -> DataFrame:
    """All pairs that may still be alike and are in different components: of a key's points those outside its main component with the others.

    A key is cut by the sizes of sets first: in steps of 1 / similarity, alike sets are in the same step or in neighbours.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similarity) + 1e-9).cast("int")
    x = points.where("comp <> main").withColumn("step", F.explode(F.array(step - 1, step, step + 1)))
    y = points.select("key", step.alias("step"), F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("comp").alias("comp2"))
    once = (F.col("comp2") == F.col("main")) | (F.col("rep") < F.col("rep2"))
    pairs = x.join(y, ["key", "step"]).where((F.col("comp") != F.col("comp2")) & once & _may(F.col("n2"), F.col("left2"), similarity))
    low, high = F.least("rep", "rep2").alias("rep"), F.greatest("rep", "rep2").alias("rep2")
    return _ordered(_enough(pairs.select(low, high, (F.col("n") + F.col("n2")).alias("both"), F.least("left", "left2").alias("rest")), similarity))


def near_copy_components(docs: DataFrame, k: int = 5, similarity: float = 0.8, leaders: int = LEADERS, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row of docs: component_id is the least doc_id reachable over links.

    Texts link if their sets of k-word shingles (fewer words: the whole sequence) have at least that Jaccard
    similarity; all such pairs end in one component. Null texts and texts without a word link nothing; a row without
    doc_id has no component. Rows that share an id count as one document; repeated rows give repeated results. Other
    columns of docs are ignored.

    Equal sets count as one text. A bucket may hold a large group of copies, and pairing it would be quadratic. So
    candidates come in turns, and what is in one component by then is not compared any more: first those of SimHash and
    of the buckets' least changed texts; then, as long as points have many others to meet, those of crowded keys
    with a few leaders, twice as many each turn; then, of the keys where different components still meet, all pairs
    that sizes and places allow. Only the last turn is needed to miss nothing; the others make it small.
    """
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).where("rep is not null and text is not null")
    with small_batches(docs.sparkSession):
        rows, rows_at = store(_described(docs, k, similarity, _common(texts, k), id_col, text_col))
    nodes = rows.where("doc_id is not null and digest is not null").groupBy("digest")
    nodes, nodes_at = store(nodes.agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "fp", "odd", "first", "m"))))
    links = keep(rows.join(nodes.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    discard(rows_at)
    marks, marks_at = store(nodes.select("rep", "n", "odd"))
    points, points_at = store(_points(nodes))
    first = _leader_pairs(points, similarity, leaders)
    good = _alike(_simhash_pairs(nodes, distance).union(first).distinct(), marks, texts, k, similarity)
    discard(nodes_at)
    mixed, mixed_at = _mixed(_with_component(points, good))
    for turn in range(TURNS):
        many = 2 * leaders << turn
        load = mixed.agg(F.count("*").alias("points"), F.sum("outside").alias("pairs")).first()
        if not load["points"] or load["pairs"] <= CROWDED * load["points"]:
            break
        crowded = mixed.where(F.col("outside") > 2 * many)
        good = keep(good.union(_alike(_turn_pairs(crowded, similarity, many, turn), marks, texts, k, similarity)).distinct())
        before = mixed_at
        mixed, mixed_at = _mixed(_with_component(mixed.drop("main", "outside", "comp"), good))
        discard(before)
    good = good.union(_alike(_rest_pairs(mixed, similarity), marks, texts, k, similarity))
    for path in (mixed_at, points_at, marks_at):
        discard(path)
    found = keep(connected_components(links.union(good)))
    out = docs.select(F.col(id_col).alias("doc_id")).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
