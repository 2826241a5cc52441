"""Near-duplicate embeddings by an exact metric range join.

Vectors are scaled to length one, where cosine >= c is distance <= sqrt(2 - 2c). Each lies in the cell of its
nearest pivot. The triangle inequality in its Euclidean form (a vector's distance to the border between two cells)
says into which other cells it must be copied, and each cell is then joined on its own. Cells that are too large
for one task are cut into blocks that are joined pairwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import keep, table
from gleanline.llm.components import connected_components

LIKENESS = 0.9
#: About so many vectors a pivot, and so many pivots at most; they are chosen from a sample of this many times as many.
PER_PIVOT = 4096
MOST_PIVOTS = 2048
#: Vectors of a cell that one task compares with as many others.
BLOCK = 4096
#: Slack for rounding where bounds are compared; what passes is still verified in double precision.
SLACK = 1e-6


def _unit(rows) -> np.ndarray:
    """Rows in double precision, scaled to length one; first by their largest component, whose square may be out of range."""
    x = np.array(list(rows), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots(vectors: DataFrame, n: int) -> np.ndarray | None:
    """Pivots far from one another, from a bounded sample by hash of the vectors of the commonest length."""
    k = min(MOST_PIVOTS, max(1, n // PER_PIVOT))
    size = vectors.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()["size"]
    share = min(1.0, (4 * k + 64) / max(n, 1))
    drawn = vectors.where(F.size("embedding") == size).where(F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 20)) < max(share * (1 << 20), 1))
    rows = sorted((r["rep"], r["embedding"]) for r in drawn.select("rep", "embedding").collect())
    if not rows:
        return None
    x = _unit(e for _, e in rows)
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(k, len(x)) and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def cells(vectors: DataFrame, centers: np.ndarray | None, likeness: float) -> DataFrame:
    """(cell, home, rep, n, embedding): each vector in the cell of its nearest pivot (home) and, of the cells before it, in those within reach.

    A pair of different cells is met in the lesser of the two only. Vectors of another length than the pivots'
    have a cell for each length.
    """
    reach = float(np.sqrt(2 - 2 * likeness)) + SLACK
    if centers is not None:
        apart = np.linalg.norm(centers[:, None] - centers[None], axis=2)

    def run(batches):
        for batch in batches:
            size = batch["embedding"].map(len).to_numpy()
            main = size == (centers.shape[1] if centers is not None else -1)
            rest = batch[~main]
            if len(rest):
                yield rest.assign(cell=-size[~main].astype(np.int64), home=True)[["cell", "home", "rep", "n", "embedding"]]
            own = batch[main]
            if not len(own):
                continue
            square = np.maximum(2 - 2 * (_unit(own["embedding"]) @ centers.T), 0)
            home = square.argmin(axis=1)
            rows = np.arange(len(own))
            yield own.assign(cell=home.astype(np.int64), home=True)[["cell", "home", "rep", "n", "embedding"]]
            border = (square - square[rows, home][:, None]) / np.maximum(2 * apart[home], 1e-12)
            near = (border <= reach) & (np.arange(len(centers))[None] < home[:, None])
            for c in np.flatnonzero(near.any(axis=0)):
                yield own[near[:, c]].assign(cell=int(c), home=False)[["cell", "home", "rep", "n", "embedding"]]

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("rep", "n", "embedding").mapInPandas(run, f"cell long, home boolean, rep long, n long, embedding {kind}")


def _spread(linked: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """The least rep of each one's component in a symmetric matrix of links."""
    label = reps.copy()
    while True:
        new = label.copy()
        for at in range(0, len(label), 512):
            part = linked[at : at + 512]
            new[at : at + 512] = np.minimum(label[at : at + 512], np.where(part, label[None], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == label).all():
            return label
        label = new


def _links(x: np.ndarray, y: np.ndarray, likeness: float) -> np.ndarray:
    """Which pairs are alike: found in single precision, with room for its error, and settled in double precision."""
    rough = x.astype(np.float32) @ y.astype(np.float32).T >= likeness - 1e-4
    out = np.zeros(rough.shape, bool)
    a, b = np.nonzero(rough)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        out[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= likeness
    return out


def join_cells(placed: DataFrame, likeness: float, block: int = BLOCK) -> DataFrame:
    """(rep, n_links, near): of each distinct vector how many rows it is linked to in a cell, and one it connects to."""
    sizes = {c: (h, g) for c, h, g in placed.groupBy("cell").agg(F.sum(F.col("home").cast("long")), F.sum((~F.col("home")).cast("long"))).collect()}
    if not sizes:
        return placed.select("rep", F.col("n").alias("n_links"), F.col("rep").alias("near"))
    cut = {c: (max(1, -(-h // block)), max(1, -(-g // block)) if g else 0) for c, (h, g) in sizes.items()}
    homes = F.create_map(*(F.lit(v) for c, (h, _) in cut.items() for v in (c, h)))[F.col("cell")]
    guests = F.create_map(*(F.lit(v) for c, (_, g) in cut.items() for v in (c, g)))[F.col("cell")]
    own = F.pmod(F.xxhash64("rep", F.lit("block")), F.when(F.col("home"), homes).otherwise(guests)).cast("int")
    # block pairs: a home block meets itself, each later home block and each guest block (numbered from homes on)
    with_home = F.transform(F.sequence(F.lit(0), homes - 1), lambda i: F.struct(F.least(i, own).alias("a"), F.greatest(i, own).alias("b")))
    with_guest = F.when(guests > 0, F.transform(F.sequence(F.lit(0), guests - 1), lambda g: F.struct(own.alias("a"), (homes + g).alias("b")))).otherwise(F.array())
    guest = F.transform(F.sequence(F.lit(0), homes - 1), lambda i: F.struct(i.alias("a"), (homes + own).alias("b")))
    meets = F.when(F.col("home"), F.concat(with_home, with_guest)).otherwise(guest)
    blocks = placed.withColumn("own", F.when(F.col("home"), own).otherwise(homes + own)).withColumn("m", F.explode(meets)).select("cell", "m.a", "m.b", "own", "rep", "n", "embedding")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        first = (group["own"] == group["a"]).to_numpy()
        same = group["a"].iloc[0] == group["b"].iloc[0]
        x, reps, n = _unit(group["embedding"]), group["rep"].to_numpy(), group["n"].to_numpy()
        if same:
            linked = _links(x, x, likeness)
            linked |= linked.T
            np.fill_diagonal(linked, False)
            total, root = linked @ n, _spread(linked, reps)
        else:
            i, j = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(i) or not len(j):
                return pd.DataFrame({"rep": [], "n_links": [], "near": []}, dtype="int64")
            part = _links(x[i], x[j], likeness)
            total = np.zeros(len(x), np.int64)
            total[i], total[j] = part @ n[j], part.T @ n[i]
            root = reps.copy()
            hit_i, hit_j = part.any(axis=1), part.any(axis=0)
            both = np.concatenate((i[hit_i], j[hit_j]))
            grid = np.zeros((len(both), len(both)), bool)
            k = int(hit_i.sum())
            grid[:k, k:] = part[np.ix_(hit_i, hit_j)]
            grid |= grid.T
            root[both] = _spread(grid, reps[both])
        hit = total > 0
        return pd.DataFrame({"rep": reps[hit], "n_links": total[hit].astype(np.int64), "near": root[hit]})

    return blocks.groupBy("cell", "a", "b").applyInPandas(run, "rep long, n_links long, near long")


def embedding_links(embeddings: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings (vec_id, embedding).

    Vectors are linked if their cosine in double precision is at least likeness, whatever else the table holds.
    Null and zero vectors, those with a null or non-finite component and those without vec_id link with nothing
    and are kept, each its own component. Equal vectors count as one with a multiplicity during the join, and link
    to one another. Vectors of different lengths never link. Repeated rows with one vec_id count as rows.
    """
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = keep(embeddings.select("vec_id", F.col("embedding").cast(kind).alias("embedding")))
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fit = e.isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0)
    sound = F.coalesce(fit, F.lit(False))
    vectors = keep(rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("n")))
    # a number of its own for each different vector, since several may have one vec_id
    vectors = keep(vectors.withColumn("rep", F.monotonically_increasing_id()))
    n = vectors.count()
    if n:
        placed = keep(cells(vectors, pivots(vectors, n), likeness))
        found = keep(join_cells(placed, likeness))
        comps = connected_components(found.select(F.col("rep").alias("a"), F.col("near").alias("b")))
        sums = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
        facts = vectors.join(sums, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        facts = keep(facts.select("embedding", "vec", "comp", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
        least = facts.groupBy("comp").agg(F.min("vec").alias("component_id"))
        facts = facts.join(least, "comp").select("embedding", "n_links", "component_id")
    else:
        facts = vectors.select("embedding", F.col("n").alias("n_links"), F.col("vec").alias("component_id"))
    facts = keep(facts)
    linked = rows.where(sound).join(facts, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
