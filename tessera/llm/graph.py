"""Connected components: contraction inside parts of bounded size, then alternating large and small stars (Kiveris and
others, 2014) on DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, resplit

MOST_ROUNDS = 60
#: Edges of a part, about, that one task contracts.
PART = 1 << 18


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each is connected with by these."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[label]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if held:
            nodes, roots = contract(*(np.concatenate(c) for c in zip(*held, strict=True)))
            for k in range(0, len(nodes), 50000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 50000]), pa.array(roots[k : k + 50000])], ["id", "component"])

    return mapped(edges.repartition(parts), run, "id long, component long")


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (id, component): the smallest id that can be reached from each id that has an edge.

    The edges are dealt to parts of ``PART``, each of which a task contracts to a star to the smallest id. With one part,
    that is the result. Else rounds follow; each rewires edges to smaller ids, keeps their number at most what it was, and
    is cut from its lineage. Nulls and loops are left out; no edges give an empty result. Ends when a round changes
    nothing, which takes about the logarithm of the longest chain of stars.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    parts = -(-edges.count() // PART)
    stars = cut(_contracted(edges, max(1, parts)))
    if parts <= 1:
        return stars
    e = cut(stars.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).distinct())
    state = _state(e)
    for _ in range(MOST_ROUNDS if state[0] else 0):
        both = e.union(e.select("b", "a"))
        least = resplit(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # b is now smaller than a in every edge; the nodes with edges to smaller ones only keep theirs.
        large = large.where("a <> b").distinct()
        smallest = resplit(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = cut(small.where("a <> b").distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("id")).distinct().join(e.select(F.col("a").alias("id")), "id", "left_anti")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
