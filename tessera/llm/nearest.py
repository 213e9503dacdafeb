"""Nearest neighbours by largest inner product: query-aware collision counting.

Vectors get one more component, so that all have the largest norm: then the largest inner products are the smallest
distances. Each of ``PROJECTIONS`` random directions has an array of a block's vectors, sorted by their projections. A
query opens a window around its own projection in each; vectors that are in the window of at least ``SHARE`` of the
directions collide often enough, and all of them are verified by their inner products. Virtual rehashing widens the windows
in steps of ``STEP`` until the query has k verified vectors within the radius of the windows, or the windows hold everything.

Vectors are dealt to blocks of about ``BLOCK`` by a hash of their id, so equal vectors spread; a block's arrays are built once
and all queries are streamed through it in batches. A query sends one row of its k best from each block to the merge.

Scores are recomputed in double precision, summed in the same order for every vector, for the k best and all that are as
close as rounding can tell, so equal vectors have equal scores and ties go to smaller ids.

Defined cases: vectors that are null, of another length than most, zero, or hold nulls or values that aren't finite take no
part; of several rows of one id the smallest vector asks, and rows with a query's id are none of its candidates; an empty
table, or no candidates, give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped

PROJECTIONS = 48
SHARE = 0.68
#: Half a window, in units of the radius; a vector at the radius is in it with a probability of 0.77.
HALF = 1.2
STEP = 1.15
FIRST = 0.3
BLOCK = 16384


class Index:
    """The sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, projections: int = PROJECTIONS, seed: int = 11):
        self.ids, self.vectors, self.largest = ids, vectors, largest
        self.norms = (vectors * vectors).sum(1)
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(vectors.shape[1] + 1, projections))
        lift = np.sqrt(np.maximum(largest * largest - self.norms, 0))
        projected = vectors @ self.directions[:-1] + lift[:, None] * self.directions[-1]
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, self.order.T, 0).T)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        m, n = self.sorted.shape
        scale = self.largest / np.maximum(np.sqrt((queries * queries).sum(1)), 1e-300)
        projected = queries * scale[:, None] @ self.directions[:-1]
        need = int(np.ceil(SHARE * m))
        # Places of each query's projections at each radius, all queries at once; computed as levels are asked for.
        levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def places(level: int) -> tuple[np.ndarray, np.ndarray]:
            if level not in levels:
                half = HALF * self.largest * FIRST * STEP**level
                lo = np.stack([np.searchsorted(self.sorted[j], projected[:, j] - half, "left") for j in range(m)], 1)
                hi = np.stack([np.searchsorted(self.sorted[j], projected[:, j] + half, "right") for j in range(m)], 1)
                levels[level] = lo, hi
            return levels[level]

        last = int(np.ceil(np.log(2 * 40 / FIRST) / np.log(STEP)))  # windows that hold everything
        out = []
        first = self._first_levels(places, need, k, last)
        for q in range(len(queries)):
            inner = np.empty(0)
            level, old = int(first[q]), None
            counts = np.zeros(n, np.int64)
            others = self.ids != query_ids[q]
            enough = min(k, int(others.sum()))
            seen = np.zeros(n, bool)
            seen[~others] = True
            found = np.empty(0, np.int64)
            while len(found) < n:
                lo, hi = places(level)
                if old is None:
                    parts = [self.order[j, lo[q, j] : hi[q, j]] for j in range(m)]
                else:
                    parts = [self.order[j, a:b] for j in range(m) for a, b in ((lo[q, j], old[0][j]), (old[1][j], hi[q, j])) if a < b]
                old = lo[q], hi[q]
                if parts:
                    counts += np.bincount(np.concatenate(parts), minlength=n)
                new = np.flatnonzero((counts >= need) & ~seen)
                if len(new):
                    seen[new] = True
                    found = np.concatenate([found, new])
                    inner = np.concatenate([inner, self.vectors[new] @ queries[q]])
                radius = self.largest * FIRST * STEP**level
                if len(found) >= enough and (not enough or len(found) == others.sum() or level >= last):
                    break
                if len(found) >= enough:
                    kth = np.partition(inner, len(inner) - enough)[len(inner) - enough]
                    if 2 * self.largest**2 - 2 * scale[q] * kth <= radius * radius:
                        break
                level += 1
            out.append(self._best(queries[q], found, inner, k))
        return out

    def _first_levels(self, places, need: int, k: int, last: int) -> np.ndarray:
        """For each query the first level at which its windows can give k vectors enough collisions; a function of the query
        and the block alone, whatever queries come with it."""
        lo, hi = places(0)
        out, open_ = np.full(len(lo), last), np.ones(len(lo), bool)
        for level in range(last):
            lo, hi = places(level)
            reached = open_ & ((hi - lo).sum(1) >= need * min(k, self.sorted.shape[1]))
            out[reached] = level
            open_ &= ~reached
            if not open_.any():
                break
        return out

    def _best(self, query: np.ndarray, found: np.ndarray, inner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(found) > k:
            least = np.partition(inner, len(inner) - k)[len(inner) - k]
            close = inner >= least - 1e-9 * self.largest * max(1e-300, float(np.sqrt((query * query).sum())))
            found = found[close]
        score = (self.vectors[found] * query).sum(1)
        order = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found[order]], score[order]


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    v = b.column("vector")
    return b.column("vec_id").to_numpy(), v.flatten().to_numpy().reshape(len(v), -1).astype(np.float64)


PARTIAL = "query_id long, ids array<long>, scores array<double>"
RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of every query (a condition on vec_id)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.withColumn("square", square).where("square > 0")
    kinds = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max("square").alias("s")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not kinds:
        return vectors.sparkSession.createDataFrame([], RESULT)
    d, n, largest = kinds[0]
    largest = float(np.sqrt(largest))
    blocks = max(1, -(-n // block))
    rows = rows.where(F.size("vector") == d).select("vec_id", "vector")
    candidates = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), "vec_id", "vector")
    asking = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asking = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), "vec_id", "vector")
    dealt = candidates.union(asking).repartition("block").sortWithinPartitions("block", "role", "vec_id")

    def search(batches):
        held, index, last = [], None, None
        for b in batches:
            key = b.column("block").to_numpy().astype(np.int64) * 2 + b.column("role").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                part, own, role = b.slice(i, j - i), key[i] // 2, key[i] % 2
                if own != last:
                    held, index, last = [], None, own
                if role == 0:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    ids, v = zip(*map(_arrays, held), strict=True)
                    index, held = Index(np.concatenate(ids), np.concatenate(v), largest), []
                ids, v = _arrays(part)
                for at in range(0, len(ids), 256):
                    found = index.search(ids[at : at + 256], v[at : at + 256], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at : at + 256]), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))],
                        ["query_id", "ids", "scores"],
                    )

    parts = mapped(dealt, search, PARTIAL).repartition("query_id").sortWithinPartitions("query_id")

    def merge(batches):
        last, ids, scores = None, np.empty(0, np.int64), np.empty(0)

        def rows_of():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), last)), pa.array(np.arange(1, len(ids) + 1, dtype=np.int32)), pa.array(ids), pa.array(scores)], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for q, i, s in zip(b.column("query_id").to_pylist(), b.column("ids"), b.column("scores"), strict=True):
                if q != last:
                    if len(ids):
                        yield rows_of()
                    last, ids, scores = q, np.empty(0, np.int64), np.empty(0)
                ids = np.concatenate([ids, i.values.to_numpy()])
                scores = np.concatenate([scores, s.values.to_numpy()])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
        if len(ids):
            yield rows_of()

    return mapped(parts, merge, RESULT)
