"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct 32-bit hashes of its words (A-Z lower-cased, without the ASCII punctuation at
their ends), of the stems of longer words (their first ``STEMS`` bytes, so that inflected forms share a feature), of its pairs of
neighbours and of its pairs with one or two words between. Training follows the published
FTRL-proximal update (per-coordinate rates, L1 and L2) over a bounded sample: about ``2 * SAMPLE`` labelled documents,
at one rate for both labels, chosen by a hash of the id, and fewer where these have more than ``FEATURES`` features
together; whole texts, hashed on the executors. Features of fewer than ``LEAST`` sampled
documents are left out. The L1 term leaves few weights that aren't zero; they are sorted by hash and broadcast with the
scoring function, which looks up every feature of every whole text, in slices of bounded size.

Defined cases: null and empty texts have no features and get the score of the bias; without labelled rows all scores are
next to 0 and nothing is predicted; one label only gives its smoothed prior; repeated rows are scored alike; labels of
repeated ids count once (the largest); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, SLICE, SpanHash, cut, doc_slices, mapped, mix, text_buffers, word_pieces, words

SAMPLE = 4000
#: Features of the sampled documents together, at most.
FEATURES = 1 << 25
LEAST = 3
SKIPS = (1, 2, 3)
STEMS = (5, 6, 7)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 5.0, 1.0
EPOCHS = 4

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SEPARATE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass
class Model:
    features: np.ndarray  # sorted 32-bit hashes
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features of a slice of texts and the row of each; not distinct."""
    hashes, stems, stem_rows, bounds, before = [], [], [], None, 0
    for piece, own in word_pieces(data, offsets):
        piece = _FOLD[piece]
        starts, ends, bounds = words(piece, own)
        for _ in range(2):  # a word of punctuation alone stays as it is
            starts = starts + (_PUNCTUATION[piece[starts]] & (ends - starts > 1))
            ends = ends - (_PUNCTUATION[piece[ends - 1]] & (ends - starts > 1))
        span = SpanHash(piece)
        hashes.append(span(starts, ends))
        own_row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for size in STEMS:
            longer = ends - starts > size
            stems.append(mix(span(starts[longer], starts[longer] + size) + np.uint64(size)))
            stem_rows.append(own_row[longer])
        before += 1
    h = np.concatenate(hashes)
    bounds = bounds if before == 1 else np.array([0, len(h)])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found, rows = [h, *stems], [row, *stem_rows]
    for gap, salt in zip(SKIPS, _SEPARATE, strict=True):
        same = row[gap:] == row[:-gap]
        found.append(mix(h[:-gap][same] * salt + h[gap:][same]))
        rows.append(row[gap:][same])
    return (np.concatenate(found) >> np.uint64(32)).astype(np.uint32), np.concatenate(rows)


def distinct(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    out = []
    for i, j in doc_slices(offsets):
        f, row = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        both = np.unique(row.astype(np.uint64) << np.uint64(32) | f)
        cuts = np.searchsorted(both >> np.uint64(32), np.arange(1, j - i))
        out += np.split((both & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", usable: Column | None = None, sample: int = SAMPLE, seed: int = 1) -> Model:
    """Fit on a bounded sample of the ``docs`` that ``labels`` has by doc_id and that are ``usable``."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.where(usable) if usable is not None else marks
    marks = marks.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in marks.groupBy("y").count().collect()}
    if not sizes:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -np.inf)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # One rate for both labels: scores keep the labels' true shares whatever the size of the tables.
    picked = marks.where(draw < min(1.0, 2 * sample / sum(sizes.values()))).select("doc_id", "y", draw.alias("draw"))
    # The sample has about 2 * SAMPLE rows whatever the size of the tables: that bounds the broadcast.
    rows = docs.select("doc_id", F.col(text).alias("x")).join(F.broadcast(picked), "doc_id").select("x", "y", "draw")

    def hashed(batches):
        for b in batches:
            got = distinct(*text_buffers(b.column("x")))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("draw"), pa.array([g.view(np.int32) for g in got], pa.list_(pa.int32()))], ["y", "draw", "f"])

    found = cut(mapped(rows, hashed, "y int, draw double, f array<int>"))
    # The sample ends where its features reach ``FEATURES``, whatever the texts' lengths: that bounds what comes to the driver.
    sizes = found.select("draw", F.size("f").alias("n")).orderBy("draw", "n").toArrow()
    within = np.cumsum(sizes["n"].to_numpy(), dtype=np.int64) <= FEATURES
    last = sizes["draw"].to_numpy()[within][-1] if within.any() else -1.0
    if not within.all():
        found = found.where(F.col("draw") <= float(last))
    got = found.toArrow().combine_chunks()
    order = np.lexsort((got["y"].to_numpy(), got["draw"].to_numpy()))
    f = got["f"].combine_chunks()
    ends = f.offsets.to_numpy().astype(np.int64)
    model = fit(f.values.to_numpy().view(np.uint32), ends[:-1][order], ends[1:][order], got["y"].to_numpy()[order])
    del got, f
    pa.default_memory_pool().release_unused()  # the driver keeps the model only
    return model


def fit(f: np.ndarray, starts: np.ndarray, ends: np.ndarray, y: np.ndarray) -> Model:
    """FTRL-proximal over rows in order: f[starts[i]:ends[i]] are the distinct features of row i."""
    # Rare features go by an upper bound of their counts first, so that the exact step holds few of the sample's hashes.
    least = min(LEAST, len(y))
    rough = np.zeros(1 << 22, np.int32)
    for part in np.array_split(f, 1 + len(f) // (1 << 20)):
        rough += np.bincount(part & np.uint32(len(rough) - 1), minlength=len(rough)).astype(np.int32)
    kept = np.concatenate([np.zeros(0, bool), *[rough[part & np.uint32(len(rough) - 1)] >= least for part in np.array_split(f, 1 + len(f) // (1 << 20))]])
    moved = np.concatenate([[0], np.cumsum(kept)])
    starts, ends = moved[starts], moved[ends]
    f = f[kept]
    del rough, kept, moved
    names, counts = np.unique(f, return_counts=True)
    names = names[counts >= least]
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)  # the last is the bias, without L1
    l1 = np.full(len(names) + 1, L1)
    l1[-1] = 0

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1[at], 0.0, -(zs - np.sign(zs) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rows = []
    for i in range(len(y)):
        own = f[starts[i] : ends[i]]
        at = np.minimum(np.searchsorted(names, own), max(0, len(names) - 1))
        rows.append(np.append(at[names[at] == own] if len(names) else at[:0], len(names)).astype(np.int32))
    del f
    for _ in range(EPOCHS):
        for at, mark in zip(rows, y, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - mark
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(len(names) + 1))
    keep = np.flatnonzero(w[:-1])
    return Model(names[keep], w[keep], float(w[-1]))


def score_batch(column: pa.Array, model: Model) -> np.ndarray:
    data, offsets = text_buffers(column)
    out = np.full(len(offsets) - 1, model.bias)
    maybe = np.zeros(1 << 16, bool)
    maybe[model.features & np.uint32(0xFFFF)] = True
    for i, j in doc_slices(offsets, SLICE // 2):
        if not len(model.features):
            break
        f, row = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hit = maybe[f & np.uint32(0xFFFF)]
        f, row = f[hit], row[hit]
        at = np.minimum(np.searchsorted(model.features, f), len(model.features) - 1)
        hit = model.features[at] == f
        both = np.unique(row[hit].astype(np.uint64) << np.uint64(32) | at[hit].astype(np.uint64))
        out[i:j] += np.bincount((both >> np.uint64(32)).astype(np.int64), model.weights[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)], j - i)
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The columns of ``docs`` (without the text, if not ``keep_text``), score and predicted, replacing those of these names."""
    docs = docs.drop("score", "predicted")
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).drop(*[] if keep_text else [text]).schema

    def run(batches):
        for b in batches:
            p = score_batch(b.column(text), model)
            keep = [i for i, c in enumerate(b.schema.names) if keep_text or c != text]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*[b.schema.names[i] for i in keep], "score", "predicted"])

    return mapped(docs, run, schema)
