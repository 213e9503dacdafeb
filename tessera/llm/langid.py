"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

Subwords are the byte n-grams (lengths ``NGRAMS``) of the text's UTF-8 bytes, with A-Z lower-cased and white space and
ASCII punctuation and digits folded to one boundary byte; each is hashed to one of ``BUCKETS`` rows of an embedding
table. A document is the average of its subwords' embeddings; a linear softmax over it gives the languages. Both layers
are trained by mini-batch stochastic gradient descent in numpy on the driver.

Training is bounded: about ``SAMPLE`` labelled documents of each language (of which a table may have ``LANGUAGES`` at most), chosen by a hash of the id, each as the
counts of its hashed subwords over the whole text, so the driver gets at most ``SAMPLE * languages * BUCKETS`` counts,
however long the texts are. A quarter of the sample is held back from training for calibration: one temperature is fitted
on it, and rejection is fitted to it: a text is rejected if the calibrated probability of its best language is under the
``REJECT`` quantile of the probabilities that held-back documents have for their true language (never over 1/2).

Scoring folds the two layers into one table of language scores per bucket, broadcast with the function (BUCKETS *
languages floats); it runs over the whole text in slices of bounded size.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and are rejected; no labelled rows give
``und`` for all; one language only gives that language with score 1; an empty table gives an empty result; ties go to the
first language by name; repeated rows are scored alike; other columns are passed on or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, fold, mapped, text_buffers

#: Documents of each language that training and calibration take, about.
SAMPLE = 800
LANGUAGES = 400
BUCKETS = 1 << 15
NGRAMS = (2, 3, 4)
DIM = 16
EPOCHS = 6
RATE = 4.0
BATCH = 32
REJECT = 0.0005
UNDETERMINED = "und"

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[65:91] += 32
_CLASS[:65] = 32
_CLASS[[91, 92, 93, 94, 95, 96, 123, 124, 125, 126, 127]] = 32


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: scores of each subword, before the temperature
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(data: np.ndarray, lo: int, hi: int, doc_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start in data[lo:hi], and a mask of those inside their document (n-gram by row)."""
    longest = max(NGRAMS)
    codes = np.full(hi - lo + longest, 32, np.uint32)
    seen = data[lo : min(len(data), hi + longest)]
    codes[: len(seen)] = _CLASS[seen]
    n, left = hi - lo, doc_end - np.arange(lo, hi)
    h = np.zeros(n, np.uint32)
    out, inside = np.empty((len(NGRAMS), n), np.uint32), np.empty((len(NGRAMS), n), bool)
    k = 0
    for size in range(1, longest + 1):
        h = (h ^ codes[size - 1 : size - 1 + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if size in NGRAMS:
            out[k] = ((h * np.uint32(0x85EBCA77)) >> np.uint32(7)) & np.uint32(BUCKETS - 1)
            inside[k] = left >= size
            k += 1
    return out, inside


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int):
    """Slices of the bytes with, for each, the ends of the bytes' documents and the rows it starts and ends in."""
    for lo in range(0, len(data), limit):
        hi = min(len(data), lo + limit)
        first = int(np.searchsorted(offsets, lo, "right")) - 1
        last = int(np.searchsorted(offsets, hi, "left"))
        bounds = np.clip(offsets[first : last + 1], lo, hi)
        yield lo, hi, first, last, bounds


def _counts(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    data, offsets = text_buffers(column)
    buckets, counts = [], []
    for i in range(len(offsets) - 1):
        total = np.zeros(BUCKETS, np.int64)
        a, b = offsets[i], offsets[i + 1]
        for lo in range(a, b, SLICE // 4):
            hi = min(b, lo + SLICE // 4)
            got, inside = subwords(data[:b], lo, hi, np.full(hi - lo, b))
            total += np.bincount(got[inside], minlength=BUCKETS)
        at = np.flatnonzero(total)
        buckets.append(at.astype(np.int16))
        counts.append((total[at] / max(1, total.sum())).astype(np.float32))
    return buckets, counts


def train(docs: DataFrame, text: str = "text", label: str = "lang", usable: Column | None = None, sample: int = SAMPLE, seed: int = 1) -> Model:
    """Fit on a bounded sample of the rows of ``docs`` with a label and ``usable``."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().limit(LANGUAGES + 1).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{len(sizes)} languages; the bound of the sample is {LANGUAGES}")
    names = sorted(sizes)
    chance = F.coalesce(*[F.when(F.col(label) == x, F.lit(min(1.0, sample / sizes[x]))) for x in names])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw < chance).select(F.col(label).alias("y"), draw.alias("draw"), F.col(text).alias("x"))

    def features(batches):
        for b in batches:
            buckets, counts = _counts(b.column("x"))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("draw"), pa.array(buckets, pa.list_(pa.int16())), pa.array(counts, pa.list_(pa.float32()))], ["y", "draw", "at", "c"])

    got = mapped(picked, features, "y string, draw double, at array<smallint>, c array<float>").toArrow().combine_chunks()
    y = np.array([names.index(y) for y in got["y"].to_pylist()], np.int64)
    order = np.lexsort((y, got["draw"].to_numpy()))
    at, c = got["at"].combine_chunks(), got["c"].combine_chunks()
    ends = at.offsets.to_numpy().astype(np.int64)
    model = fit(at.values.to_numpy(), c.values.to_numpy(), ends[:-1][order], ends[1:][order], y[order], names, seed)
    del got, at, c
    pa.default_memory_pool().release_unused()  # the driver keeps the model only
    return model


def fit(at: np.ndarray, weight: np.ndarray, starts: np.ndarray, ends: np.ndarray, y: np.ndarray, names: list[str], seed: int = 1) -> Model:
    """Train on rows of averaged subword counts: at/weight[starts[i]:ends[i]] are row i's buckets and their shares."""
    rng = np.random.default_rng(seed)
    n, k = len(y), len(names)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, k)).astype(np.float32)
    b = np.zeros(k, np.float32)
    held = np.arange(n) % 4 == 3
    fitted = np.flatnonzero(~held) if n >= 8 else np.arange(n)
    steps, total = 0, max(1, EPOCHS * -(-len(fitted) // BATCH))
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(fitted), max(1, -(-len(fitted) // BATCH))):
            share = np.zeros((len(part), BUCKETS), np.float32)
            for r, i in enumerate(part):
                share[r, at[starts[i] : ends[i]]] = weight[starts[i] : ends[i]]
            h = share @ emb
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            rate = RATE * (1 - steps / total) / len(part)
            back = p @ w.T
            w -= rate * (h.T @ p)
            b -= rate * p.sum(0)
            # A bucket's share of a text is small, so its row moves by a rate that is larger by the usual share.
            emb -= rate * 20 * (share.T @ back)
            steps += 1
    table = (emb @ w).astype(np.float32)
    check = np.flatnonzero(held) if n >= 8 else np.arange(n)
    z = np.stack([(table[at[starts[i] : ends[i]]] * weight[starts[i] : ends[i], None]).sum(0) + b for i in check])
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 4, 60):
        # Laplace's rule for the rate of wrong labels keeps a faultless sample from making all scores 1.
        p, slip = np.log(np.maximum(_softmax(z / t), 1e-12)), 1 / (len(check) + 2)
        loss = -((1 - slip) * p[np.arange(len(check)), y[check]] + slip * p.mean(1)).mean()
        if loss < best - 1e-9:
            best, temperature = loss, float(t)
    true = _softmax(z / temperature)[np.arange(len(check)), y[check]]
    return Model(names, table, b.astype(np.float64), temperature, float(min(0.5, np.quantile(true, REJECT))))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def score_batch(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Best language (its number) and its calibrated probability for each text."""
    data, offsets = text_buffers(column)
    n, k = len(offsets) - 1, len(model.languages)
    sums, counts = np.zeros((n, k)), np.zeros(n)
    row_end = None
    for lo, hi, first, last, bounds in _pieces(data, offsets, SLICE // 2):
        row_end = np.repeat(offsets[first + 1 : last + 1], np.diff(bounds))
        got, inside = subwords(data, lo, hi, row_end)
        full = np.flatnonzero(np.diff(bounds))
        cuts = bounds[full] - lo
        for g, ok in zip(got, inside, strict=True):
            s = model.table[g]
            s[~ok] = 0
            sums[first + full] += np.add.reduceat(s, cuts, axis=0)
            counts[first + full] += np.add.reduceat(ok.astype(np.int64), cuts)
    p = _softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature) if k else np.zeros((n, 1))
    best = p.argmax(1)
    return best, p[np.arange(n), best]


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The columns of ``docs`` (without the text, if not ``keep_text``), and lang_pred, score and rejected.

    Columns of these three names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected", "_letters")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).drop(*[] if keep_text else [text]).schema

    def predict(batches):
        for b in batches:
            ok = b.column("_letters").to_numpy(zero_copy_only=False)
            names = np.array([*model.languages, UNDETERMINED], dtype=object)
            if model.languages:
                best, p = score_batch(b.column(text), model)
                best, p = np.where(ok, best, len(model.languages)), np.where(ok, p, 0.0)
            else:
                best, p = np.zeros(len(ok), int), np.zeros(len(ok))
            keep = [i for i, c in enumerate(b.schema.names) if c != "_letters" and (keep_text or c != text)]
            add = [pa.array(names[best].tolist(), pa.string()), pa.array(p, pa.float64()), pa.array((p < model.threshold) | (best == len(model.languages)))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *add], [*[b.schema.names[i] for i in keep], "lang_pred", "score", "rejected"])

    return mapped(docs.withColumn("_letters", letters), predict, schema)


def not_held_out() -> Column:
    return fold(F.col("doc_id")) != 0
