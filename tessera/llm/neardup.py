"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification, connected components.

1. Every text becomes its set of word shingles (64-bit hashes), a signature of ``HASHES`` minima, and band keys. Texts with
   equal sets are one class, of which the smallest id stands for all.
2. Classes that share a band key are candidates. In each bucket their signatures (a byte of each minimum) are compared in
   batches of ``BATCH``: with a uniform prior on the similarity, a pair is dropped as soon as the posterior probability that
   it reaches the threshold is under ``MISS``. The pairs that survive group the classes (a spanning forest for each bucket,
   so that no bucket gives more rows than it has members).
3. The texts of each group meet, are pruned likewise by whole signatures, and what survives is verified on the full sets.
   Pairs that are already connected need no further look. A group gives a forest of verified links.

The number of rows of a band is the largest for which a pair at the threshold misses all bands with a probability of at
most ``MISS_BANDS``. Buckets and groups over ``BLOCK`` members (or ``BLOCK_BYTES`` of text) are split by a hash into blocks,
so that no task holds an unbounded group. First the pairs inside the blocks are looked at; then ``REPS`` members of each
component that these links made, across the blocks; and only where a group is still in several components, its members
outside its largest one meet all of its blocks. So a group of copies of one text moves about once, whatever its size.
Nothing is capped: every candidate pair is in one component already, pruned by its posterior, or verified.

Defined cases: null texts and texts without words have no set and are linked with nothing; texts of fewer words than a
shingle have their whole sequence as the one shingle; rows of one id count as one node; rows without id are linked with
nothing and have a null component; an empty table gives an empty result; other columns are passed on by ``deduplicated``
and ignored by ``near_duplicates``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_small, doc_slices, mapped, mix, resplit, text_buffers, word_hashes
from .graph import components

HASHES = 128
BATCH = 16
MISS_BANDS = 1e-6
MISS = 1e-7
BLOCK = 1024
BLOCK_BYTES = 16 << 20
REPS = 8

_rng = np.random.Generator(np.random.PCG64(77))
_TIMES = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_ODD = _rng.integers(0, 1 << 62, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rows_per_band(threshold: float) -> int:
    return max(r for r in range(1, HASHES + 1) if r == 1 or (1 - threshold**r) ** (HASHES // r) <= MISS_BANDS)


@lru_cache
def least_matches(threshold: float, alphabet: int = 256) -> tuple[int, ...]:
    """For each number of batches compared, the fewest matches with which a pair may still be similar enough.

    Posterior of the similarity s after m matches of n, with a uniform prior; minima that differ match with 1/alphabet.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / alphabet
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-np.minimum(p, 1 - 1e-12))
            w = np.exp(log - log.max())
            if w[s >= threshold].sum() / w.sum() >= MISS:
                break
        out.append(m)
    return tuple(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    h, bounds = word_hashes(data, offsets)
    n = len(h) - size + 1
    rolled = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        rolled += h[k : k + n] * _ODD[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _ODD[size : size + b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def all_sets(column: pa.Array, size: int):
    data, offsets = text_buffers(column)
    for i, j in doc_slices(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)


def signature(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, ((x[k : k + 4096] ^ _XOR[:, None]) * _TIMES[:, None]).min(1), out=out)
    return out


def small(sig: np.ndarray) -> np.ndarray:
    """A byte of each minimum, by a hash of it (the minima's own high bits are all low)."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


SKETCH = "id long, n_shingles long, h1 long, h2 long, small binary, bands array<long>, w long"


def sketches(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    rows = rows_per_band(threshold)
    bands = HASHES // rows

    def run(batches):
        for b in batches:
            n, h1, h2, smalls, keys = [], [], [], [], []
            for s in all_sets(b.column("text"), size):
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mix(s * _ODD[0]).sum(dtype=np.uint64).astype(np.int64)))
                if len(s):
                    sig = signature(s)
                    smalls.append(small(sig).tobytes())
                    per = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
                    keys.append(mix((per * _ODD[:rows]).sum(1) + np.arange(bands, dtype=np.uint64) * _ODD[31]).view(np.int64))
                else:
                    smalls.append(b"")
                    keys.append(np.zeros(0, np.int64))
            columns = [b.column("id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(smalls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.diff(text_buffers(b.column("text"))[1]))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SKETCH.split(", ")])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), run, SKETCH)


def _in_blocks(members: DataFrame, bytes_: int) -> DataFrame:
    """Members (grp, id, w) of groups of two or more with the number of their group's blocks and their own block."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("w").alias("w")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / bytes_))
    sizes = sizes.select("grp", F.least(blocks, "n").cast("int").alias("blocks"))
    return members.join(resplit(sizes), "grp").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with the component that the links found so far put them in."""
    return cut_small(members.join(components(found).select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id")))


def links(members: DataFrame, payload: DataFrame, compare, bytes_: int = BLOCK_BYTES) -> DataFrame:
    """Links that connect, inside each group of ``members`` (grp, id, w), all that ``compare`` links by any pairs.

    compare: rows (task, side, label, id, and the columns of ``payload``, by id) to links between rows of different labels
    of a task, of different sides if it has two.
    """
    row = ["task", "side", "label", "id"]
    members = _in_blocks(members, bytes_)
    zero, same = F.lit(0).alias("side"), F.col("id").alias("label")
    found = cut_small(compare(members.select(F.xxhash64("grp", "block").alias("task"), zero, same, "id").join(payload, "id")))
    big = cut_small(members.where("blocks > 1"))
    if big.isEmpty():
        return found
    labelled = _labelled(big, found)
    picks = [F.min(F.struct(F.xxhash64("id", F.lit(100 + k)), "id", "w")).alias(f"p{k}") for k in range(REPS)]
    reps = labelled.groupBy("grp", "label").agg(*picks).select("grp", F.explode(F.array_distinct(F.array(*[F.struct("label", f"p{k}.id", f"p{k}.w") for k in range(REPS)]))).alias("r"))
    reps = _in_blocks(reps.select("grp", "r.*"), bytes_)
    more = cut_small(compare(reps.select(F.xxhash64("grp", "block").alias("task"), zero, "label", "id").join(payload, "id")))
    found = found.union(more)
    labelled = _labelled(big, found)
    kinds = labelled.groupBy("grp", "label").agg(F.count("*").alias("n"))
    main = kinds.groupBy("grp").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("grp", "main")
    apart = cut_small(labelled.join(resplit(main), "grp").withColumn("stray", F.col("label") != F.col("main")))
    chunks = apart.where("stray").groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("w") / bytes_)).cast("int").alias("chunks"))
    if chunks.isEmpty():
        return found
    apart = apart.join(resplit(chunks), "grp")
    every = apart.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", zero)
    strays = apart.where("stray").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(11)), F.col("chunks")).cast("int"))
    strays = strays.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    last = every.unionByName(strays).select(F.xxhash64("grp", "block", "chunk").alias("task"), *row[1:])
    return found.union(cut_small(compare(last.join(payload, "id"))))


def _tasks(batches, key: str = "task"):
    """Tables of the rows of each key, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and k[i] != last:
                yield held
                held = []
            held.append(b.slice(i, j - i))
            last = k[i]
    if held:
        yield held


class Forest:
    """Union-find over the members of one task."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
            self.links.append((i, j))


def survivors(sig: np.ndarray, i: int, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which of the others the batches of signatures don't rule out."""
    matches = np.zeros(len(others), np.int64)
    for k, m in enumerate(least):
        at = slice(k * BATCH, (k + 1) * BATCH)
        matches += (sig[others, at] == sig[i, at]).sum(1)
        keep = matches >= m
        others, matches = others[keep], matches[keep]
        if not len(others):
            break
    return others


def _compare(sig: np.ndarray, sides: np.ndarray, label: np.ndarray, least: tuple[int, ...], verify=None) -> Forest:
    """A forest of the pairs of a task that survive and (if there is one) that ``verify`` confirms."""
    forest = Forest(label)
    order = np.arange(len(sig))
    two = bool(sides.any())
    other_side = order[sides == 1]
    for i in order[sides == 0]:
        others = other_side if two else order[i + 1 :]
        others = others[forest.label[others] != forest.label[i]]
        for j in survivors(sig, i, others, least) if len(others) else ():
            if forest.label[i] != forest.label[j] and (verify is None or verify(i, j)):
                forest.join(i, int(j))
    return forest


EDGES = "a long, b long"


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _each_task(rows: DataFrame, look) -> DataFrame:
    """The links that ``look`` (batches of a task, ids, sides, labels to a Forest) finds in each task."""

    def run(batches):
        out = []
        for held in _tasks(batches):
            ids, sides, label = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "side", "label"))
            if len(ids) < 2:
                continue
            out += [(int(ids[i]), int(ids[j])) for i, j in look(held, sides, label).links]
            if len(out) > 20000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return mapped(rows.repartition("task").sortWithinPartitions("task", "id"), run, EDGES)


def candidate_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Links that connect all members of each bucket whose pairs the posterior doesn't rule out."""
    least = least_matches(threshold)

    def look(held, sides, label):
        sig = np.frombuffer(b"".join(x for b in held for x in b.column("small").to_pylist()), np.uint8).reshape(len(sides), HASHES)
        return _compare(sig, sides, label, least)

    members = classes.select(F.explode("bands").alias("grp"), "id", F.lit(HASHES).alias("w"))
    return links(members, classes.select("id", "small"), lambda rows: _each_task(rows, look))


def verified_edges(members: DataFrame, texts: DataFrame, size: int, threshold: float, percent: tuple[int, int] | None = None) -> DataFrame:
    """Links that connect all of each group's (grp, id, w) pairs verified on full sets: |A and B| * den >= |A or B| * num."""
    num, den = percent or (round(threshold * 1000), 1000)
    least = least_matches(threshold, 1 << 32)

    def look(held, sides, label):
        sets = [s for b in held for s in all_sets(b.column("text"), size)]

        def verify(i, j):
            x, y = sets[i], sets[j]
            if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                return False
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            return den * common >= num * (len(x) + len(y) - common)

        return _compare(np.stack([signature(s) for s in sets]), sides, label, least, verify)

    return links(members, texts, lambda rows: _each_task(rows, look))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, percent: tuple[int, int] | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links lead to), kept (it is its component's id)."""
    every = cut(sketches(docs, size, threshold))
    full = every.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("h1", "h2").agg(F.min(F.struct("id", "w", "small", "bands")).alias("r"))
    classes = cut(classes.select("h1", "h2", "r.id", "r.w", "r.small", "r.bands"))
    groups = components(candidate_edges(classes, threshold))
    groups = cut(groups.join(classes.select("id", "w"), "id").groupBy("id").agg(F.max("component").alias("grp"), F.max("w").alias("w")))
    verified = verified_edges(groups, docs.select(F.col("doc_id").cast("long").alias("id"), "text"), size, threshold, percent)
    # Rows of one id are one node: their classes meet in it.
    own = full.select("h1", "h2", "id").join(classes.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"]).select("id", "rep").distinct()
    again = own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    merged = own.join(again, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(verified.union(merged)).select(F.col("id").alias("rep"), "component")
    by_class = classes.select("h1", "h2", F.col("id").alias("rep")).join(found, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = every.join(by_class, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are kept: one of each component, that of its id. Rows without id are all kept.

    Of several rows with a kept id, that with the first text by code points stays.
    """
    names = docs.columns
    gone = near_duplicates(docs, size, threshold).where("not kept").select("doc_id").distinct()
    stay = docs.join(gone, "doc_id", "left_anti").select(*names)
    again = cut_small(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"))
    if again.isEmpty():
        return stay
    single = stay.join(again, "doc_id", "left_anti").select(*names)
    first = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text"))
    several = stay.join(again, "doc_id", "left_semi").select(F.struct(*names).alias("row"), "doc_id", "text")
    several = several.withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*").select(*names)
    return single.union(several)
