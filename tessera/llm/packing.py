"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids and an end id; only those of more than ``capacity`` ids are cut, into pieces of ``capacity``,
the first of which takes what is over. Only the histogram of piece lengths (at most ``capacity`` numbers) goes to the
driver. There the configuration LP - as few sequences as possible, so that the multisets of lengths they hold cover the
histogram - is solved by multiplicative weights: each length has a dual weight, pricing finds the multiset of most weight
that fits a sequence by dynamic programming over the capacity (an unbounded knapsack), that configuration covers a small
share, and the weights of lengths that are covered less rise. The fractional solution is rounded down, and the lengths
that are left over are packed by best fit decreasing over their histogram.

The plan is a table of (length, first rank, last rank) to (sequence numbers, slot), of bounded size, and the pieces are
ranked within their length by prefix sums over ranges of the ids' hash, so no length's pieces meet in one task.

Defined cases: null and empty texts are the end id alone; repeated rows and ids are packed as separate documents, their
pieces tied in an arbitrary but complete order; an empty table gives an empty result; the strings of special tokens in a
text become these tokens' ids, as the vocabulary file has it; a text is encoded whole, so a very long one needs memory in
proportion to its ids (some 40 bytes a token) in the one task that encodes it, and none beyond; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mapped

CAPACITY = 1024
END = 2
ROUNDS = 600
ETA = 1.0
#: Share of a length's pieces that one round covers at most.
STEP = 0.05
SCALES = (1.0, 0.97, 0.9, 0.75, 0.5, 0.0)


def vocabulary(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    The vocabulary file is the parameter. Where the same vocabulary also lies beside it as ranks, the faster encoder of the
    tiktoken library reads these, with the special tokens of the vocabulary file (tests/llm hold both encoders together).
    """
    import json
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        made = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        return lambda text: made.encode(text, allowed_special="all", disallowed_special=())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    path = path or vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        encode = encoder(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                start = 0
                for k in range(-(-len(ids) // capacity)):
                    stop = (start or len(ids) - (len(ids) - 1) // capacity * capacity) if not k else start + capacity
                    part = ids[start:stop]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), *[part.astype(np.int32)] * keep_ids))
                    start = stop
                if len(rows) > 20000 or keep_ids and len(rows) > 2000:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)


def price(weights: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of lengths that fits the capacity with the largest sum of weights, as counts by length's place.

    best[c] is the largest weight that fits in c, found for all lengths at once for each c.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        m = int(np.searchsorted(lengths, c, "right"))
        worth = best[c - lengths[:m]] + weights[:m]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-15:
            best[c], choice[c] = worth[k], k
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        k = choice[c]
        if k < 0:
            c -= 1
            continue
        counts[k] += 1
        c -= int(lengths[k])
    return np.minimum(counts, left)


def cover(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Fractional solution of the covering LP by multiplicative weights: configurations and how often each is used.

    The weights are duals of the covering constraints: a length's size, the dual of a perfect packing, times exp(ETA * the
    share of it that isn't covered yet), so what lags is worth more. Each round prices one configuration and uses it for at
    most ``STEP`` of the pieces of any of its lengths (one sequence at least), and for no more than are left. What isn't
    covered after ``rounds`` is left over.
    """
    need = counts.astype(np.float64)
    x: dict[bytes, float] = {}
    served = np.zeros(len(lengths))
    for _ in range(rounds):
        left = np.maximum(need - served, 0)
        live = left > 1e-9 * need
        if not live.any():
            break
        short = left / need
        weight = np.where(live, lengths / capacity * np.exp(ETA * (short - short[live].mean())), 0)
        config = price(weight, lengths, np.ceil(left - 1e-9).astype(np.int64), capacity)
        part = np.flatnonzero(config)
        if not len(part):
            break
        much = min(float((left[part] / config[part]).min()), max(1.0, STEP * float((need[part] / config[part]).min())))
        x[config.tobytes()] = x.get(config.tobytes(), 0) + much
        served += much * config
    return [(np.frombuffer(k, np.int64), n) for k, n in sorted(x.items(), key=lambda kv: -kv[1])]


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit decreasing over a histogram; all pieces of a length that meet the same free room go at once."""
    room: dict[int, dict[tuple, int]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[k]), int(left[k])
        while n:
            fits = [r for r in room if r >= size]
            if fits:
                r = min(fits)
                key, have = next(iter(room[r].items()))
                take = min(n, have)
                room[r][key] -= take
                if not room[r][key]:
                    del room[r][key]
                    if not room[r]:
                        del room[r]
                new, r, used = (*key, k), r - size, take
            else:
                each = min(n, capacity // size)
                take = n // each
                new, r, used = (k,) * each, capacity - size * each, take * each
            room.setdefault(r, {})
            room[r][new] = room[r].get(new, 0) + take
            n -= used
    return [(np.bincount(key, minlength=len(lengths)).astype(np.int64), n) for made in room.values() for key, n in made.items()]


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations (counts by length's place) and how many sequences use each; together they hold each piece once.

    The fractional solution is rounded down after scaling by each of ``SCALES``, what is left over is packed by best fit
    decreasing, and the scale with the fewest sequences counts (the largest of equals). The last scale leaves everything
    to best fit, so the plan never has more sequences than that alone.
    """
    fractional, best = cover(lengths, counts, capacity, rounds), None
    for scale in SCALES:
        left, used = counts.astype(np.int64).copy(), []
        for config, much in fractional:
            part = np.flatnonzero(config)
            whole = min(int(scale * much + 1e-9), int((left[part] // config[part]).min()))
            if whole > 0:
                used.append((config, whole))
                left -= whole * config
        used += best_fit(lengths, left, capacity)
        if best is None or sum(n for _, n in used) < sum(n for _, n in best):
            best = used
    return best


def plan(lengths: np.ndarray, used: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, offset): the pieces of these ranks go one to a sequence."""
    taken, sequence, rows = np.zeros(len(lengths), np.int64), 0, []
    for config, n in used:
        offset = 0
        for k in np.flatnonzero(config)[::-1]:
            for _ in range(int(config[k])):
                rows.append((int(lengths[k]), int(taken[k]), int(n), sequence, offset))
                taken[k] += n
                offset += int(lengths[k])
        sequence += n
    return rows


def ranked(rows: DataFrame, value: str, name: str, key: list[str]) -> DataFrame:
    """Rows with ``name``: a rank from 0 within equal ``value``, by ranges of a hash of ``key`` that are counted first."""
    names = rows.columns
    rows = rows.withColumn("_range", F.pmod(F.xxhash64(*key), F.lit(4096)).cast("int"))
    sums = rows.groupBy(value, "_range").count()
    before = Window.partitionBy(value).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(value, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(value, "_range").orderBy(*key)
    rows = rows.join(sums, [value, "_range"])
    return rows.select(*names, (F.col("_before") + F.row_number().over(inside) - 1).alias(name))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (and ids, if they are kept)."""
    cutting = cut(pieces(docs, capacity, path, end, keep_ids))
    histogram = sorted((r[0], r[1]) for r in cutting.groupBy("length").count().collect())
    lengths, counts = np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64)
    used = solve(lengths, counts, capacity) if histogram else []
    return place(cutting, plan(lengths, used))


def place(cutting: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Give every piece the place that the plan has for its rank within its length."""
    spark: SparkSession = cutting.sparkSession
    by_length: dict[int, list[tuple]] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(rest)
    tables = {n: np.array(sorted(x), np.int64) for n, x in by_length.items()}
    share = spark.sparkContext.broadcast(tables)  # bounded by the configurations' slots, whatever the number of pieces

    def run(batches):
        tables = share.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                t = tables[int(length[part[0]])]
                at = np.searchsorted(t[:, 0], rank[part], "right") - 1
                sequence[part] = t[at, 2] + rank[part] - t[at, 0]
                offset[part] = t[at, 3]
            keep = [i for i, c in enumerate(b.schema.names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(sequence), pa.array(offset)], [*[b.schema.names[i] for i in keep], "sequence_id", "offset"])

    schema = cutting.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return mapped(ranked(cutting, "length", "_rank", ["doc_id", "piece", "ids_crc32"]), run, schema)
