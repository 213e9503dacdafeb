"""Document fingerprints from prefix polynomial hashes.

A text is its code points. Two prefix arrays, of a polynomial modulo two primes of 31 bits, give the hash of any span from
two of their elements, in terms that don't depend on where the span stands. So equality of any two spans takes constant
time, and the longest common extension of two places is found by binary search over its length.

A fingerprint is the number of code points, the hash of the whole text, and the ``KEPT`` smallest of the mixed hashes of
all its spans of ``SPAN`` code points (of the whole text, if shorter). Likeness of two fingerprints is the share of their
spans in common (Dice's coefficient), estimated from the smallest of both; it is 1 for equal texts. Texts are held against a
short one (under 4 * ``SPAN``) by shorter spans, of one size for both, which aren't in their fingerprints.

Neighbours by id are found without a global window: texts are dealt to ranges of ids whose bounds are ids themselves, the
first document of each range is also sent to the range before (the first of all to the last), and each range is
streamed in order, one text after the other.

Defined cases: null texts are empty; null ids come first; equal ids are ordered by text; a single document is its own next
one; an empty text has a fingerprint of no spans, whose likeness is 1 to another empty text and 0 to others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, mix, tasks

SPAN = 16
KEPT = 64
PRIMES = (2147483647, 2147483629)
BASES = (1181783497, 1597334677)
_powers = {(p, b): np.ones(1, np.uint64) for p, r in zip(PRIMES, BASES, strict=True) for b in (r, pow(r, -1, p))}


def _power(p: int, b: int, n: int) -> np.ndarray:
    have = _powers[p, b]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(b, len(have), p)) % np.uint64(p)])
    _powers[p, b] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PrefixHash:
    """Prefix arrays of a text; ``extended`` shares those of the kept beginning with a text that ends otherwise."""

    def __init__(self, points: np.ndarray, kept: PrefixHash | None = None, keep: int = 0):
        self.n = keep + len(points)
        self.arrays = []
        for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
            terms = (points + np.uint64(1)) * _power(p, b, self.n)[keep:] % np.uint64(p)
            head = kept.arrays[k][: keep + 1] if kept is not None else np.zeros(1, np.uint64)
            self.arrays.append(np.concatenate([head, (np.cumsum(terms, dtype=np.uint64) + head[-1]) % np.uint64(p)]))

    def extended(self, keep: int, points: np.ndarray) -> PrefixHash:
        return PrefixHash(points, self, keep)

    def spans(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the spans of one size at these places."""
        both = []
        for h, p, b in zip(self.arrays, PRIMES, BASES, strict=True):
            p64 = np.uint64(p)
            both.append((h[starts + size] + p64 - h[starts]) % p64 * _power(p, pow(b, -1, p), self.n + 1)[starts] % p64)
        return both[0] << np.uint64(31) | both[1]

    def span(self, start: int, size: int) -> int:
        """The hash of one span, in Python's integers."""
        both = []
        for h, p, b in zip(self.arrays, PRIMES, BASES, strict=True):
            both.append((int(h[start + size]) - int(h[start])) * int(_power(p, pow(b, -1, p), start + 1)[start]) % p)
        return both[0] << 31 | both[1]


def equal_spans(a: PrefixHash, i: int, b: PrefixHash, j: int, size: int) -> bool:
    return i + size <= a.n and j + size <= b.n and a.span(i, size) == b.span(j, size)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """How many code points agree from a[i] and b[j] on."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, middle) == b.span(j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _smallest(h: np.ndarray) -> np.ndarray:
    """The KEPT smallest distinct hashes, as 32 bits each."""
    short = (h >> np.uint64(32)).astype(np.uint32)
    share = 4 * KEPT / max(1, len(short))
    while share < 1:
        some = np.unique(short[short < np.uint32(share * 0xFFFFFFFF)])
        if len(some) >= KEPT:
            return some[:KEPT]
        share *= 4
    return np.unique(short)[:KEPT]


def span_hashes(text: PrefixHash, first: int = 0, size: int = SPAN) -> np.ndarray:
    """Mixed hashes of all spans of ``size`` code points that start at ``first`` or later."""
    if not text.n:
        return np.zeros(0, np.uint64)
    size = min(size, text.n)
    return mix(text.spans(np.arange(first, text.n - size + 1), size) + np.uint64(size))


def fingerprint(text: PrefixHash, hashes: np.ndarray) -> str:
    whole = text.span(0, text.n) if text.n else 0
    return f"{text.n:x}.{whole:016x}.{_smallest(hashes).astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated share of spans in common, from two fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition(".")[2]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    both = np.concatenate([x, y])
    both.sort()
    # Where a fingerprint is full, hashes over its largest are unknown in it.
    limit = min(x[-1] if len(x) == KEPT else both[-1], y[-1] if len(y) == KEPT else both[-1])
    both = both[both <= limit]
    common = int((both[1:] == both[:-1]).sum())
    return 2 * common / len(both)


def near(a: PrefixHash, b: PrefixHash, a_print: str, b_print: str) -> float:
    """Likeness of two texts: where one has under 4 * SPAN code points, by spans of a quarter of the shorter one, in both."""
    shorter = min(a.n, b.n)
    if not shorter or shorter >= 4 * SPAN or a_print == b_print:
        return likeness(a_print, b_print)
    return likeness(*(fingerprint(x, span_hashes(x, size=max(1, shorter // 4))) for x in (a, b)))


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], int]:
    """Ids that start ranges, from the smallest id on; at most n of them go to the driver."""
    row = docs.agg(F.min("_at"), F.percentile_approx("_at", [k / n for k in range(1, n)], 20 * n) if n > 1 else F.array(F.min("_at"))).first()
    return (sorted({row[0], *(row[1] or [])}) if row[0] is not None else []), n


def in_order(docs: DataFrame, n: int) -> DataFrame:
    """Rows (_range, _next, _at, doc_id, text), each task's sorted: the texts of ranges of ids, and after each range, marked
    _next, the first text of the next one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_at"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts, _ = _ranges(docs, 4 * n)
    bounds = np.array(starts, np.int64)

    def deal(batches):
        for b in batches:
            at = b.column("_at").to_numpy()
            own = np.searchsorted(bounds, at, "right") - 1
            first = np.flatnonzero(bounds[own] == at)
            rows = np.concatenate([np.arange(len(at)), first])
            to = np.concatenate([own, (own[first] - 1) % len(bounds)]).astype(np.int32)
            mark = np.arange(len(rows)) >= len(at)
            made = b.take(pa.array(rows)) if len(first) else b
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(mark), *made.columns], ["_range", "_next", *made.schema.names])

    dealt = mapped(docs, deal, "_range int, _next boolean, _at long, doc_id long, text string")
    return dealt.repartition(n, "_range").sortWithinPartitions("_range", "_next", "_at", "text")


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited long"
)


def compare_with_edited(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form (its last quarter gives way to the next text's beginning)."""
    spark: SparkSession = docs.sparkSession

    def finish(row, following):
        doc, text, own, hashes, print_ = row
        n = own.n
        keep = n - n // 4
        tail = following[1][: n // 4]
        edited = own.extended(keep, code_points(tail))
        first = max(0, keep - SPAN + 1) if n >= SPAN and edited.n >= SPAN else 0
        kept = hashes[:first]
        new = np.concatenate([kept, span_hashes(edited, first)])
        edited_print = fingerprint(edited, new)
        sha = hashlib.sha256((text[:keep] + tail).encode("utf-8", "surrogatepass")).hexdigest()
        return (doc, n, sha, print_, edited_print, near(own, edited, print_, edited_print), near(own, following[2], print_, following[4]), common_extension(own, 0, edited, 0))

    def run(batches):
        names = [x.split()[0] for x in RESULT.split(", ")]
        last, last_range, rows = None, None, []
        for b in batches:
            for where, mark, doc, text in zip(b.column("_range").to_pylist(), b.column("_next").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if where == last_range and last is None:
                    continue  # a further text of the id that starts the next range
                text = text.as_py()
                own = PrefixHash(code_points(text))
                hashes = span_hashes(own)
                row = (doc, text, own, hashes, fingerprint(own, hashes))
                if last is not None:
                    rows.append(finish(last, row))
                last, last_range = None if mark else row, where
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=_schema(names))
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=_schema(names))

    return mapped(in_order(docs, partitions or tasks(spark)), run, RESULT)


def _schema(names: list[str]) -> pa.Schema:
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "common_edited": pa.int64()}
    return pa.schema([(n, kinds.get(n, pa.string())) for n in names])
