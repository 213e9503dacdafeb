"""Shared helpers: lineage cuts in the cluster's shared folder, and vectorised byte-level text primitives.

The text primitives work on whole Arrow batches: the UTF-8 bytes of all texts of a batch are one numpy array with
document offsets, and every temporary array is bounded by ``SLICE`` bytes of text, whatever the length of a document.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds the temporary arrays of a Python worker.
SLICE = 1 << 20
#: Bytes of a batch of rows that Spark gives to Python.
BATCH_BYTES = 8 << 20
#: Words are maximal runs of bytes outside this set (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster: spark.checkpoint.dir. Only in local mode, where all is one process, may it be
    unset: a temporary folder takes its place."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not conf and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="tessera-"))
    return conf or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder, so a lost executor costs no recomputation of what is above."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of at most ``BATCH_BYTES``, whatever the rows' lengths (one row at least).

    The bound is a setting of the session, which is lowered to it if it is larger.
    """
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    n, unit = re.match(r"(\d+)\s*([kmgtp]?)", spark.conf.get(key).lower()).groups()
    if int(n) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")

    def bounded(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # what an idle worker would keep

    return df.mapInArrow(bounded, schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_small(df: DataFrame) -> DataFrame:
    """``cut`` for rows that are few beside those of the other stages: in a 16th as many files, so that these aren't tiny."""
    return cut(df.repartition(-(-tasks(df.sparkSession) // 16)))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def resplit(df: DataFrame) -> DataFrame:
    """Deal the (few) rows of an aggregation anew, before they are joined by the key they are grouped by.

    Else Spark joins right where it has aggregated, all rows of a key in one task; so both sides of the join get exchanges
    of their own, and the partition of a hot key can be split at run time.
    """
    return df.repartition(tasks(df.sparkSession))


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(remainder_of, mod: int = 5):
    """crc32 of the id as text, modulo ``mod``; null ids count as the empty string."""
    return F.crc32(F.coalesce(remainder_of.cast("string"), F.lit("")).cast("binary")) % mod


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary array and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


#: Modulus of the span hashes, a prime with a cheap remainder, and two bases; each byte has a random number besides.
_PRIME = np.uint64((1 << 31) - 1)
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, int(_PRIME), 256, dtype=np.uint64)
_BASES = [int(x) for x in _RNG.integers(1 << 20, int(_PRIME), 2)]
_powers: dict[int, np.ndarray] = {}


def _less(x: np.ndarray) -> np.ndarray:
    """Congruent modulo the prime, and under 2**33 (under 2**31 + 4 for x under 2**33)."""
    return (x & _PRIME) + (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 12):
            more = have * np.uint64(pow(base, len(have), int(_PRIME))) % _PRIME
            have = np.concatenate([have, more])
        _powers[base] = have
    return have[:n]


class SpanHash:
    """64-bit hashes of any spans of one slice of bytes, from prefix sums of polynomials modulo a prime at two bases.

    Bytes go through a random table first; a span's hash does not depend on where the span stands. The modulus is a prime:
    modulo a power of two, strings such as the Thue-Morse sequence and its complement have equal hashes at every base.
    """

    def __init__(self, data: np.ndarray):
        """data: bytes, or 64-bit hashes of other symbols, of which spans are hashed just so."""
        n = len(data)
        wide = data.dtype == np.uint64
        self.parts = []
        for base, shift in zip(_BASES, (33, 0), strict=True):
            prefix = np.zeros(n + 1, np.uint64)
            coded = data >> np.uint64(shift) & _PRIME if wide else _BYTE[data]
            np.cumsum(_less(coded * powers(base, n)), out=prefix[1:])
            self.parts.append((prefix, powers(pow(base, -1, int(_PRIME)), n + 1)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = (ends - starts).astype(np.uint64) * MIX2
        for k, (prefix, inverse) in enumerate(self.parts):
            x = _less(_less(prefix[ends] - prefix[starts])) * inverse[starts]
            x = _less(_less(x))
            out += np.where(x >= _PRIME, x - _PRIME, x) << np.uint64(32 * k)
        return mix(out)


def doc_slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with at most ``limit`` bytes together, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and for each row the number of words before it (rows + 1 numbers)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= first[1:] | ~solid[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_pieces(data: np.ndarray, offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A slice of rows as it is; or one longer row in pieces of about ``limit`` bytes that end at the end of a word."""
    limit = 2 * SLICE if limit is None else limit
    if len(data) <= limit or len(offsets) != 2:
        yield data, offsets
        return
    a = 0
    while a < len(data):
        z = min(len(data), a + limit)
        while z < len(data):
            space = np.flatnonzero(_IS_SPACE[data[z : z + 4096]])
            z += int(space[0]) if len(space) else min(4096, len(data) - z)
            if len(space):
                break
        yield data[a:z], np.array([0, z - a])
        a = z


def word_hashes(data: np.ndarray, offsets: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of a slice of rows, and word offsets of the rows."""
    parts, bounds = [], None
    for piece, own in word_pieces(data, offsets, limit):
        starts, ends, bounds = words(piece, own)
        parts.append(SpanHash(_FOLD[piece])(starts, ends))
    if len(parts) == 1:
        return parts[0], bounds
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]] along the first axis, zero for empty rows."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=np.float64)
    return out
