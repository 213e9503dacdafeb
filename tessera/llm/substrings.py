"""Repeated passages: per-shard suffix arrays, common prefixes, and shards in which all equal windows meet.

A window is a string of ``LENGTH`` bytes of one text (or of so many of its words); what a window covers goes if that window
also starts anywhere else (or, if asked for, in any other text).

1. Anchors. In each window the string of ``GRAM`` bytes with the smallest hash is its anchor (the leftmost of equals), so
   equal windows have equal anchors at the same place. Neighbouring windows with one anchor form a run. Runs whose anchor
   occurs nowhere else hold no repeated window and go. Runs with equal bytes are a class, kept once with its multiplicity;
   this only deals out the work and decides nothing about a window.
2. Shards. The bytes of the classes (a run and the LENGTH-1 bytes behind it) are dealt to shards by their anchors, so equal
   windows meet in a shard. An anchor with more bytes than a shard should have (the classes of a group of near copies) is
   dealt again by second anchors: its windows are split by the anchor's place in them, and all windows with the anchor in
   an interval of places share the bytes around it, which name the shard. Intervals shrink by 8 with each level, down to
   single windows, so a group of any size ends up in small shards, with at most 8 rows a level for each run; runs that are
   equal in that smaller frame are one class again.
3. A shard's suffixes are sorted by Larsson-Sadakane refinement: groups of suffixes with equal prefixes are split by the
   ranks of the suffixes behind those, and only groups that aren't singletons are sorted again. Common prefixes of
   neighbours follow by Kasai's inequality: a suffix whose preceding byte equals its neighbour's has the preceding common
   prefix less one, so only the others are compared. Windows whose neighbours share LENGTH bytes, with a multiplicity of
   two or more together, are repeated.
4. The repeated windows of the classes are carried back to all texts of the classes, and are cut out. No window has its
   equals in two shards, so shards merge by uniting the byte ranges they found in a text.

Texts are identified by their MD5; rows of equal texts have equal results. Texts are compressed (zstd) when they are moved.
With ``unit`` words, windows are of words (runs of other bytes than ASCII white space; the space between may differ).

Defined cases: null texts are empty; texts shorter than LENGTH lose nothing; rows repeated with their text, if that is long
enough, lose all bytes (only with ``across``, texts that are equal count as one); texts of over 1 MiB are read in pieces
that share the bytes of a window, and give the same result; an empty table gives an empty result; other columns are ignored
by ``repeated`` and passed on by ``without_repeats``. Matches never cross rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SpanHash, cut, cut_small, doc_slices, mapped, resplit, text_buffers, words

LENGTH = 400
GRAM = 100
#: Bytes of a shard, about, and of one anchor beyond which it is dealt again.
SHARD = 1 << 20
HOT = 1 << 19
#: Times that the intervals of a level are smaller than those of the level before.
FINER = 8
_LOW = np.uint64((1 << 24) - 1)
_PLACE, _LEVEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

RUNS = "t1 long, t2 long, anchor long, content long, a int, n int, size int, place int"


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of a width, from running minima of blocks of that width to either side."""
    n = len(keys)
    if n < width:
        return keys[:0]
    pad = -n % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Symbols:
    """Bytes, or words, of a slice of texts: where they start and end, the rows' bounds, and hashes of spans of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        self.bytes = SpanHash(data)
        if unit == "bytes":
            self.starts, self.bounds, self.span = np.arange(len(data)), offsets, self.bytes
            self.ends = self.starts + 1
        else:
            self.starts, self.ends, self.bounds = words(data, offsets)
            self.hashes = self.bytes(self.starts, self.ends)
            self.span = SpanHash(self.hashes)

    def content(self, first, after, place) -> np.ndarray:
        """Hash of the bytes from a symbol to before another, with a place in them."""
        return self.bytes(self.starts[first], self.ends[after - 1]) ^ place.astype(np.uint64) * _PLACE


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, unit: str = "bytes"):
    """(row, first byte from the row's start, windows, bytes, anchor's place in symbols, anchor hash, content hash) of runs."""
    empty = np.zeros(0, np.int64)
    x = Symbols(data, offsets, unit)
    if len(x.starts) < length:
        return (empty,) * 5 + (empty.view(np.uint64),) * 2
    at = np.arange(len(x.starts) - gram + 1)
    grams = x.span(at, at + gram)
    where = window_minima((grams & ~_LOW) | at.astype(np.uint64), length - gram + 1) & _LOW
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(x.bounds))[: len(where)]
    inside = x.bounds[row + 1] - np.arange(len(where)) >= length
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1])
    end = np.ones(len(where), bool)
    end[:-1] = new[1:] | ~inside[1:]
    first, last = np.flatnonzero(new & inside), np.flatnonzero(end & inside)
    place = where[first].astype(np.int64) - first
    after = last + length
    return row[first], x.starts[first] - offsets[row[first]], last - first + 1, x.ends[after - 1] - x.starts[first], place, grams[first + place], x.content(first, after, place)


def long_pieces(data: np.ndarray, length: int, unit: str, size: int):
    """(first byte, byte after the last) of pieces of about ``size`` bytes of a long text; each window is in one piece."""
    a = 0
    while a < len(data):
        piece, more = size, size
        if unit == "bytes":
            yield a, min(len(data), a + piece + length - 1)
            a += piece
            continue
        while True:
            z = min(len(data), a + piece + more)
            starts, ends, _ = words(data[a:z], np.array([0, z - a]))
            whole = len(ends) - (z < len(data) and len(ends) and ends[-1] == z - a)
            following = max(1, int(np.searchsorted(starts, piece)))  # the word with which the next piece starts
            if z == len(data) or following + length - 1 <= whole:
                break
            more *= 2
        if following >= len(starts):
            yield a, len(data)
            return
        yield a, a + int(ends[min(following + length - 2, len(ends) - 1)])
        a += int(starts[following])


def _columns(parts, names: str, types: dict):
    """A record batch from lists of arrays of a schema's columns."""
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(types[t], copy=False)) for c, (_, t) in zip(zip(*parts, strict=True), fields, strict=True)], [f for f, _ in fields])


_TYPES = {"long": np.int64, "int": np.int32}


def digest_of(text) -> list:
    """t1 and t2 of a text column: the halves of its MD5 as signed numbers."""
    hex_ = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return [F.conv(F.substring(hex_, at, 16), 16, -10).cast("long").alias(t) for t, at in (("t1", 1), ("t2", 17))]


def find_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: str = "bytes") -> DataFrame:
    limit = common.SLICE

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            made, held = [], 0
            for i, j in doc_slices(offsets, limit):
                digests = np.array([np.frombuffer(hashlib.md5(data[a:z]).digest(), ">i8").astype(np.int64) for a, z in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)])
                whole = data[offsets[i] : offsets[j]]
                long = j == i + 1 and len(whole) > limit
                for a, z in long_pieces(whole, length, unit, limit) if long else ((0, len(whole)),):
                    row, first, n, size, place, anchor, content = runs(whole[a:z], np.array([0, z - a]) if long else offsets[i : j + 1] - offsets[i], length, gram, unit)
                    if len(row):
                        made.append((digests[row, 0], digests[row, 1], anchor.view(np.int64), content.view(np.int64), first + a, n, size, place))
                        held += len(row)
                if held > 100000:
                    yield _columns(made, RUNS, _TYPES)
                    made, held = [], 0
            if made:
                yield _columns(made, RUNS, _TYPES)

    return mapped(docs.select("text"), run, RUNS)


def regions_of(classes: DataFrame, names: list[str]) -> DataFrame:
    """For each text (t1, t2) that classes are cut from, a list of these (their ``names``, and a and size)."""
    return classes.groupBy("t1", "t2").agg(F.collect_list(F.struct(*names, "a", "size")).alias("regions"))


def _slices(names: list[str], raw: str = "z"):
    """A function from batches of texts (``raw``: z, compressed, or x, as they are) and their regions to batches of pieces:
    the regions' ``names`` and their bytes."""

    def run(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            regions = b.column("regions")
            flat, ends = regions.flatten(), np.concatenate([[0], np.cumsum(regions.value_lengths().to_numpy())])
            a, size = flat.field("a").to_numpy(), flat.field("size").to_numpy()
            first, parts, held = 0, [], 0
            for i, z in enumerate(b.column(raw)):
                text = d.decompress(z.as_py()) if raw == "z" else (z.as_py() or "").encode()
                for k in range(ends[i], ends[i + 1]):
                    parts.append(text[a[k] : a[k] + size[k]])
                    held += len(parts[-1])
                    if held > 4 << 20 or k + 1 == ends[-1]:
                        some = flat.slice(first, k + 1 - first)
                        yield pa.RecordBatch.from_arrays([*[some.field(x) for x in names], pa.array(parts, pa.binary())], [*names, "bytes"])
                        first, parts, held = k + 1, [], 0

    return run


FINER_RUNS = "p_anchor long, p_content long, shift int, anchor long, content long, n int, size int, place int, times long, text long"
PIECE = ["anchor", "content", "n", "place", "times", "text"]


def _finer(length: int, gram: int, unit: str, level: int):
    """A function from batches of pieces (``PIECE``, bytes) to their runs dealt again by the place of their anchor: windows
    with it in an interval of places have in common the symbols that all windows of that interval cover, their new anchor."""
    places = length - gram + 1
    each = max(1, places // FINER**level)

    def run(batches):
        for whole in batches:
            _, bounds = text_buffers(whole.column("bytes"))
            for i, j in doc_slices(bounds):
                b = whole.slice(i, j - i)
                raw, offsets = text_buffers(b.column("bytes"))
                x = Symbols(raw, offsets, unit)
                place, n = b.column("place").to_numpy().astype(np.int64), b.column("n").to_numpy().astype(np.int64)
                least = (place - n + 1) // each
                count = place // each - least + 1
                row = np.repeat(np.arange(len(n)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + least[row]
                first = place[row] - np.minimum(place[row], (k + 1) * each - 1)
                last = place[row] - np.maximum(place[row] - n[row] + 1, k * each)
                at = x.bounds[row] + place[row]
                key = x.span(at - k * each, at - np.minimum((k + 1) * each, places) + 1 + length)
                anchor = common.mix(key + (k + 1).astype(np.uint64) * _PLACE + np.uint64(level) * _LEVEL)
                own, after = x.bounds[row] + first, x.bounds[row] + last + length
                begin, end = x.starts[own], x.ends[after - 1]
                made = (
                    *(b.column(c).to_numpy()[row] for c in ("anchor", "content")), begin - offsets[row], anchor.view(np.int64), x.content(own, after, place[row] - first).view(np.int64),
                    last - first + 1, end - begin, place[row] - first, *(b.column(c).to_numpy()[row] for c in ("times", "text")),
                )
                for k in range(0, len(row), 4096):
                    part = _columns([[c[k : k + 4096] for c in made]], FINER_RUNS, _TYPES)
                    own_bytes = pa.array([raw[p:q].tobytes() for p, q in zip(begin[k : k + 4096], end[k : k + 4096], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, own_bytes], [*part.schema.names, "bytes"])

    return run


def packed(docs: DataFrame, with_id: bool) -> DataFrame:
    """(doc_id, t1, t2, z): the texts' digests and their zstd-compressed bytes."""

    def run(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            texts = [data[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            t = np.array([np.frombuffer(hashlib.md5(x).digest(), ">i8") for x in texts], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*[b.column("doc_id")] * with_id, pa.array(np.ascontiguousarray(t[:, 0])), pa.array(np.ascontiguousarray(t[:, 1])), pa.array([c.compress(x) for x in texts], pa.binary())],
                [*["doc_id"] * with_id, "t1", "t2", "z"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, run, "doc_id long, " * with_id + "t1 long, t2 long, z binary")


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of some bytes (or numbers) and their ranks, by Larsson-Sadakane refinement from the first 8 bytes
    (or the first number) on."""
    n, in_bytes = len(text), text.dtype == np.uint8
    key = text
    if in_bytes:
        wide = np.concatenate([text, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | wide[k : k + n].astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    same = key[sa]
    head = np.ones(n, bool)
    head[1:] = same[1:] != same[:-1]
    del key, same
    rank = np.zeros(n + 1, np.int64)  # the empty suffix ranks 0; others by the first place of their group
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1), 0))
    # The zeros behind the text don't tell the last suffixes from equal ones with real zeros: those are told apart by length.
    h = 8 if in_bytes else 1
    if n and in_bytes:
        tail = np.arange(max(0, n - 8), n)
        rank, sa, head = _settle_tail(text, sa, rank, head, tail)
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(open_):
        s = sa[open_]
        group, behind = rank[s], rank[np.minimum(s + h, n)]
        order = np.argsort(group * np.int64(n + 2) + behind, kind="stable")
        s, group, behind = s[order], group[order], behind[order]
        sa[open_] = s
        new = np.ones(len(s), bool)
        new[1:] = (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])
        head[open_] = new
        rank[s] = np.maximum.accumulate(np.where(new, open_ + 1, 0))
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        h *= 2
    return sa, rank


def _settle_tail(text, sa, rank, head, tail):
    """Rank the last suffixes, shorter than 8 bytes, before longer ones of the same group, shortest first."""
    n = len(text)
    if not (text[tail] == 0).any():
        # Without zero bytes no full key equals a padded one; all of the tail's groups are alone already.
        return rank, sa, head
    for g in np.unique(rank[tail]):
        at = np.flatnonzero(rank[sa] == g)
        s = sa[at]
        shortness = np.where(s > n - 8, n - s, 9)
        order = np.argsort(shortness, kind="stable")
        s, shortness = s[order], shortness[order]
        new = np.ones(len(s), bool)
        new[1:] = shortness[1:] != shortness[:-1]
        sa[at], head[at] = s, new
        rank[s] = np.maximum.accumulate(np.where(new, at + 1, 0))
    return rank, sa, head


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Lengths, up to ``most``, of the common prefixes of each sorted suffix and the one before it (0 for the first).

    Kasai: with the byte before both equal, the length is that of the suffix one place earlier, less one. The places where
    that doesn't hold are compared, all at once, a block of bytes at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    bound = (before < 1) | (place < 1)
    bound |= text[np.maximum(place - 1, 0)] != text[np.maximum(before - 1, 0)]
    start = np.flatnonzero(bound)
    length = np.zeros(len(start), np.int64)
    go = np.flatnonzero(before[start] >= 0)
    full = np.concatenate([text, np.zeros(16, text.dtype)])
    while len(go):
        i, j = start[go] + length[go], before[start[go]] + length[go]
        step = np.arange(16)
        room = n - np.maximum(i, j)
        differ = full[np.minimum(i, n)[:, None] + step] != full[np.minimum(j, n)[:, None] + step]
        same = np.where(differ.any(1), differ.argmax(1), 16)
        same = np.minimum(same, room)
        length[go] += same
        go = go[(same == 16) & (length[go] < n)]
    # A common prefix may be longer than ``most``: the inequality needs its whole length.
    run = np.cumsum(bound) - 1
    plcp = length[run] - (place - start[run])
    return np.minimum(np.maximum(plcp, 0), most)[sa]


def window_kinds(text: np.ndarray, is_window: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a shard in suffix order, and the number of each one's kind."""
    sa, _ = suffix_array(text)
    kind = np.cumsum(common_prefixes(text, sa, length) < length) - 1
    at = is_window[sa]
    sa, kind = sa[at], kind[at]
    return sa, np.cumsum(np.append(True, kind[1:] != kind[:-1])) - 1 if len(kind) else kind


FOUND = "anchor long, content long, lo int, hi int"


def _shards(pieces: DataFrame, length: int, unit: str, across: bool) -> DataFrame:
    """Pieces (shard, anchor, content, times, text, n, bytes) to FOUND: byte ranges of classes that repeated windows cover."""
    from .neardup import _tasks

    def solve(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        raw, offsets = text_buffers(table["bytes"])
        n, anchor, content = (table[c].to_numpy() for c in ("n", "anchor", "content"))
        if unit == "bytes":
            symbols, bounds = raw, offsets
            starts = np.arange(len(raw))
            ends = starts + 1
        else:
            x = Symbols(raw, offsets, unit)
            starts, ends, bounds = x.starts, x.ends, x.bounds
            symbols = np.unique(x.hashes, return_inverse=True)[1]
        piece = np.repeat(np.arange(len(n)), np.diff(bounds))
        local = np.arange(len(symbols)) - bounds[piece]
        sa, kind = window_kinds(symbols, local < n[piece], length)
        if across:  # a kind that two texts have: one class has more than one, or classes have different ones
            text = table["text"].to_numpy()[piece[sa]]
            firsts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else kind
            dup = np.zeros(len(firsts), bool)
            if len(firsts):
                dup = (np.minimum.reduceat(text, firsts) != np.maximum.reduceat(text, firsts)) | np.logical_or.reduceat(table["times"].to_numpy()[piece[sa]] > 1, firsts)
        else:
            dup = np.bincount(kind, table["times"].to_numpy()[piece[sa]]) >= 2
        repeated = np.zeros(len(symbols) + 1, bool)
        repeated[sa[dup[kind]]] = True
        change = np.flatnonzero(repeated[1:] != repeated[:-1]) + 1
        edges = np.unique(np.concatenate([change, bounds[:-1], [0]]))
        lo = edges[repeated[edges]]
        hi = np.minimum(np.append(edges, len(symbols))[np.searchsorted(edges, lo, "right")], bounds[piece[lo] + 1]) if len(lo) else lo
        p = piece[lo]
        return anchor[p], content[p], starts[lo] - offsets[p], ends[hi + length - 2] - offsets[p]

    def run(batches):
        for rows in _tasks(batches, "shard"):
            part = solve(rows)
            for k in range(0, len(part[0]), 50000):
                yield _columns([[x[k : k + 50000] for x in part]], FOUND, _TYPES)

    return mapped(pieces.repartition("shard").sortWithinPartitions("shard"), run, FOUND)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int | None = None, shard: int = SHARD, hot: int = HOT, store_runs: bool = True, unit: str = "bytes", across: bool = False
) -> DataFrame:
    """(t1, t2, spans): for texts with repeated windows, the byte ranges [lo, hi) these cover (not yet merged).

    Short windows make many runs: without ``store_runs`` these are found a second time instead of being written. With
    ``across``, a window is repeated only if another text has it too.
    """
    gram = gram or max(1, length // 4)
    every = find_runs(docs, length, gram, unit)
    every = cut(every) if store_runs else every
    often = every.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    members = cut(every.join(resplit(often), "anchor"))
    same = ["anchor", "content", "n", "size", "place"]

    def gathered(rows: DataFrame, *more) -> DataFrame:
        """Classes of runs; with ``across`` their times are 2 if several texts have them, else 1."""
        got = rows.groupBy(*same).agg(F.sum("times").alias("times"), F.max("times").alias("_most"), F.min("text").alias("text"), F.max("text").alias("_other"), *more)
        several = (F.col("text") != F.col("_other")) | (F.col("_most") > 1)
        return (got.withColumn("times", F.when(several, 2).otherwise(1).cast("long")) if across else got).drop("_most", "_other")

    classes = members.withColumns({"times": F.lit(1).cast("long"), "text": F.xxhash64("t1", "t2")})
    classes = cut(gathered(classes, F.min(F.struct("t1", "t2", "a")).alias("r")).select(*same, "times", "text", "r.t1", "r.t2", "r.a"))
    total = classes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard))
    shard_of = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    names = {"shard": "long", "anchor": "long", "content": "long", "times": "long", "text": "long", "n": "int"}
    heavy = cut_small(classes.groupBy("anchor").agg(F.sum("size").alias("w")).where(F.col("w") > hot).select("anchor"))
    more, back, level = [], [], 0
    if not heavy.isEmpty():
        source = _hot_texts(docs, classes.join(resplit(heavy), "anchor"))
        classes = classes.join(resplit(heavy), "anchor", "left_anti")
        while True:
            level += 1
            finer = _finer(length, gram, unit, level)
            if level == 1:  # one function: cutting the texts and dealing their pieces takes one worker
                finer = lambda batches, deal=finer: deal(_slices(PIECE, "x")(batches))
            finer = cut_small(mapped(source, finer, f"{FINER_RUNS}, bytes binary"))
            back.append(finer.select("p_anchor", "p_content", "shift", "anchor", "content"))
            again = gathered(finer, F.first("bytes").alias("bytes"))
            weights = again.groupBy("anchor").agg(F.count("*").alias("k"), F.max("times").alias("t"), F.sum("size").alias("w")).where("k > 1 or t > 1")
            again = cut_small(again.join(resplit(weights.select("anchor", "w")), "anchor"))
            settled = F.lit(FINER**level >= length - gram + 1) | (F.col("w") <= hot)
            more.append(again.where(settled).select(shard_of, *[c for c in names if c != "shard"], "bytes"))
            source = again.where(~settled).select(*PIECE, "bytes")
            if source.isEmpty():
                break
    texts = packed(docs, False).groupBy("t1", "t2").agg(F.first("z").alias("z"))
    regions = regions_of(classes.withColumn("shard", shard_of), list(names)).join(texts, ["t1", "t2"]).select("regions", "z")
    pieces = mapped(regions, _slices(list(names)), ", ".join(f"{k} {t}" for k, t in names.items()) + ", bytes binary")
    for x in more:
        pieces = pieces.unionByName(x)
    found = cut_small(_shards(pieces, length, unit, across))
    for x in reversed(back):  # a finer class's ranges are its parents' ranges
        up = found.join(x, ["anchor", "content"]).select(F.col("p_anchor").alias("anchor"), F.col("p_content").alias("content"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))
        found = found.unionByName(up)
    own = members.select("t1", "t2", "a", "anchor", "content").distinct()
    spans = own.join(found, ["anchor", "content"])
    span = F.struct((F.col("a") + F.col("lo")).alias("lo"), (F.col("a") + F.col("hi")).alias("hi"))
    return spans.groupBy("t1", "t2").agg(F.collect_list(span).alias("spans"))


#: Rows of hot classes up to which these go to the texts by a broadcast (some 100 bytes each), instead of all texts to them.
MOST_SENT = 1 << 18


def _hot_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(regions, x): the texts that hot classes are cut from, with these."""
    classes = cut_small(classes)
    regions = regions_of(classes, PIECE)
    regions = F.broadcast(regions) if classes.count() <= MOST_SENT else regions
    found = docs.select(*digest_of(F.col("text")), F.col("text").alias("x")).join(regions, ["t1", "t2"])
    return found.groupBy("t1", "t2").agg(F.first("regions").alias("regions"), F.first("x").alias("x")).select("regions", "x")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>"


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in spans:
        parts.append(text[at:lo])
        at = hi
    return b"".join([*parts, text[at:]])


def repeated(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (the byte ranges that go)."""
    rows = packed(docs, True).join(repeated_spans(docs, length, **options), ["t1", "t2"], "left").select("doc_id", "z", "spans")

    def run(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc, z, spans in zip(b.column("doc_id").to_pylist(), b.column("z"), b.column("spans"), strict=True):
                text = d.decompress(z.as_py())
                gone = merged([(s["lo"], s["hi"]) for s in spans.as_py() or ()])
                out.append((doc, len(text), sum(hi - lo for lo, hi in gone), len(gone), hashlib.sha256(kept(text, gone)).hexdigest(), [{"start": lo, "stop": hi} for lo, hi in gone]))
            if out:
                kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return mapped(rows, run, RESULT)


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """The rows of ``docs`` without the repeated passages of their texts, and n_chars counted anew where a text changed.

    What a cut leaves of a character's bytes goes too. Rows of which only white space is left by cuts go; others stay.
    """
    names = docs.columns
    rest = [c for c in names if c != "text"]
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    source = docs.select(F.struct(*rest).alias("row") if rest else F.struct(F.lit(0).alias("_")).alias("row"), F.col("text"))
    row_type = source.schema["row"]
    packed_type = StructType([row_type, StructField("t1", LongType()), StructField("t2", LongType()), StructField("z", BinaryType())])

    def pack(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            column = b.column("text")
            data, offsets = text_buffers(column)
            texts = [data[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            t = np.array([np.frombuffer(hashlib.md5(x).digest(), ">i8") for x in texts], np.int64).reshape(-1, 2)
            z = [c.compress(x) if ok else None for x, ok in zip(texts, column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.ascontiguousarray(t[:, 0])), pa.array(np.ascontiguousarray(t[:, 1])), pa.array(z, pa.binary())], ["row", "t1", "t2", "z"])

    joined = mapped(source, pack, packed_type).join(repeated_spans(docs, length, **options), ["t1", "t2"], "left").select("row", "z", "spans")
    out_type = StructType([row_type, docs.schema["text"], StructField("cut", LongType())])

    def unpack(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            texts, cuts = [], []
            for z, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
                text = d.decompress(z) if z is not None else None
                gone = merged([(s["lo"], s["hi"]) for s in spans or ()])
                left = kept(text, gone).decode("utf-8", "ignore") if text is not None else None
                texts.append(left)
                cuts.append(-1 if gone and not left.strip(" \t\n\v\f\r") else sum(hi - lo for lo, hi in gone))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(cuts, pa.int64())], ["row", "text", "cut"])

    rows = mapped(joined, unpack, out_type).where("cut >= 0")
    column = {c: F.col("row")[c] for c in rest} | {"text": F.col("text")}
    if "n_chars" in column:
        column["n_chars"] = F.when(F.col("cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(column["n_chars"])
    return rows.select(*[column[c].alias(c) for c in names])
