"""Language model scores: Brown class-based bigrams from exchange clustering.

Tokens are words (A-Z lower-cased) and one end per text. Each pass over the corpus is over all of its rows:

1. The counts of all training words (64-bit hashes), an aggregation over the cluster; the table stays there. At
   most ``COMMON`` of the most frequent words come to the driver.
2. The bigram counts of items. An item is one of the ``ITEMS`` most frequent words, or all other words with the same last
   three bytes, hashed to ``ENDINGS`` buckets: at most (ITEMS + ENDINGS + 2) squared numbers, however large the corpus is.
   The exchange algorithm moves items between ``CLASSES`` classes as long as that raises the likelihood of the class
   bigrams. Then each further word of the ``COMMON`` that is seen ``LEAST`` times or more goes to the class of the best
   likelihood of all its neighbours' classes, and the class bigrams are counted anew. Only rarer words have a class by
   their ending.
3. Scores. P(word | history) = P(class | previous class) * P(word | class). Transitions are smoothed with the class's own
   share, emissions add 0.5 to each count and leave 0.5 for an unseen word in each class. Common words are looked up in a
   broadcast of fixed size; the other words of each text are joined with the table of counts, so a rare word moves once
   for each text it is in, and no word that is frequent moves at all.

Defined cases: null texts are empty (the end alone); without training rows all counts are 0; repeated rows and ids are scored
as separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _FOLD, SpanHash, cut, doc_slices, mapped, text_buffers, word_pieces, words

COMMON = 1 << 18
ITEMS = 2048
ENDINGS = 512
CLASSES = 64
PASSES = 6
#: Occurrences from which on a word's class comes from its own neighbours.
LEAST = 5
#: Distinct (word, neighbouring class) keys that a task holds before it gives them away.
HELD = 1 << 21
#: Weight, in counts, of a class's own share in the transitions to it.
OWN_SHARE = 5.0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ending buckets of the words of a slice, and word offsets of the rows."""
    hashes, endings, bounds = [], [], None
    for piece, own in word_pieces(data, offsets):
        starts, ends, bounds = words(piece, own)
        piece = _FOLD[piece]
        hashes.append(SpanHash(piece)(starts, ends).view(np.int64))
        size, last = ends - starts, np.zeros(len(ends), np.uint32)
        for k in (1, 2, 3):  # a shorter word's missing bytes count as 0
            last = last << np.uint32(8) | np.where(size >= k, piece[np.maximum(ends - k, 0)], 0).astype(np.uint32)
        endings.append((((last * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(ENDINGS)).astype(np.int32))
    if len(hashes) > 1:
        bounds = np.array([0, sum(map(len, hashes))])
    return np.concatenate(hashes), np.concatenate(endings), bounds


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, ending, count) of all words of the texts."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(text))
            for i, j in doc_slices(offsets):
                h, ending, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                got, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(ending[first]), pa.array(n)], ["word", "ending", "n"])

    parts = mapped(docs.select(text), run, "word long, ending int, n long")
    return parts.groupBy("word", "ending").agg(F.sum("n").alias("count"))


@dataclass
class Lookup:
    """Item numbers: frequent words first, then endings, then the end of a text, then its beginning."""

    words: np.ndarray  # sorted hashes of the ITEMS words

    @property
    def end(self) -> int:
        return len(self.words) + ENDINGS

    def items(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return ending.astype(np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, len(self.words) + ending)

    def sequences(self, h: np.ndarray, ending: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items with an end behind each row, the item before each (the beginning, at a row's start), and the rows' ends."""
        rows = len(bounds) - 1
        ends = bounds[1:] + np.arange(rows)
        seq = np.empty(len(h) + rows, np.int64)
        is_word = np.ones(len(seq), bool)
        is_word[ends] = False
        seq[is_word] = self.items(h, ending)
        seq[ends] = self.end
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[bounds[:-1] + np.arange(rows)] = self.end + 1
        return seq, before, ends


def item_bigrams(docs: DataFrame, lookup: Lookup, text: str = "text") -> DataFrame:
    """(pair, n): counts of neighbouring items, as previous * number of items + next."""
    m = lookup.end + 2

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(text))
            for i, j in doc_slices(offsets):
                seq, before, _ = lookup.sequences(*tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                pair, n = np.unique(before * m + seq, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    return mapped(docs.select(text), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, fixed: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Classes of items from their matrix of bigram counts; the last ``fixed`` items have classes of their own.

    Objective (up to what doesn't depend on the classes): sum g log g over class bigrams, minus sum of g log g over the
    classes as first and as second. Each item moves to the class of the best objective, in order of frequency, until a
    pass moves nothing.
    """
    m = len(bigrams)
    free, total = m - fixed, classes + fixed
    size = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-size[:free], kind="stable")
    label = np.empty(m, np.int64)
    label[order] = np.arange(free) % classes
    label[free:] = classes + np.arange(fixed)
    onehot = np.zeros((m, total))
    onehot[np.arange(m), label] = 1
    right = bigrams @ onehot  # of each item, to each class
    left = bigrams.T @ onehot
    g = onehot.T @ right
    for _ in range(passes):
        moved = 0
        for w in order:
            if not size[w]:
                continue
            a = label[w]
            r, l_, own = right[w].copy(), left[w].copy(), bigrams[w, w]
            r[a] -= own
            l_[a] -= own
            # Without the item: its counts leave row and column a.
            g[a] -= r
            g[:, a] -= l_
            g[a, a] -= own
            rows, cols = g.sum(1), g.sum(0)
            out, in_ = r.sum() + own, l_.sum() + own
            c = slice(0, classes)
            gain = (_xlogx(g[c] + r) - _xlogx(g[c])).sum(1) + (_xlogx(g[:, c] + l_[:, None]) - _xlogx(g[:, c])).sum(0)
            # The cell of a class with itself takes from both, and the item's own pairs.
            d = np.diagonal(g)[c]
            gain += _xlogx(d + r[c] + l_[c] + own) - _xlogx(d + r[c]) - _xlogx(d + l_[c]) + _xlogx(d)
            gain -= _xlogx(rows[c] + out) - _xlogx(rows[c]) + _xlogx(cols[c] + in_) - _xlogx(cols[c])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            g[b] += r
            g[:, b] += l_
            g[b, b] += own
            if b != a:
                moved += 1
                label[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return label


def word_contexts(docs: DataFrame, lookup: Lookup, label: np.ndarray, further: np.ndarray, k: int, text: str = "text") -> DataFrame:
    """(word, cells): for words of the sorted ``further``, by number, parts of their counts of previous and of next classes.

    Each cell is a 64-bit number: the class before, or k + the class behind, times 2**40, plus the count.
    """
    share = docs.sparkSession.sparkContext.broadcast((lookup, label, further))

    def give(keys, n):
        word = keys // (2 * k)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(keys) else word
        cells = (keys % (2 * k) << 40) + n
        parts = [c.tobytes() for c in np.split(cells, first[1:])] if len(keys) else []
        return pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(parts, pa.binary())], ["word", "cells"])

    def merge(parts):
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def run(batches):
        lookup, label, further = share.value
        parts, held = [], 0
        for b in batches:
            data, offsets = text_buffers(b.column(text))
            for i, j in doc_slices(offsets):
                h, ending, bounds = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                seq, before, ends = lookup.sequences(h, ending, bounds)
                is_word = np.ones(len(seq), bool)
                is_word[ends] = False
                word = np.minimum(np.searchsorted(further, h), len(further) - 1)
                hit = further[word] == h
                at, word = np.flatnonzero(is_word)[hit], word[hit] * 2 * k
                parts.append(np.unique(np.concatenate([word + label[before[at]], word + k + label[seq[at + 1]]]), return_counts=True))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [merge(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield give(*parts[0])
                        parts, held = [], 0
        if held:
            yield give(*merge(parts))

    return mapped(docs.select(text), run, "word int, cells binary")


def best_classes(contexts: DataFrame, now: np.ndarray, g: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word of ``word_contexts``, from the class bigrams ``g``, to which each still adds by its class ``now``.

    The likelihood of the word and of its neighbours, given the classes' counts without the word.
    """
    k = len(g)
    share = (g.sum(0) + 0.5) / (g.sum() + 0.5 * k)
    rows, cols = g.sum(1), g.sum(0)
    table = np.log((g + OWN_SHARE * share) / (rows[:, None] + OWN_SHARE))

    def choose(batches):
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                word, lists = part.column("word").to_numpy(), part.column("cells").to_pylist()
                raw = [np.frombuffer(b"".join(x), np.int64) for x in lists]
                cells = np.concatenate(raw)
                row = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
                both = np.bincount(row * 2 * k + (cells >> 40), cells & ((1 << 40) - 1), len(raw) * 2 * k).reshape(-1, 2 * k)
                left, right = both[:, :k], both[:, k:]
                n, a = right.sum(1), now[word]
                like = left @ table[:, :classes] + right @ table[:classes].T - n[:, None] * np.log(cols[:classes] + n[:, None])
                # The word's own class, without the word.
                ahead = np.log((np.maximum(g[a] - right, 0) + OWN_SHARE * share) / (np.maximum(rows[a] - n, 0)[:, None] + OWN_SHARE))
                back = np.log((np.maximum(g[:, a].T - left, 0) + OWN_SHARE * share[a][:, None]) / (np.maximum(rows - left, 0) + OWN_SHARE))
                like[np.arange(len(a)), a] = (right * ahead).sum(1) + (left * back).sum(1) - n * np.log(np.maximum(cols[a], n))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(like.argmax(1).astype(np.int32))], ["word", "class"])

    got = mapped(contexts.groupBy("word").agg(F.collect_list("cells").alias("cells")), choose, "word int, class int").toArrow()
    out = now.copy()
    out[got["word"].to_numpy()] = got["class"].to_numpy()
    return out


def class_bigrams(docs: DataFrame, lookup: Lookup, label: np.ndarray, k: int, text: str = "text") -> np.ndarray:
    share = docs.sparkSession.sparkContext.broadcast((lookup, label))

    def run(batches):
        lookup, label = share.value
        g = np.zeros(k * k, np.int64)
        for b in batches:
            data, offsets = text_buffers(b.column(text))
            for i, j in doc_slices(offsets):
                seq, before, _ = lookup.sequences(*tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                g += np.bincount(label[before] * k + label[seq], minlength=k * k)
        at = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g[at])], ["pair", "n"])

    got = mapped(docs.select(text), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    g = np.zeros(k * k)
    g[got["pair"].to_numpy()] = got["n"].to_numpy()
    return g.reshape(k, k)


@dataclass
class Model:
    lookup: Lookup
    label: np.ndarray  # class of each item
    log_transition: np.ndarray  # log10, classes x classes
    log_emission: np.ndarray  # log10 of what a class's counts are divided by
    common: np.ndarray  # sorted hashes of the COMMON words
    common_counts: np.ndarray
    end_count: int
    n: int
    v: int


def _most_frequent(counts: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` words with their endings and counts, most frequent first.

    The least count comes from a histogram of counts in steps of a 16th of an octave, a thousand rows at any size, and of
    the step that fits in part, one of 4096 ranges of the words' hashes; the words are read by a filter on both, so no task
    sorts or holds more than its own.
    """
    most = COMMON if most is None else most
    step = F.floor(F.log2("count") * 16).cast("int")
    total, least, next_ = 0, None, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if total + r[1] > most:
            next_ = r[0]
            break
        total, least = total + r[1], r[0]
    taken = step >= least if least is not None else F.lit(False)
    if next_ is not None:  # of the step that doesn't fit as a whole, the ranges of hashes that do
        range_, upto = F.shiftright("word", 52), -(1 << 11)
        for r in sorted(counts.where(step == next_).groupBy(range_.alias("range")).count().collect()):
            total += r[1]
            if total > most:
                break
            upto = r[0] + 1
        taken = taken | ((step == next_) & (range_ < upto))
    top = counts.where(taken).select("word", "ending", "count").toArrow()
    word, ending, count = (top[c].to_numpy() for c in ("word", "ending", "count"))
    order = np.lexsort((word, -count))
    return word[order], ending[order], count[order]


def train(docs: DataFrame, text: str = "text", classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model and the table of all word counts (word, count), which scoring joins with the words that aren't common."""
    counts = cut(word_counts(docs, text))
    texts = docs.count()
    row = counts.agg(F.sum("count"), F.count("*")).first()
    n, v = (row[0] or 0) + texts, row[1] + (texts > 0)
    word, ending, count = _most_frequent(counts)
    lookup = Lookup(np.sort(word[:ITEMS]))
    m = lookup.end + 2
    bigrams = np.zeros(m * m)
    got = item_bigrams(docs, lookup, text).toArrow()
    bigrams[got["pair"].to_numpy()] = got["n"].to_numpy()
    bigrams = bigrams.reshape(m, m)
    label = exchange(bigrams, 2, classes)
    k = classes + 2
    onehot = np.zeros((m, k))
    onehot[np.arange(m), label] = 1
    g = onehot.T @ bigrams @ onehot
    order = ITEMS + np.flatnonzero(count[ITEMS:] >= LEAST)
    order = order[np.argsort(word[order])]
    classed = ending[:ITEMS]  # endings of the words that have a class of their own
    if len(order):
        further, by_now = word[order], label[len(lookup.words) + ending[order]]
        chosen = best_classes(word_contexts(docs, lookup, label, further, k, text), by_now, g, classes)
        names = np.concatenate([lookup.words, further])
        place = np.argsort(names)
        label = np.concatenate([np.concatenate([label[: len(lookup.words)], chosen])[place], label[len(lookup.words) :]])
        lookup = Lookup(names[place])
        classed = np.concatenate([classed, ending[order]])
        g = class_bigrams(docs, lookup, label, k, text)
    tokens_of = g.sum(0)
    # Distinct words of each class: the items that are words, and the other words by their ending.
    distinct = np.bincount(label[: len(lookup.words)], minlength=k).astype(float)
    by_ending = np.zeros(ENDINGS)
    for r in counts.groupBy("ending").count().collect():
        by_ending[r[0]] = r[1]
    by_ending -= np.bincount(classed, minlength=ENDINGS)
    np.add.at(distinct, label[len(lookup.words) : lookup.end], by_ending)
    distinct[label[lookup.end]] = texts > 0
    share = (tokens_of + 0.5) / (tokens_of[:-1].sum() + 0.5 * (k - 1))
    share[-1] = 0  # nothing precedes the beginning
    transition = (g + OWN_SHARE * share) / (g.sum(1, keepdims=True) + OWN_SHARE)
    order = np.argsort(word)
    model = Model(lookup, label, np.log10(np.maximum(transition, 1e-300)), np.log10(tokens_of + 0.5 * (distinct + 1)), word[order], count[order], texts, int(n), int(v))
    return model, counts.select("word", "count")


LOCAL = "r1 long, r2 long, word long, k long, n_tokens long, known long, base double, model double"


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """doc_id, ``keep``, n_tokens, n_known, train_tokens, base_score, score of every row.

    The parts of a row meet again by 128 bits of its own values, not by its place, so that any input and any task that runs
    again gives the same key; rows that are equal in all of these are added up as one and are given as often as they came.
    """
    base_total = float(np.log10(model.n + 0.5 * (model.v + 1)))
    end_known = model.end_count > 0
    rows = docs.select(F.col("doc_id"), *(keep or []), F.col(text).alias("_text"))
    names = [c for c in rows.columns if c != "_text"]
    own = [F.col(c) for c in rows.columns]
    rows = rows.select(F.xxhash64(*own, F.lit(1)).alias("r1"), F.xxhash64(F.lit(2), *own).alias("r2"), F.struct(*names).alias("row"), "_text")
    share = docs.sparkSession.sparkContext.broadcast(model)  # of a size that COMMON, ITEMS, ENDINGS and CLASSES bound

    def run(batches):
        m = share.value
        for b in batches:
            data, offsets = text_buffers(b.column("_text"))
            keys = np.stack([b.column("r1").to_numpy(), b.column("r2").to_numpy()])
            for i, j in doc_slices(offsets):
                h, ending, bounds = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                seq, before, ends = m.lookup.sequences(h, ending, bounds)
                cls, prev = m.label[seq], m.label[before]
                starts = bounds[:-1] + np.arange(j - i)
                model_part = np.add.reduceat(m.log_transition[prev, cls] - m.log_emission[cls], starts)
                at = np.minimum(np.searchsorted(m.common, h), max(0, len(m.common) - 1))
                is_common = m.common[at] == h if len(m.common) else np.zeros(len(h), bool)
                value = np.zeros(len(seq))
                known = np.zeros(len(seq), np.int64)
                is_word = np.ones(len(seq), bool)
                is_word[ends] = False
                value[np.flatnonzero(is_word)[is_common]] = np.log10(m.common_counts[at[is_common]] + 0.5)
                known[np.flatnonzero(is_word)[is_common]] = 1
                value[ends], known[ends] = np.log10(m.end_count + 0.5), end_known
                row = np.repeat(np.arange(j - i), np.diff(bounds))
                rare, rare_row = h[~is_common], row[~is_common]
                order = np.lexsort((rare, rare_row))
                rare, rare_row = rare[order], rare_row[order]
                new = np.append(True, (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])) if len(rare) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                k = np.diff(np.append(first, len(rare)))
                z, zf = np.zeros(len(first), np.int64), np.zeros(len(first))
                own = keys[:, i:j]
                numer = np.add.reduceat(value, starts)
                # A text's own row joins no word: it goes by a key of its own, so that these rows spread too.
                apart = (own[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)).view(np.int64)
                local = [*own, apart, np.zeros(j - i, np.int64), np.diff(bounds) + 1, np.add.reduceat(known, starts), numer, numer + model_part]
                tail = [*own[:, rare_row[first]], rare[first], k, z, z, zf, zf]
                columns = [pa.array(np.concatenate(c)) for c in zip(local, tail, strict=True)]
                carried = pa.concat_arrays([b.column("row").slice(i, j - i), pa.nulls(len(first), b.column("row").type)])
                yield pa.RecordBatch.from_arrays([*columns, carried], [*[x.split()[0] for x in LOCAL.split(", ")], "row"])

    schema = StructType([*StructType.fromDDL(LOCAL).fields, rows.schema["row"]])
    schema["row"].nullable = True
    parts = mapped(rows, run, schema).join(counts, "word", "left")
    c = F.coalesce("count", F.lit(0))
    numerator = F.when(F.col("k") > 0, F.col("k") * F.log10(c + F.lit(0.5))).otherwise(F.lit(0.0))
    sums = parts.groupBy("r1", "r2").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("k")).otherwise(F.lit(0))).cast("long").alias("n_known"),
        F.sum(F.col("base") + numerator).alias("base"),
        F.sum(F.col("model") + numerator).alias("model"),
        F.first("row", ignorenulls=True).alias("row"),
        F.count("row").alias("times"),
    )
    n = F.col("n_tokens") / F.col("times")
    out = sums.select(
        *[F.col("row")[c].alias(c) for c in names], n.cast("long").alias("n_tokens"), (F.col("n_known") / F.col("times")).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") / F.col("times") - n * F.lit(base_total)).alias("base_score"),
        (F.col("model") / F.col("times")).alias("score"), "times",
    )
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
