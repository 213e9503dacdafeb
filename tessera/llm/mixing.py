"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every document is served from its source's queue; its size is its number of words. A queue is shuffled by the MD5 of the
document's id and text and replayed up to ``max_epochs`` times. As in fair queueing on links, what is served are packets
of at most ``PACKET`` words, so that a long document doesn't hold up its queue. A packet that ends after ``c`` words of its
queue has the virtual finish time ``c / target``. The packets of all sources are range-sorted by virtual finish time (equal
ones by source) and truncated where their running total reaches the budget; the packet that is served there is cut short.
A document gets the words of its packets before that point, so the mix has the budget's words exactly and each source is
within a packet of its share.

The running total is taken over counted ranges of finish times, split until the range with the budget's end holds at most
``EXACT`` packets; only those are sorted in one task. A queue's prefix sums come from 4096 ranges of the shuffle key, whose
totals are added up first, so only rows of one range meet in a task; rows of equal id and text are added up as one before.

Defined cases: null text has size 0 and is never taken; null sources are a source of their own, the last; documents
without words take nothing; a source without words has target 0; rows of one id are separate documents, ordered by the MD5
with their text; rows of equal id and text share what their packets get in an arbitrary order; a very long text counts and
is cut like any other and moves as one row; an empty table gives an empty mix; other columns are ignored, or passed on by
``mixed_documents`` (an existing column of a name that is added here is replaced in what is returned only if the caller
asks for that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, cut_small, resplit

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Words that are served at once.
PACKET = 64
#: Packets that one task sorts at most.
EXACT = 1 << 16
#: Hexadecimal digits of the shuffle key that name a range of it.
RANGE_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    key = F.md5(F.concat_ws(" ", *text).cast("binary"))
    return docs.select(
        F.struct(*carry).alias("_row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("_queue"),
        n_words(F.col("text")).alias("_size"),
        key.alias("_key"),
    ).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))


def targets(queues: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Water filling: (_queue, _source_size) to (_queue, _source_size, _target).

    Sources in order of their names get the weights in turn. A source can give at most ``max_epochs`` times its size;
    what it can't give is shared again by weight. In order of size over weight, the sources at their limit come first,
    so one pass over running sums finds the level. One row per source, however many documents there are.
    """
    by_name = Window.orderBy("_queue")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.col("_source_size") * max_epochs
    filled = queues.select("_queue", "_source_size", weight.alias("_weight"), cap.alias("_cap"))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_queue")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("_source_size").over(everything) * F.lit(share)
    filled = filled.withColumn(
        "_level", (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(rest)
    )
    free = F.col("_weight") * F.col("_level") < F.col("_cap")
    filled = filled.withColumn("_least", F.min(F.when(free, F.struct(F.col("_cap") / F.col("_weight"), "_queue", "_level"))).over(everything)["_level"])
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_weight") * F.col("_least"), F.col("_cap").cast("double")))
    return filled.select("_queue", "_source_size", target.alias("_target"))


def _ended(rows: DataFrame, ranges: DataFrame, *order: str) -> DataFrame:
    """The rows with their queue's numbers and _end: the words of the queue up to the end of each (of all its copies)."""
    inside = Window.partitionBy("_queue", "_range").orderBy("_key", *order).rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("_size") * F.col("_copies")
    return rows.join(ranges, ["_queue", "_range"]).withColumn("_end", F.col("_before") + F.sum(words).over(inside))


def _limits(ends: DataFrame, max_epochs: int, budget: int) -> DataFrame:
    """(_queue, _limit): how many words of each queue are served before the running total reaches the budget."""
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") * max_epochs - 1))
    one = ends.where("_size > 0 and _target > 0").select("*", copies.alias("_k"))
    # The copies of a document follow each other; then the queue is replayed.
    start = F.floor(F.col("_k") / F.col("_copies")) * F.col("_source_size") + F.col("_end") - F.col("_size") * (F.col("_copies") - F.col("_k") % F.col("_copies"))
    one = one.select("_queue", "_target", "_size", start.alias("_start"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / PACKET))).alias("_p"))
    words = F.least(F.lit(PACKET).cast("long"), F.col("_size") - F.col("_p") * PACKET)
    packets = one.select("_queue", "_target", words.alias("_words"), (F.col("_start") + F.col("_p") * PACKET + words).cast("long").alias("_to"))
    packets = packets.withColumn("_finish", F.col("_to") / F.col("_target"))
    low, width, before = 0.0, 1 / 64, 0
    inside, below = F.lit(True), F.lit(False)
    while True:  # the range of finish times in which the running total reaches the budget
        slot = F.least(F.floor((F.col("_finish") - F.lit(low)) / F.lit(width)), F.lit(4095)).cast("int")
        counted = sorted(packets.where(inside).groupBy(slot.alias("slot")).agg(F.sum("_words").alias("words"), F.count("*").alias("n")).collect())
        if not counted:
            return packets.select("_queue", F.col("_to").alias("_limit")).limit(0)
        at = 0
        while at + 1 < len(counted) and before + counted[at]["words"] < budget:
            before += counted[at]["words"]
            at += 1
        first = counted[at]["slot"]
        below, inside = below | (inside & (slot < first)), inside & (slot == first)
        if counted[at]["n"] <= EXACT or low + width == low or first == 4095:
            break
        low, width = low + first * width, width / 4096
    running = F.lit(before) + F.sum("_words").over(Window.orderBy("_finish", "_queue", "_to").rowsBetween(Window.unboundedPreceding, -1))
    last = packets.where(inside).withColumn("_left", F.lit(budget) - F.coalesce(running, F.lit(before))).where("_left > 0")
    last = last.select("_queue", (F.col("_to") - F.col("_words") + F.least("_words", "_left")).alias("_limit"))
    whole = packets.where(below).groupBy("_queue").agg(F.max("_to").alias("_limit"))
    return whole.union(last).groupBy("_queue").agg(F.max("_limit").alias("_limit"))


def _served(docs: DataFrame, weights, max_epochs: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Documents without their texts, with _end, and the table of (_queue, _range, _before, _source_size, _target, _limit)."""
    rows = _keyed(docs, ["doc_id"]).groupBy("_row", "_queue", "_key", "_size", "_range").agg(F.count("*").alias("_copies"))
    rows = cut(rows)
    ranges = rows.groupBy("_queue", "_range").agg(F.sum(F.col("_size") * F.col("_copies")).alias("_words"))
    sizes = ranges.groupBy("_queue").agg(F.sum("_words").alias("_source_size"))
    per_queue = targets(sizes, weights, max_epochs, share)
    running = Window.partitionBy("_queue").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_queue", "_range", F.coalesce(F.sum("_words").over(running), F.lit(0)).alias("_before"))
    ranges = cut_small(ranges.join(per_queue, "_queue"))
    ends = cut(_ended(rows, resplit(ranges)))
    budget = sizes.agg(F.floor(F.sum("_source_size") * F.lit(share)).cast("long")).first()[0] or 0
    limits = _limits(ends, max_epochs, int(budget))
    return ends, cut_small(ranges.join(limits, "_queue", "left").withColumn("_limit", F.coalesce("_limit", F.lit(0)).cast("long")))


def _deliveries(max_epochs: int, copy: Column, copies: Column) -> Column:
    """Array of (epoch, finish, words) of what is served of one copy of a row: its part in each replay of the queue."""

    def delivery(epoch: Column) -> Column:
        start = epoch * F.col("_source_size") + F.col("_end") - F.col("_size") * (copies - copy)
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_limit") - start))
        return F.struct(epoch.alias("epoch"), F.try_divide(start + F.col("_size"), F.col("_target")).alias("finish"), words.alias("words"))

    made = F.array(*[delivery(F.lit(k).cast("long")) for k in range(max_epochs)])
    return F.filter(made, lambda d: d["words"] > 0)


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, finish (of its first delivery; null if none), in the order
    of the mix: range-sorted by finish, what isn't taken last."""
    ends, ranges = _served(docs, weights, max_epochs, share)
    rows = ends.join(resplit(ranges.select("_queue", "_range", "_limit")), ["_queue", "_range"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    rows = rows.withColumn("_deliveries", _deliveries(max_epochs, F.col("_copy"), F.col("_copies")))
    taken = F.aggregate("_deliveries", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    out = rows.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), taken.alias("taken"), F.try_element_at("_deliveries", F.lit(1))["finish"].alias("finish"),
    )
    return out.orderBy(F.asc_nulls_last("finish"), "doc_id")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every delivery, in the order of virtual finish times.

    A delivery that is cut short keeps its first words and the white space before them.
    """
    _, ranges = _served(docs, weights, max_epochs, share)
    rows = _keyed(docs, docs.columns).withColumn("_copies", F.lit(1).cast("long"))
    rows = _ended(rows, resplit(ranges)).withColumn("_d", F.explode(_deliveries(max_epochs, F.lit(0), F.lit(1))))
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    short = F.array_join(F.slice(pieces, 1, F.greatest(F.col("_d.words"), F.lit(1)).cast("int")), "")
    text = F.when(F.col("_d.words") < F.col("_size"), short).otherwise(F.col("_row.text"))
    names = docs.columns
    kept = [
        text.alias("text") if c == "text" else F.when(F.col("_d.words") < F.col("_size"), F.length(text)).otherwise(F.col("_row.n_chars")).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c)
        for c in names
    ]
    return rows.orderBy("_d.finish", "_key", "_d.epoch").select(*kept)
