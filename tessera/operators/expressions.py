"""Full-text expressions: AND, OR, NOT, brackets, "phrases", prefix*, column: and NEAR(a b, n), ranked by BM25."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import B, K1, Index, weighed

_PART = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)\b|NEAR\(([^)]*)\)|(?:(\w+)\s*:\s*)?(?:"([^"]*)"|([^\s()":]+?))(\s*\*)?(?=[\s()]|$))')
NEAR = 10


@dataclass(frozen=True)
class Leaf:
    """A phrase (or several that stand near one another), perhaps in one field, perhaps with an open last word."""

    phrases: tuple[tuple[str, ...], ...]
    field: str | None = None
    prefix: bool = False
    near: int | None = None


def _words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower()))


def parse(text: str):
    """A tree of ("and" | "or" | "not", left, right) and leaves. NOT binds closest, then AND (also by standing side by side), then OR."""
    parts, at = [], 0
    while at < len(text.rstrip()):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't be read from here: {text[at:]!r}")
        at = m.end()
        opened, closed, word, near, field, quoted, plain, star = m.groups()
        if near is not None:
            inside, _, n = near.partition(",")
            phrases = tuple(_words(a or b) for a, b in re.findall(r'"([^"]*)"|(\S+)', inside))
            parts.append(Leaf(phrases, None, False, int(n) if n.strip() else NEAR))
        else:
            parts.append("(" if opened else ")" if closed else word or Leaf((_words(quoted if quoted is not None else plain),), field, bool(star)))
    place = 0

    def peek():
        return parts[place] if place < len(parts) else None

    def take():
        nonlocal place
        place += 1
        return parts[place - 1]

    def one():
        part = take() if place < len(parts) else None
        if part == "(":
            inside = either()
            if peek() != ")":
                raise ValueError("a bracket is open")
            take()
            return inside
        if not isinstance(part, Leaf):
            raise ValueError(f"a term should stand where {part!r} is")
        return part

    def without():
        left = one()
        while peek() == "NOT":
            take()
            left = ("not", left, one())
        return left

    def both():
        left = without()
        while peek() == "AND" or isinstance(peek(), Leaf) or peek() == "(":
            if peek() == "AND":
                take()
            left = ("and", left, without())
        return left

    def either():
        left = both()
        while peek() == "OR":
            take()
            left = ("or", left, both())
        return left

    tree = either()
    if place < len(parts):
        raise ValueError(f"{parts[place]!r} is left over")
    return tree


def leaves(tree) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else leaves(tree[1]) + leaves(tree[2])


def _phrase(index: Index, words: tuple[str, ...], field: str | None, prefix: bool) -> DataFrame:
    """(keys, field, start, size) of each occurrence."""
    rows = index.postings if field is None else index.postings.where(F.col("field") == field)
    out = None
    for n, w in enumerate(words):
        hit = F.startswith("term", F.lit(w)) if prefix and n == len(words) - 1 else F.col("term") == w
        own = rows.where(hit).select(*index.keys, "field", F.explode("positions").alias("p")).select(*index.keys, "field", (F.col("p") - n).alias("start")).distinct()
        out = own if out is None else out.join(own, [*index.keys, "field", "start"])
    return out.withColumn("size", F.lit(len(words)))


def _occurrences(index: Index, leaf: Leaf) -> list[DataFrame]:
    """For each phrase of a leaf its (keys, field, start) that count."""
    found = [_phrase(index, w, leaf.field, leaf.prefix) for w in leaf.phrases]
    if leaf.near is None or len(found) == 1:
        return found
    on = [*index.keys, "field"]
    spans = found[0].select(*on, F.array(F.struct("start", "size")).alias("s"))
    for nxt in found[1:]:
        spans = spans.join(nxt, on).select(*on, F.array_append("s", F.struct("start", "size")).alias("s"))
    first, last = F.array_min(F.transform("s", lambda x: x["start"])), F.array_max(F.transform("s", lambda x: x["start"] + x["size"]))
    total = sum(len(w) for w in leaf.phrases)
    close = spans.where(last - first - total <= leaf.near)
    return [close.select(*on, F.col("s")[i]["start"].alias("start")).distinct() for i in range(len(found))]


def search(index: Index, text: str) -> DataFrame:
    """(keys, score) of the documents that an expression matches; smaller is better."""
    tree = parse(text)
    weight = F.coalesce(*[F.when(F.col("field") == c, F.lit(w)) for c, w in index.weights.items()])
    sets, hits = {}, None
    for n, leaf in enumerate(leaves(tree)):
        for k, occurrence in enumerate(_occurrences(index, leaf)):
            part = occurrence.groupBy(*index.keys).agg(F.sum(weight).alias("tf")).withColumn("phrase", F.lit(f"{n}.{k}"))
            hits = part if hits is None else hits.unionByName(part)
            own = part.select(*index.keys)
            sets[leaf] = own if k == 0 else sets[leaf].join(own, index.keys, "left_semi")

    def matching(node) -> DataFrame:
        if isinstance(node, Leaf):
            return sets[node].distinct()
        left, right = matching(node[1]), matching(node[2])
        return left.union(right).distinct() if node[0] == "or" else left.join(right, index.keys, "left_semi" if node[0] == "and" else "left_anti")

    frequency = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(weighed(index, frequency)), "phrase").join(matching(tree), index.keys, "left_semi").join(index.lengths, index.keys)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.col("mean_terms")))
    return scored.groupBy(*index.keys).agg((-F.sum(part)).alias("score"))
