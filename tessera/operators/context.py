"""Evidence packs: what a question's answer may cite, within a budget of tokens; and how well packs do."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate

SPLIT = {"synthesis": 0.18, "claims": 0.30, "passages": 0.34, "papers": 0.10, "relations": 0.08}
PER_TOKEN, BORROW, EVIDENCE, COUNTER_SHARE = 4, 1.5, 0.82, 0.2
DEFAULT_BUDGET, LEAST_EVIDENCE, PER_PAPER = 8000, 400, 3


def tokens(text: str, per_token: int = PER_TOKEN) -> int:
    return len(text) // per_token + 1


@dataclass
class Budget:
    """Shares of a total; a section may go to 1.5 times its share as long as the total isn't spent."""

    total: int
    split: dict[str, float] = field(default_factory=lambda: dict(SPLIT))
    per_token: int = PER_TOKEN

    def __post_init__(self):
        whole = sum(self.split.values()) or 1.0
        self.limits = {k: int(self.total * (v / whole)) for k, v in self.split.items()}
        self.used = dict.fromkeys(self.split, 0)
        self.borrowed: dict[str, int] = {}

    def take(self, section: str, text: str) -> bool:
        cost = tokens(text, self.per_token)
        after = self.used[section] + cost
        if after > self.limits[section]:
            if after > int(self.limits[section] * BORROW) or sum(self.used.values()) + cost > self.total:
                return False
            self.borrowed[section] = self.borrowed.get(section, 0) + cost
        self.used[section] = after
        return True


def budget_prefix(rows: DataFrame, text: Column, group: list[str], order: list[Column], budget: int) -> DataFrame:
    """The first rows of each group, up to the first that would go over the budget."""
    spent = F.sum("tokens").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("tokens", token_estimate(text)).withColumn("spent", spent).where(F.col("spent") <= budget)


def truncated(rows: DataFrame, text: str, group: list[str], order: list[Column], most: int) -> DataFrame:
    """Per group: n_kept, n_chars, truncated. The first row that would go over ``most`` characters and all behind it go."""
    total = F.sum(F.length(text)).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_total", total).withColumn("_in", F.col("_total") <= most)
    return rows.groupBy(*group).agg(
        F.count_if("_in").alias("n_kept"), F.coalesce(F.max(F.when(F.col("_in"), F.col("_total"))), F.lit(0)).cast("long").alias("n_chars"),
        (F.count_if(~F.col("_in")) > 0).alias("truncated"),
    )


@dataclass
class Evidence:
    """Ranked, bounded rows of one question, already on the driver."""

    claims: list[dict] = field(default_factory=list)
    passages: list[dict] = field(default_factory=list)
    papers: list[dict] = field(default_factory=list)
    topics: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    counter: list[dict] = field(default_factory=list)
    followups: list[dict] = field(default_factory=list)


def pack(question: str, evidence: Evidence, budget_tokens: int = DEFAULT_BUDGET) -> tuple[str, dict]:
    """A Markdown pack of at most ``budget_tokens``, and what went into it.

    A fifth of the claims' share is kept for counter-evidence. A list ends at its first row that doesn't fit.
    """
    budget = Budget(max(LEAST_EVIDENCE, int(budget_tokens * EVIDENCE)))
    sections: list[tuple[str, list[str]]] = []
    used: dict[str, list] = {}

    def fill(title: str, share: str, rows: list[dict], key: str, stop: bool = True, limit: float | None = None) -> None:
        made, ids, start = [], [], budget.used[share]
        for r in rows:
            text = r["text"]
            over = limit is not None and budget.used[share] - start + tokens(text) > limit
            if over or not budget.take(share, text):
                if stop:
                    break
                continue
            made.append(text)
            ids.append(r[key])
        used[title] = ids
        if made:
            sections.append((title, made))

    reserve = int(budget.limits["claims"] * COUNTER_SHARE) if evidence.counter else 0
    fill("Syntheses", "synthesis", evidence.topics, "id")
    fill("Claims", "claims", evidence.claims, "id", limit=budget.limits["claims"] - reserve if reserve else None)
    included = set(used["Claims"])
    fill("Counter-evidence", "claims", [c for c in evidence.counter if c["id"] not in included], "id")
    fill("Passages", "passages", evidence.passages, "id")
    fill("Papers", "papers", evidence.papers, "id")
    fill("Relations", "relations", evidence.relations, "id")
    if evidence.followups:
        sections.append(("Where to look next", [r["text"] for r in evidence.followups]))
    warnings = [] if evidence.claims else ["no claims matched: this pack rests on passages only"]

    def render() -> str:
        return "\n\n".join([f"# {question}", *[f"## {title}\n\n" + "\n\n".join(rows) for title, rows in sections if rows]])

    # Trimming: from the least important end, down to two claims and one counter-example.
    floor = {"Claims": 2, "Counter-evidence": 1}
    for title in ("Where to look next", "Relations", "Papers", "Passages", "Syntheses", "Counter-evidence", "Claims"):
        rows = dict(sections).get(title, [])
        while tokens(render()) > budget_tokens and len(rows) > floor.get(title, 0):
            rows.pop()
    text = render()
    return text, {"budget_tokens": budget_tokens, "tokens": tokens(text), "used": budget.used, "borrowed": budget.borrowed, "included": used, "warnings": warnings}


def recall(expected: DataFrame, found: DataFrame, question: str, item: str) -> DataFrame:
    """(question, expected, hits, recall) per question."""
    hit = found.select(question, item, F.lit(1).alias("hit")).distinct()
    rows = expected.select(question, item).distinct().join(hit, [question, item], "left")
    out = rows.groupBy(question).agg(F.count("*").alias("expected"), F.count("hit").alias("hits"))
    return out.withColumn("recall", F.col("hits") / F.col("expected"))


def evaluate(text: str, strategy: dict, question: dict) -> dict:
    """Whether a pack has the papers, claims and terms a question expects, cites its blocks, and keeps its budget."""
    included = {i for ids in strategy["included"].values() for i in ids}

    def share(names: list, have) -> float:
        return sum(map(have, names)) / len(names) if names else 1.0

    blocks = [b for b in text.split("\n\n") if b and not b.startswith("#")]
    cites = len(re.findall(r"\[[^\]]+\]", text))
    out = {
        "id": question["id"],
        "paper_recall": share(question.get("expect_papers") or [], lambda p: any(str(i).startswith(str(p)) for i in included) or str(p) in text),
        "claim_recall": share(question.get("expect_claims") or [], lambda c: c in included),
        "term_coverage": share(question.get("must_include_terms") or [], lambda t: t.lower() in text.lower()),
        "citation_coverage": min(1.0, cites / len(blocks)) if blocks else 0.0,
        "counterevidence": bool(strategy["included"].get("Counter-evidence")) or not question.get("expect_counterevidence"),
        "within_budget": strategy["tokens"] <= 1.15 * (question.get("budget") or DEFAULT_BUDGET),
    }
    least = {"paper_recall": "min_paper_recall", "claim_recall": "min_claim_recall", "term_coverage": "min_term_coverage"}
    out["passed"] = all(out[k] >= question.get(name, 1.0) for k, name in least.items()) and out["counterevidence"] and out["within_budget"]
    return out
