"""Budgeted search for SQL candidates: the control of what is tried next. Drafting and scoring are the caller's."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    id: int
    parent: int | None
    action: str
    depth: int
    sql: str
    score: float
    result: str | None = None  # fingerprint of the result, None if it failed
    findings: list[str] = field(default_factory=list)


@dataclass
class SearchOptions:
    strategy: str = "abmcts"  # single, best_of_n, refine, abmcts
    budget: int = 16
    early_stop: float = 0.9
    agree: int = 2
    min_nodes: int = 4
    actions: tuple[str, ...] = ("tight", "wide")
    seed: int = 0


#: (parent or None, action) -> SQL; SQL -> (score, result, findings).
Draft = Callable[[Node | None, str], str]
Score = Callable[[str], tuple[float, str | None, list[str]]]


class Search:
    def __init__(self, draft: Draft, score: Score, opts: SearchOptions | None = None):
        self.draft, self.score, self.opts = draft, score, opts or SearchOptions()
        self.nodes: list[Node] = []
        self.rng = np.random.default_rng(self.opts.seed)

    def _try(self, parent: Node | None, action: str) -> Node:
        """A failure of the drafting or scoring is a node with score 0."""
        sql = ""
        try:
            sql = self.draft(parent, action)
            score, result, findings = self.score(sql)
        except Exception as e:
            score, result, findings = 0.0, None, [str(e)]
        node = Node(len(self.nodes), parent.id if parent else None, action, parent.depth + 1 if parent else 0, sql, score, result, findings)
        self.nodes.append(node)
        return node

    def agreed(self) -> bool:
        """Whether enough different good candidates give one result; equal texts count once."""
        if len(self.nodes) < self.opts.min_nodes:
            return False
        good = {(n.result, re.sub(r"\s+", " ", n.sql.strip())) for n in self.nodes if n.score >= self.opts.early_stop and n.result}
        return max(Counter(r for r, _ in good).values(), default=0) >= self.opts.agree

    def run(self) -> list[Node]:
        getattr(self, f"_{self.opts.strategy}")()
        return self.nodes

    def _single(self) -> None:
        self._try(None, "wide")

    def _best_of_n(self) -> None:
        while len(self.nodes) < self.opts.budget and not self.agreed():
            self._try(None, self.opts.actions[len(self.nodes) % len(self.opts.actions)])

    def _refine(self) -> None:
        last: Node | None = None
        while len(self.nodes) < self.opts.budget and not (last and last.score >= self.opts.early_stop):
            last = self._try(last, "wide" if last is None or any("unknown" in f for f in last.findings) else "tight")

    def _abmcts(self) -> None:
        """Adaptive branching: from the root down, Thompson sampling decides between a new child and each existing one, by scores seen below."""
        kids: dict[int | None, list[Node]] = {}
        while len(self.nodes) < self.opts.budget and not self.agreed():
            at: Node | None = None
            while True:
                own = kids.get(at.id if at else None, [])
                arms = [("new", self._sample([k.score for k in own]))] + [(k, self._sample(self._below(k, kids))) for k in own]
                pick = max(arms, key=lambda a: a[1])[0]
                if pick == "new":
                    break
                at = pick
            best = max(self.opts.actions, key=lambda a: self._sample([n.score for n in self.nodes if n.action == a]))
            node = self._try(at, best)
            kids.setdefault(at.id if at else None, []).append(node)

    def _below(self, n: Node, kids: dict) -> list[float]:
        return [n.score, *[s for k in kids.get(n.id, []) for s in self._below(k, kids)]]

    def _sample(self, scores: list[float]) -> float:
        return float(self.rng.beta(1 + sum(scores), 1 + sum(1 - s for s in scores)))
