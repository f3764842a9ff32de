"""Which operator makes the next child: upper confidence over a tree of recent operators, kept on the driver.

The state is bounded by the catalogue (27 operators) to the power of the depth and usually far smaller; rewards are
computed in Spark (``reports.reward``) and only one number per child of a generation comes here. The state is plain
JSON, so a search that was stopped goes on with what it had learnt.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field


@dataclass
class Tally:
    visits: int = 0
    value: float = 0.0

    def add(self, reward: float) -> None:
        self.visits += 1
        self.value += reward

    @property
    def mean(self) -> float:
        return self.value / max(1, self.visits)


@dataclass
class Policy:
    """Nodes are paths of operators joined by ``/``; an island's path is what led to its last gain."""

    operators: list[str]
    depth: int = 3
    exploration: float = 1.4
    widen: bool = False
    plateau: int = 4
    standardise: bool = False
    nodes: dict[str, Tally] = field(default_factory=dict)
    edges: dict[str, dict[str, Tally]] = field(default_factory=dict)
    paths: dict[int, list[str]] = field(default_factory=dict)
    best_generation: int = 0
    seen: tuple[int, float, float] = (0, 0.0, 0.0)
    pending: dict[tuple[int, int, int], tuple[list[str], str]] = field(default_factory=dict)

    def choose(self, generation: int, island: int, child: int) -> str:
        """An operator that its node has not tried, else the one of highest upper confidence; ties go to the smaller id."""
        path = self.paths.get(island, [])[-self.depth :]
        tried, total = self.edges.get("/".join(path), {}), self.nodes.get("/".join(path), Tally()).visits
        known = sorted((o for o in tried if o in self.operators), key=lambda o: (-tried[o].mean, -tried[o].visits, o))
        allowed = known + sorted(o for o in self.operators if o not in tried)
        if self.widen:
            allowed = allowed[: max(1, math.isqrt(max(1, total))) + 1]
        waiting = {o for (g, i, _), (_, o) in self.pending.items() if (g, i) == (generation, island)}
        fresh = [o for o in allowed if o not in tried]
        if fresh:  # siblings of one generation try different operators while there are any
            pick = next((o for o in fresh if o not in waiting), fresh[0])
        else:
            stale = max(0, generation - self.best_generation)
            c = self.exploration * (1.0 + 0.2 * min(stale, 8)) if stale >= self.plateau else self.exploration
            pick = min(allowed, key=lambda o: (-(tried[o].mean + c * math.sqrt(math.log(max(1, total) + 1.0) / max(1, tried[o].visits))), o))
        self.pending[generation, island, child] = (path, pick)
        return pick

    def record(self, generation: int, island: int, child: int, reward: float, improved: bool, new_best: bool = False) -> float:
        """Adds a child's reward to every prefix of its path; unknown children are ignored. Returns the reward as counted."""
        action = self.pending.pop((generation, island, child), None)
        if action is None:
            return 0.0
        if new_best:
            self.best_generation = generation
        if self.standardise:
            n, mean, m2 = self.seen
            n, gap = n + 1, reward - mean
            mean += gap / n
            m2 += gap * (reward - mean)
            self.seen = (n, mean, m2)
            reward = max(-3.0, min(3.0, (reward - mean) / max(math.sqrt(m2 / (n - 1)) if n > 1 else 0.0, 0.02)))
        steps = [*action[0], action[1]][-self.depth :]
        for k, operator in enumerate(steps):
            at = "/".join(steps[:k])
            self.nodes.setdefault(at, Tally()).add(reward)
            self.edges.setdefault(at, {}).setdefault(operator, Tally()).add(reward)
        self.nodes.setdefault("/".join(steps), Tally()).add(reward)
        if improved or reward > 0:
            self.paths[island] = steps
        return reward

    def state(self) -> str:
        """All that the policy has learnt, as JSON; children that are still out are forgotten."""
        return json.dumps({k: v for k, v in asdict(self).items() if k != "pending"}, sort_keys=True)

    @classmethod
    def restore(cls, text: str, operators: list[str] | None = None) -> Policy:
        """A policy from :meth:`state`; operators that are no longer offered lose their tallies."""
        s = json.loads(text)
        out = cls(**{**s, "operators": operators or s["operators"], "nodes": {k: Tally(**v) for k, v in s["nodes"].items()}, "edges": {}, "paths": {int(k): v for k, v in s["paths"].items()}, "seen": tuple(s["seen"])})
        out.edges = {at: {o: Tally(**v) for o, v in own.items() if o in out.operators} for at, own in s["edges"].items()}
        return out
