"""The graph of task types: who emits what, what a policy allows, where cycles are, what a boundary cuts off."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


class EmitNotAllowed(Exception):
    def __init__(self, source: str, target: str, allowed: Iterable[str]):
        super().__init__(f"task {source} may not emit {target}; allowed: {sorted(allowed)}")


class TaskGraph:
    def __init__(self) -> None:
        self.edges: dict[str, list[str]] = {}
        self.policy: dict[str, set[str]] = {}

    def declare(self, source: str, targets: Iterable[str]) -> None:
        for t in targets:
            self.check(source, t)
            if t not in self.edges.setdefault(source, []):
                self.edges[source].append(t)

    def allow(self, source: str, targets: Iterable[str]) -> None:
        self.policy[source] = set(targets)
        for t in self.edges.get(source, []):
            self.check(source, t)

    def check(self, source: str, target: str) -> None:
        """Types without a policy may emit anything."""
        if source in self.policy and target not in self.policy[source]:
            raise EmitNotAllowed(source, target, self.policy[source])

    def cycles(self) -> list[set[str]]:
        """Sets of types that reach each other (or themselves)."""
        reach = {n: self.downstream(n) for n in self.edges}
        out: list[set[str]] = []
        for n in self.edges:
            if n in reach[n]:
                group = {m for m in reach[n] if n in reach.get(m, set())}
                if group not in out:
                    out.append(group)
        return out

    def downstream(self, node: str) -> set[str]:
        """Everything that a type leads to; itself only by a cycle."""
        seen, todo = set(), list(self.edges.get(node, []))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += self.edges.get(n, [])
        return seen

    def order(self, nodes: Iterable[str]) -> list[str]:
        """Nodes with those first that no other one leads to; a cycle keeps the given order."""
        left, out = list(dict.fromkeys(nodes)), []
        while left:
            free = [n for n in left if not any(n in self.downstream(m) for m in left if m != n)] or left[:1]
            out += free
            left = [n for n in left if n not in free]
        return out

    def feeders(self, target: str) -> set[str]:
        """The types that a boundary at ``target`` still needs."""
        return {n for n in self.edges if target in self.downstream(n)}


def edge_rows(policy: Mapping[str, set[str]]) -> list[tuple[str, str]]:
    return [(a, b) for a, bs in policy.items() for b in sorted(bs)]
