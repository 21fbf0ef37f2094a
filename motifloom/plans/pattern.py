"""Query patterns: small undirected graphs, optionally with vertex labels. Driver-side only."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

#: Vertices that an adjacency-matrix pattern may have.
MOST_VERTICES = 64

# The workload's adjacency matrices, row by row.
WORKLOAD = {
    "p1": "0111101111011110",
    "p2": "0110010111110110110001100",
    "p3": "0110010111110110110101110",
    "p4": "0111110111110111110111110",
    "p5": "011111101111110110111000111000110000",
    "p6": "011110101101110011110000101000011000",
    "p7": "011110101011110010100001111000010100",
    "p8": "0111111101111111011111110111111101111111001111100",
}

# Named shapes as (vertices, edges).
SHAPES = {
    "triangle": (3, [(0, 1), (0, 2), (1, 2)]),
    "rectangle": (4, [(0, 1), (0, 2), (1, 3), (2, 3)]),
    "diamond": (4, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]),
    "pentagon": (5, [(0, 1), (0, 2), (1, 3), (2, 4), (3, 4)]),
    "house": (5, [(0, 1), (0, 2), (0, 3), (1, 3), (1, 4), (2, 4)]),
    "hourglass": (6, [(0, 1), (0, 2), (0, 4), (1, 2), (1, 5), (2, 3), (3, 4), (3, 5), (4, 5)]),
    "cycle_6_tri": (6, [(0, 1), (0, 2), (1, 2), (1, 3), (1, 4), (2, 3), (2, 5), (0, 4), (0, 5)]),
    "clique_7_minus": (7, [(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3), (0, 4), (1, 4), (2, 4), (3, 4), (0, 5), (1, 5), (2, 5), (3, 5), (4, 5), (0, 6), (1, 6), (2, 6), (3, 6), (4, 6)]),
}
ALIASES = {"qg3": "diamond", "prism": "hourglass"}


def _pair(a: int, b: int) -> tuple[int, int]:
    return (a, b) if a < b else (b, a)


@dataclass(frozen=True)
class Pattern:
    """``edges``: pairs (a, b) with a < b. ``labels``: one for each vertex, None for any, or None without labels."""

    n: int
    edges: frozenset[tuple[int, int]]
    labels: tuple[int | None, ...] | None = None

    def __post_init__(self):
        if self.n < 1 or self.n > MOST_VERTICES:
            raise ValueError(f"a pattern has 1 to {MOST_VERTICES} vertices")
        if any(not 0 <= a < b < self.n for a, b in self.edges):
            raise ValueError("edges must be pairs a < b of the pattern's vertices")
        if self.labels is not None and len(self.labels) != self.n:
            raise ValueError("one label for each vertex, please")

    @staticmethod
    def of(n: int, edges: Iterable[Sequence[int]], labels: Sequence[int | None] | None = None) -> Pattern:
        edges = [tuple(e) for e in edges]
        if any(a == b for a, b in edges):
            raise ValueError("a pattern has no loops")
        return Pattern(n, frozenset(_pair(a, b) for a, b in edges), tuple(labels) if labels is not None else None)

    @staticmethod
    def from_matrix(matrix: str, labels: Sequence[int | None] | None = None) -> Pattern:
        """From an adjacency matrix, row by row, as a string of 0 and 1; at least 3 vertices."""
        n = math.isqrt(len(matrix))
        if n * n != len(matrix) or n < 3 or set(matrix) - {"0", "1"}:
            raise ValueError("a matrix of 0 and 1 for at least 3 vertices is needed")
        cell = lambda a, b: matrix[a * n + b] == "1"
        if any(cell(a, a) for a in range(n)) or any(cell(a, b) != cell(b, a) for a in range(n) for b in range(a)):
            raise ValueError("the matrix must be symmetric with an empty diagonal")
        return Pattern.of(n, [(a, b) for a in range(n) for b in range(a + 1, n) if cell(a, b)], labels)

    @staticmethod
    def named(name: str) -> Pattern:
        """A shape of SHAPES, one of p1 to p8, or clique4, clique5 and so on."""
        name = ALIASES.get(name.lower(), name.lower())
        if name in WORKLOAD:
            return Pattern.from_matrix(WORKLOAD[name])
        if name in SHAPES:
            n, edges = SHAPES[name]
            return Pattern.of(n, edges)
        if name.startswith("clique") and name[6:].isdigit():
            return Pattern.clique(int(name[6:]))
        raise ValueError(f"no pattern is called {name}")

    @staticmethod
    def clique(n: int) -> Pattern:
        return Pattern.of(n, itertools.combinations(range(n), 2))

    @staticmethod
    def parse_file(text: str, labelled: bool = True) -> list[Pattern]:
        """Patterns of a query file: their number, and for each ``n m``, a line of labels if ``labelled``, and m lines ``u v``."""
        numbers = iter(map(int, text.split()))
        out = []
        try:
            for _ in range(next(numbers)):
                n, m = next(numbers), next(numbers)
                labels = [next(numbers) for _ in range(n)] if labelled else None
                out.append(Pattern.of(n, [(next(numbers), next(numbers)) for _ in range(m)], labels))
        except (StopIteration, RuntimeError) as end:
            raise ValueError("the query file ends too early") from end
        return out

    def to_file(self) -> str:
        """The query file of this pattern alone; each edge in both directions, unlabelled vertices as 0."""
        lines = sorted([*self.edges, *((b, a) for a, b in self.edges)])
        labels = [v or 0 for v in self.labels or [0] * self.n]
        return "\n".join(["1", f"{self.n} {len(lines)}", " ".join(map(str, labels)), *(f"{a} {b}" for a, b in lines)]) + "\n"

    def to_matrix(self) -> str:
        return "".join("01"[self.has(a, b)] for a in range(self.n) for b in range(self.n))

    def has(self, a: int, b: int) -> bool:
        return _pair(a, b) in self.edges

    def neighbours(self, a: int) -> list[int]:
        return [b for b in range(self.n) if b != a and self.has(a, b)]

    def degree(self, a: int) -> int:
        return len(self.neighbours(a))

    def label(self, a: int) -> int | None:
        return self.labels[a] if self.labels else None

    def with_edge(self, a: int, b: int) -> Pattern:
        return Pattern.of(self.n, [*self.edges, (a, b)], self.labels)

    def without_edge(self, a: int, b: int) -> Pattern:
        return Pattern(self.n, self.edges - {_pair(a, b)}, self.labels)

    def with_labels(self, labels: Sequence[int | None]) -> Pattern:
        return Pattern(self.n, self.edges, tuple(labels))

    def ordered(self, order: Sequence[int]) -> Pattern:
        """The same pattern with vertex order[k] called k."""
        place = {v: k for k, v in enumerate(order)}
        return Pattern.of(self.n, [(place[a], place[b]) for a, b in self.edges], [self.labels[v] for v in order] if self.labels else None)

    def connected(self) -> bool:
        seen, queue = {0}, [0]
        while queue:
            for b in self.neighbours(queue.pop()):
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        return len(seen) == self.n

    def isomorphs(self) -> set[frozenset[tuple[int, int]]]:
        """The different edge sets that relabelling its vertices gives."""
        return {self.ordered(p).edges for p in itertools.permutations(range(self.n))}

    def canonical(self) -> tuple[tuple[int, int], ...]:
        """The least of the sorted edge lists of all relabellings."""
        return min(tuple(sorted(e)) for e in self.isomorphs())


def is_acyclic(n: int, arcs: Iterable[tuple[int, int]]) -> bool:
    """Whether directed edges have no cycle."""
    into = {v: set() for v in range(n)}
    for a, b in arcs:
        into[b].add(a)
    while into:
        free = [v for v, before in into.items() if not before]
        if not free:
            return False
        for v in free:
            del into[v]
        for before in into.values():
            before.difference_update(free)
    return True


def motifs(n: int) -> list[Pattern]:
    """All connected graphs of n vertices, one of each shape, by number of edges."""
    pairs = list(itertools.combinations(range(n), 2))
    seen: set[frozenset[tuple[int, int]]] = set()
    out = []
    for m in range(n - 1, len(pairs) + 1):
        for edges in itertools.combinations(pairs, m):
            one = Pattern(n, frozenset(edges))
            if one.edges not in seen and one.connected():
                seen |= one.isomorphs()
                out.append(one)
    return out
