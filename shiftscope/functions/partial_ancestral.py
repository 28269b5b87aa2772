"""Orientation of partial ancestral graphs: circle paths, tails, uncovered paths, and intervention nodes.

``marks[a, b]`` is the mark at b of the edge between a and b.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, permutations

TAIL, ARROW, CIRCLE = -1, 1, 2
Marks = dict[tuple[int, int], int]


def _near(marks: Marks, v: int) -> list[int]:
    return sorted(b for a, b in marks if a == v)


def uncovered_paths(marks: Marks, start: int, goal: int, step: Callable[[int, int], bool], first: int | None = None) -> Iterator[list[int]]:
    """Paths whose neighbours but one are not adjacent and whose every edge passes ``step``."""
    stack = [[start, w] for w in _near(marks, start) if (first is None or w == first) and step(start, w)]
    while stack:
        path = stack.pop()
        if path[-1] == goal:
            yield path
            continue
        for w in _near(marks, path[-1]):
            if w not in path and (path[-2], w) not in marks and step(path[-1], w):
                stack.append([*path, w])


def _circle(marks: Marks) -> Callable[[int, int], bool]:
    return lambda a, b: marks[a, b] == marks[b, a] == CIRCLE


def _possibly_directed(marks: Marks) -> Callable[[int, int], bool]:
    """Not into the nearer end, not out of the farther one."""
    return lambda a, b: marks[b, a] != ARROW and marks[a, b] != TAIL


def rule5(marks: Marks) -> bool:
    """An uncovered circle path around a circle edge, with ends that are not adjacent across it: all its edges are undirected."""
    for a, b in sorted(marks):
        if a < b and _circle(marks)(a, b):
            for path in uncovered_paths(marks, a, b, _circle(marks)):
                if len(path) >= 4 and (path[1], b) not in marks and (a, path[-2]) not in marks:
                    for x, y in (*zip(path, path[1:], strict=False), (a, b)):
                        marks[x, y] = marks[y, x] = TAIL
                    return True
    return False


def rule6(marks: Marks) -> bool:
    """a - b o-* c: the circle is a tail."""
    for b in {x for x, _ in marks}:
        for a, c in permutations(_near(marks, b), 2):
            if marks[a, b] == marks[b, a] == TAIL and marks[c, b] == CIRCLE:
                marks[c, b] = TAIL
                return True
    return False


def rule7(marks: Marks) -> bool:
    """a -o b o-* c with a and c not adjacent: the second circle is a tail."""
    for b in {x for x, _ in marks}:
        for a, c in permutations(_near(marks, b), 2):
            if marks[b, a] == TAIL and marks[a, b] == CIRCLE and marks[c, b] == CIRCLE and (a, c) not in marks:
                marks[c, b] = TAIL
                return True
    return False


def _half_arrows(marks: Marks) -> list[tuple[int, int]]:
    """Pairs with a o-> c."""
    return [(a, c) for a, c in sorted(marks) if marks[a, c] == ARROW and marks[c, a] == CIRCLE]


def rule8(marks: Marks) -> bool:
    """a -> b -> c or a -o b -> c, and a o-> c: a -> c."""
    for a, c in _half_arrows(marks):
        for b in _near(marks, a):
            if (b, c) in marks and marks[b, a] == TAIL and marks[a, b] in (ARROW, CIRCLE) and marks[c, b] == TAIL and marks[b, c] == ARROW:
                marks[c, a] = TAIL
                return True
    return False


def rule9(marks: Marks) -> bool:
    """a o-> c with an uncovered possibly directed path from a to c whose second node is not adjacent to c: a -> c."""
    for a, c in _half_arrows(marks):
        for path in uncovered_paths(marks, a, c, _possibly_directed(marks)):
            if len(path) >= 4 and (path[1], c) not in marks:
                marks[c, a] = TAIL
                return True
    return False


def rule10(marks: Marks) -> bool:
    """a o-> c, b -> c <- d, and uncovered possibly directed paths from a to b and to d whose second nodes differ and are not adjacent: a -> c."""
    step = _possibly_directed(marks)
    for a, c in _half_arrows(marks):
        into = [b for b in _near(marks, c) if marks[b, c] == ARROW and marks[c, b] == TAIL and b != a]
        firsts = {b: {p[1] for p in uncovered_paths(marks, a, b, step)} for b in into}
        for b, d in combinations(into, 2):
            if any(m != w and (m, w) not in marks for m in firsts[b] for w in firsts[d]):
                marks[c, a] = TAIL
                return True
    return False


def close(marks: Marks) -> Marks:
    """Apply rules 5 to 10 until nothing changes (rules 1 to 4 come first, in ``plans.constraint``)."""
    while any(rule(marks) for rule in (rule5, rule6, rule7, rule8, rule9, rule10)):
        pass
    return marks


def rule11(marks: Marks, interventions: set[int]) -> None:
    """Every edge at an intervention node points out of it."""
    for f in interventions:
        for v in _near(marks, f):
            if v not in interventions:
                marks[f, v], marks[v, f] = ARROW, TAIL


def rule12(marks: Marks, targets: dict[int, set[int]]) -> bool:
    """An intervention node with one known target a, adjacent to c too, and a joined to c: a -> c."""
    changed = False
    for f, known in targets.items():
        if len(known) != 1:
            continue
        (a,) = known
        for c in _near(marks, f):
            if c != a and (f, a) in marks and (a, c) in marks and (marks[a, c], marks[c, a]) != (ARROW, TAIL):
                marks[a, c], marks[c, a] = ARROW, TAIL
                changed = True
    return changed
