"""Small-cell suppression of published counts, by rule and by proof. Works on tens of cells on the driver."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable, Sequence
from dataclasses import dataclass


def suppress(counts: dict[Hashable, int], margins: Sequence[Callable[[Hashable], Hashable]], least: int = 5) -> set:
    """Cells to hide: those below ``least``, and in every margin group with exactly one hidden cell its smallest
    shown one too (ties by repr), until no group is left with a single hidden cell."""
    hidden = {k for k, n in counts.items() if n < least}
    groups = []
    for margin in margins:
        by = defaultdict(list)
        for k in counts:
            by[margin(k)].append(k)
        groups += by.values()
    while True:
        lone = next((g for g in groups if sum(k in hidden for k in g) == 1 and any(k not in hidden for k in g)), None)
        if lone is None:
            return hidden
        hidden.add(min((k for k in lone if k not in hidden), key=lambda k: (counts[k], repr(k))))


@dataclass(frozen=True)
class Relation:
    """A published sum: the cells under it add up to ``total``."""

    cells: tuple
    total: int


class Attacker:
    """What a reader can work out about hidden cells: whole numbers >= 0 (with upper bounds, where known) that
    satisfy every published sum. Exact: depth-first over values with bound propagation."""

    def __init__(self, shown: dict[Hashable, int], hidden: Iterable[Hashable], relations: Iterable[Relation], upper: dict[Hashable, int] | None = None, budget: int = 200_000) -> None:
        self.hidden = tuple(sorted(set(hidden), key=repr))
        self.budget = budget
        unknown = set(self.hidden)
        self.equations = []
        for r in relations:
            free = tuple(c for c in r.cells if c in unknown)
            if free:
                self.equations.append((free, r.total - sum(shown[c] for c in r.cells if c not in unknown)))
        roof = max((t for _, t in self.equations), default=0)
        self.start = {c: (0, (upper or {}).get(c, roof)) for c in self.hidden}

    def _tighten(self, box: dict) -> dict | None:
        moved = True
        while moved:
            moved = False
            for cells, total in self.equations:
                low, high = sum(box[c][0] for c in cells), sum(box[c][1] for c in cells)
                if not low <= total <= high:
                    return None
                for c in cells:
                    lo, hi = box[c]
                    new = max(lo, total - (high - hi)), min(hi, total - (low - lo))
                    if new[0] > new[1]:
                        return None
                    if new != (lo, hi):
                        box[c] = new
                        low, high = low + new[0] - lo, high + new[1] - hi
                        moved = True
        return box

    def solution(self, fixed: dict[Hashable, int] | None = None) -> dict | None:
        """Some assignment of all hidden cells, or None if there is none."""
        box = dict(self.start)
        for c, v in (fixed or {}).items():
            lo, hi = box[c]
            if not lo <= v <= hi:
                return None
            box[c] = (v, v)
        steps = [0]

        def search(box: dict) -> dict | None:
            steps[0] += 1
            if steps[0] > self.budget:
                raise TimeoutError("too many cells for a proof")
            box = self._tighten(dict(box))
            if box is None:
                return None
            loose = [c for c, (lo, hi) in box.items() if lo < hi]
            if not loose:
                return {c: lo for c, (lo, _) in box.items()}
            c = min(loose, key=lambda k: (box[k][1] - box[k][0], repr(k)))
            for v in range(box[c][0], box[c][1] + 1):
                if found := search(box | {c: (v, v)}):
                    return found
            return None

        return search(box)

    def reach(self, cell: Hashable) -> tuple[int, int]:
        """Least and greatest value of a hidden cell over all assignments."""
        box = self._tighten(dict(self.start))
        if box is None:
            raise ValueError("the published sums contradict each other")
        lo, hi = box[cell]
        while self.solution({cell: lo}) is None:
            lo += 1
        while self.solution({cell: hi}) is None:
            hi -= 1
        return lo, hi


def ranges(counts: dict[Hashable, int], hidden: Iterable[Hashable], relations: Sequence[Relation], upper: dict | None = None) -> dict[Hashable, tuple[int, int]]:
    """The adversary's view: for each hidden cell the values it can have."""
    hidden = set(hidden)
    attacker = Attacker({k: n for k, n in counts.items() if k not in hidden}, hidden, relations, upper)
    return {c: attacker.reach(c) for c in attacker.hidden}


def protect(counts: dict[Hashable, int], groups: Sequence[Sequence[Hashable]], least: int = 5) -> set | None:
    """Cells to hide so that no hidden small cell can be worked out, proved; None: the whole table is withheld.

    groups: the sets of cells whose sums are published. Cells from 1 to ``least`` - 1 are hidden (a zero tells
    that nobody is there, as a small count does, and is hidden too). While a small cell has only one possible
    value, the smallest shown cell that shares a sum with it is hidden as well.
    """
    relations = [Relation(tuple(g), sum(counts[c] for c in g)) for g in groups]
    hidden = {k for k, n in counts.items() if n < least}
    small = set(hidden)
    while small:
        try:
            view = ranges(counts, hidden, relations)
        except TimeoutError:
            return None
        exposed = sorted((c for c in small if view[c][0] == view[c][1]), key=repr)
        if not exposed:
            return hidden
        near = {c for g in groups if exposed[0] in g for c in g} - hidden
        if not near:
            near = {c for g in groups if hidden & set(g) for c in g} - hidden
        if not near:
            return None
        hidden.add(min(near, key=lambda k: (counts[k], repr(k))))
    return hidden
