"""Relabelling of short or uninformative runs of windows, in order of size.

Runs that a rule lets go are taken by their neighbours, the shortest first (ties:
the leftmost): by both if these agree, else by the one whose label is the run's
cap, else by the longer one (ties: the left one). A neighbour with more clusters
than the run's cap can't take it; the run is raised to its cap instead. After
every change the runs are looked at anew, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

NO_CAP = 1 << 30


@dataclass
class Run:
    first: int
    stop: int
    n: int
    cap: int

    @property
    def size(self) -> int:
        return self.stop - self.first


def runs_of(labels: list[int], caps: list[int | None]) -> list[Run]:
    out: list[Run] = []
    for i, (n, c) in enumerate(zip(labels, caps, strict=True)):
        c = NO_CAP if c is None else c
        if out and out[-1].n == n:
            out[-1].stop, out[-1].cap = i + 1, min(out[-1].cap, c)
        else:
            out.append(Run(i, i + 1, n, c))
    return out


def joined(runs: list[Run]) -> list[Run]:
    """Runs in order, neighbours of one label fused."""
    out: list[Run] = []
    for r in sorted(runs, key=lambda r: r.first):
        if out and out[-1].n == r.n:
            out[-1].stop, out[-1].cap = r.stop, min(out[-1].cap, r.cap)
        else:
            out.append(r)
    return out


def _taken(runs: list[Run], i: int, both: Callable[[Run, Run], bool], one: Callable[[Run], bool]) -> list[Run] | str:
    """The runs after run i went to a neighbour; 'raised' if it got its cap instead, '' if nothing happens."""
    run = runs[i]
    left = runs[i - 1] if i else None
    right = runs[i + 1] if i + 1 < len(runs) else None
    if left and right and left.n == right.n:
        takers = [left, right] if both(left, right) else []
    elif left and right and (exact := [r for r in (left, right) if r.n == run.cap and one(r)]):
        takers = exact[:1]
    else:
        near = [r for r in (left, right) if r]
        wide = max(near, key=lambda r: r.size, default=None)  # the first of equals: the left one
        takers = [wide] if wide and one(wide) else []
    if not takers:
        return ""
    if takers[0].n > run.cap:
        if run.n == run.cap:
            return ""
        run.n = run.cap
        return "raised"
    whole = [*takers, run]
    new = Run(min(r.first for r in whole), max(r.stop for r in whole), takers[0].n, min(r.cap for r in whole))
    return sorted([r for r in runs if all(r is not w for w in whole)] + [new], key=lambda r: r.first)


def expand(labels: list[int], caps: list[int | None], goes: Callable[[Run], bool], both: Callable[[Run, Run], bool], one: Callable[[Run], bool]) -> list[int]:
    runs = runs_of(labels, caps)
    while True:
        changed = False
        for run in sorted(runs, key=lambda r: (r.size, r.first)):
            if not goes(run):
                continue
            i = next(i for i, r in enumerate(runs) if r is run)
            after = _taken(runs, i, both, one)
            if isinstance(after, list):
                runs, changed = after, True
                break
            changed = changed or after == "raised"
        if not changed:
            fused = joined(runs)
            if len(fused) == len(runs):
                break
            runs = fused
    out = [0] * len(labels)
    for r in runs:
        out[r.first : r.stop] = [r.n] * r.size
    return out


def collapse_outliers(labels: list[int], caps: list[int | None], most: int, least_around: int) -> list[int]:
    return expand(labels, caps, lambda r: r.size <= most, lambda a, b: a.size + b.size >= least_around, lambda r: r.size >= least_around)


def fill_uninformative(labels: list[int], caps: list[int | None]) -> list[int]:
    return expand(labels, caps, lambda r: r.n == 0, lambda a, b: True, lambda r: True)


def fill_holes(labels: list[int], most: int) -> list[int]:
    """Runs of at most ``most`` labels are filled, the shortest first (ties: the leftmost), neighbours of one size together.

    Both sides of one label give it; else the shorter side grows (ties: the left
    one); at an end the only side does.
    """
    labels = list(labels)
    while True:
        runs = runs_of(labels, [None] * len(labels))
        holes = [r for r in runs if r.size <= most]
        if not holes or len(runs) == 1:
            return labels
        hole = min(holes, key=lambda r: (r.size, r.first))
        last = at = next(i for i, r in enumerate(runs) if r is hole)
        while last + 1 < len(runs) and runs[last + 1].size == hole.size:
            last += 1
        left, right = runs[at - 1] if at else None, runs[last + 1] if last + 1 < len(runs) else None
        if left is None and right is None:
            return labels
        taker = right if left is None or (right is not None and right.size < left.size) else left
        labels[hole.first : runs[last].stop] = [taker.n] * (runs[last].stop - hole.first)
