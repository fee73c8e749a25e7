"""Regions: runs of windows with one number of clusters, over gaps that windows still bridge."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Region:
    #: Window numbers that the region's range spans, first to stop.
    first: int
    stop: int
    n_clusters: int
    #: The windows of the range with the region's number of clusters.
    windows: tuple[int, ...]


def range_stop(starts: list[int], labels: list[int], first: int, size: int, overlap: int) -> int:
    """Where a region's range ends: behind the first differing window after the last matching one."""
    n, reach, stop = labels[first], starts[first], None
    for i in range(first + 1, len(labels)):
        if labels[i] == n:
            reach, stop = starts[i], None
            continue
        if stop is None:
            stop = i + 1
        if n == 0 or reach + size <= starts[i] + overlap:
            break
    return len(labels) if stop is None else stop


def suppressed(starts: list[int], labels: list[int], at: int, size: int, overlap: int, ends: dict[int, int]) -> int:
    """The next window to look at, beyond windows that an earlier region of their label already covers."""
    n = labels[at]
    if n not in ends or starts[at] >= ends[n]:
        return at
    stop = at
    while stop < len(labels) and labels[stop] == n and starts[stop] < ends[n]:
        stop += 1
    ends[n] = starts[stop - 1] + size - overlap
    return stop


def advanced(starts: list[int], labels: list[int], at: int, stop: int, size: int, overlap: int, ends: dict[int, int]) -> int:
    """Behind the leading run of equal labels; if others follow in the range, its end is remembered."""
    end = at
    while end < stop and labels[end] == labels[at]:
        end += 1
    if end < stop and labels[at] > 0:
        ends[labels[at]] = starts[end - 1] + size - overlap
    return end


def regions(starts: list[int], labels: list[int], size: int, overlap_share: float = 1.0, uninformative: bool = False) -> list[Region]:
    """All regions, in order; windows without clusters give one each if asked for."""
    overlap = int(size * overlap_share)
    out, ends, at = [], {}, 0
    while at < len(labels):
        further = suppressed(starts, labels, at, size, overlap, ends) if labels[at] else at
        if further != at:
            at = further
            continue
        stop = range_stop(starts, labels, at, size, overlap)
        n = labels[at]
        same = tuple(i for i in range(at, stop) if labels[i] == n)
        if n:
            out.append(Region(at, stop, n, same))
        elif uninformative:
            out += [Region(i, i + 1, 0, (i,)) for i in same]
        at = advanced(starts, labels, at, stop, size, overlap, ends)
    return out
