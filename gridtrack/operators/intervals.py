"""Vectorised kernels on the frames of one component: what paths through an interval are worth.

A *pair* says what the paths from one element to another, some frames later, can
offer: whether one of them is clean (all weights 1), how late the heavy link of
one with a single link of weight 2 can be, the least distance, and among paths of
that distance the order of their weights read from the far end.  Pairs of two
neighbouring intervals multiply to the pairs of both, so intervals can be joined in
any order.  Applied to the plans at the end of an interval, pairs give the plans
at its beginning.  One link is a pair of length one, so the same two functions plan
single frames and whole series.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np

CLEAN, ONE_HEAVY, FALLBACK = 0, 1, 2
NOWHERE = -1


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First place of every run of equal keys."""
    changed = np.zeros(keys[0].size, dtype=bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def matches(keys: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``keys`` and in the ascending ``ordered`` of all equal pairs."""
    low, high = np.searchsorted(ordered, keys, "left"), np.searchsorted(ordered, keys, "right")
    n = high - low
    left = np.repeat(np.arange(keys.size), n)
    return left, np.arange(left.size) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def dense_rank(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Place of ``(high, low)`` among the distinct ones."""
    if not high.size:
        return high
    low = np.unique(low, return_inverse=True)[1]
    high = np.unique(high, return_inverse=True)[1]
    return np.unique(high * (low.max() + 1) + low, return_inverse=True)[1]


@dataclass
class Pairs:
    """Pairs from ``first`` to ``last``, in the order of ``first``; all span ``length`` frames."""

    length: int
    first: np.ndarray
    last: np.ndarray
    clean: np.ndarray
    one_at: np.ndarray  # frames before the heavy link of a path with just one of weight 2, -1 without such a path
    distance: np.ndarray
    order: np.ndarray

    @staticmethod
    def of_links(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> Pairs:
        by = np.argsort(src, kind="stable")
        src, dst, weight = src[by], dst[by], weight[by].astype(np.int64)
        return Pairs(1, src, dst, weight == 1, np.where(weight == 2, 0, -1), weight, weight)

    def take(self, which: np.ndarray) -> Pairs:
        return Pairs(self.length, *[getattr(self, f.name)[which] for f in fields(self)[1:]])


def product(a: Pairs, b: Pairs) -> Pairs:
    """Pairs over both intervals; ``a`` ends where ``b`` begins."""
    i, j = matches(a.last, b.first)
    first, last = a.first[i], b.last[j]
    clean = a.clean[i] & b.clean[j]
    one_at = np.maximum(np.where(a.clean[i] & (b.one_at[j] >= 0), a.length + b.one_at[j], -1), np.where(b.clean[j], a.one_at[i], -1))
    distance = a.distance[i] + b.distance[j]
    far, near = b.order[j], a.order[i]
    by = np.lexsort((-near, -far, distance, last, first))
    at = group_starts(first[by], last[by])
    best = by[at]
    if not best.size:
        return Pairs(a.length + b.length, first, last, clean, one_at, distance, far)
    return Pairs(a.length + b.length, first[best], last[best], np.logical_or.reduceat(clean[by], at),
                 np.maximum.reduceat(one_at[by], at), distance[best], dense_rank(far[best], near[best]))


@dataclass
class Plans:
    """What elements reach in their deepest frame, in the order of ``node``; elements not listed reach themselves."""

    node: np.ndarray
    depth: np.ndarray
    clean_end: np.ndarray
    light_end: np.ndarray
    end: np.ndarray
    distance: np.ndarray
    heavy_at: np.ndarray
    rank: np.ndarray

    @staticmethod
    def none() -> Plans:
        return Plans(*[np.zeros(0, dtype=np.int64)] * 8)

    def of(self, nodes: np.ndarray) -> Plans:
        if not self.node.size:
            found, at = np.zeros(nodes.size, dtype=bool), None
        else:
            at = np.minimum(np.searchsorted(self.node, nodes), self.node.size - 1)
            found = self.node[at] == nodes
        zero = np.zeros(nodes.size, dtype=np.int64)
        ends = (nodes, zero + 1, nodes, nodes, nodes, zero, zero, zero)
        if at is None:
            return Plans(*ends)
        return Plans(*[np.where(found, getattr(self, f.name)[at], end) for f, end in zip(fields(self), ends)])

    def columns(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    @staticmethod
    def joined(parts: list[Plans]) -> Plans:
        columns = [np.concatenate(c) for c in zip(*[p.columns() for p in parts])] if parts else Plans.none().columns()
        by = np.argsort(columns[0], kind="stable")
        return Plans(*[c[by] for c in columns])

    def needs(self, rule: str) -> np.ndarray:
        """Which of the three kinds of path an element chooses for itself."""
        own = np.where(self.light_end == NOWHERE, FALLBACK, np.where(self.clean_end == self.light_end, CLEAN, ONE_HEAVY))
        return np.full(own.shape, FALLBACK) if rule == "min_distance" else own


def applied(pairs: Pairs, plans: Plans, rule: str) -> tuple[Plans, list[tuple[np.ndarray, np.ndarray]]]:
    """Plans of the first elements of ``pairs``, and per kind of path those that have one and the pair it takes."""
    later = plans.of(pairs.last)
    at = group_starts(pairs.first)
    if not at.size:
        return Plans.none(), [(at, at)] * 3
    group = np.repeat(np.arange(at.size), np.diff(np.r_[at, pairs.first.size]))
    depth = np.maximum.reduceat(later.depth, at)
    deep = np.flatnonzero(later.depth == depth[group])
    pairs, later, group = pairs.take(deep), Plans(*[c[deep] for c in later.columns()]), group[deep]
    at = group_starts(group)
    has_one = pairs.one_at >= 0
    clean_end = np.maximum.reduceat(np.where(pairs.clean, later.clean_end, NOWHERE), at)
    light_end = np.maximum.reduceat(np.maximum(np.where(pairs.clean, later.light_end, NOWHERE), np.where(has_one, later.clean_end, NOWHERE)), at)

    clean = np.flatnonzero(pairs.clean & (later.clean_end != NOWHERE) & (later.clean_end == clean_end[group]))
    clean = clean[np.lexsort((pairs.last[clean], group[clean]))]
    clean = clean[group_starts(group[clean])]

    wanted = light_end[group]
    heavy = np.maximum(np.where(pairs.clean & (later.light_end == wanted), pairs.length + later.heavy_at, -1),
                       np.where(has_one & (later.clean_end == wanted), pairs.one_at, -1))
    one = np.flatnonzero((heavy >= 0) & (wanted != NOWHERE) & (wanted != clean_end[group]))
    one = one[np.lexsort((pairs.last[one], -heavy[one], group[one]))]
    one = one[group_starts(group[one])]
    heavy_at = np.zeros(at.size, dtype=np.int64)
    heavy_at[group[one]] = heavy[one]

    total = pairs.distance + later.distance
    first, second = (total, later.end) if rule == "min_distance" else (later.end, total)
    best = np.lexsort((pairs.last, -pairs.order, -later.rank, second, first, group))[at]
    found = Plans(pairs.first[at], pairs.length + depth, clean_end, light_end, later.end[best], total[best], heavy_at,
                  dense_rank(later.rank[best], pairs.order[best]))
    return found, [(group[clean], deep[clean]), (group[one], deep[one]), (np.arange(at.size), deep[best])]


def frames_of(links: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[Pairs]:
    """The links of each frame, last frame first."""
    src, dst, weight = links
    by = np.argsort(src, kind="stable")
    src, dst, weight = src[by], dst[by], weight[by]
    at = group_starts(src >> 32)
    for low, high in reversed(list(zip(at, [*at[1:], src.size]))):
        yield Pairs.of_links(src[low:high], dst[low:high], weight[low:high])


# --- one interval ----------------------------------------------------------------------------------

def summary(links: tuple[np.ndarray, np.ndarray, np.ndarray], rule: str) -> tuple[Pairs, Plans]:
    """Pairs from the first frame of an interval to its end, and plans of the first elements without one."""
    through, plans = None, Plans.none()
    for step in frames_of(links):
        through = step if through is None else product(step, through)
        short = ~np.isin(step.first, through.first)
        plans = applied(step.take(short), plans, rule)[0]
    return through, plans


def joined_summary(early: tuple[Pairs, Plans], late: tuple[Pairs, Plans], rule: str) -> tuple[Pairs, Plans]:
    """Summary of two intervals that follow each other."""
    pairs = product(early[0], late[0])
    short = ~np.isin(early[0].first, pairs.first)
    plans = applied(early[0].take(short), late[1], rule)[0]
    return pairs, Plans.joined([early[1], plans])


def plans_before(whole: tuple[Pairs, Plans], after: Plans, rule: str) -> Plans:
    """Plans of the first elements of an interval from those at its end."""
    through = applied(whole[0], after, rule)[0]
    return Plans.joined([whole[1], through])


def plan(links: tuple[np.ndarray, np.ndarray, np.ndarray], after: Plans, rule: str) -> tuple[Plans, np.ndarray]:
    """Plans of all elements with a link and their next hops ``(node, kind, child, weight, next kind)``."""
    plans, parts, hops = after, [], []
    for step in frames_of(links):
        plans, kinds = applied(step, plans, rule)
        parts.append(plans)
        for kind, (group, pair) in enumerate(kinds):
            weight = step.distance[pair]
            next_kind = np.full(pair.size, FALLBACK) if kind == FALLBACK else np.where((kind == ONE_HEAVY) & (weight == 1), ONE_HEAVY, CLEAN)
            hops.append(np.column_stack([plans.node[group], np.full(pair.size, kind), step.last[pair], weight, next_kind]))
    hops = np.concatenate(hops) if hops else np.zeros((0, 5), dtype=np.int64)
    return Plans.joined(parts), hops[np.lexsort((hops[:, 1], hops[:, 0]))]


@dataclass
class Hops:
    """Next hops by state, a state being an element and a kind of path."""

    rows: np.ndarray

    def __post_init__(self) -> None:
        self.node, self.kind = self.rows[:, 0], self.rows[:, 1]
        self.place = np.searchsorted(self.node, self.node, "left")

    def at(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Row of the hop of each state, -1 without one."""
        out = np.full(node.size, -1)
        low, high = np.searchsorted(self.node, node, "left"), np.searchsorted(self.node, node, "right")
        for k in range(3):
            spot = low + k
            hit = (spot < high) & (self.kind[np.minimum(spot, max(self.node.size - 1, 0))] == kind) if self.node.size else np.zeros(node.size, dtype=bool)
            out[hit] = spot[hit]
        return out


def follow(hops: Hops, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hops that paths from ``states(node, kind)`` take, and the states at which they leave the interval.

    States may lie in any frame of the interval.
    """
    taken = np.zeros(len(hops.rows), dtype=bool)
    if not len(hops.rows):
        return np.flatnonzero(taken), states[:0]
    first, last = int(hops.node[0]) >> 32, int(hops.node[-1]) >> 32
    spots = hops.at(states[:, 0], states[:, 1])
    taken[spots[spots >= 0]] = True
    bounds = np.searchsorted(hops.node, np.arange(first, last + 2) << 32)
    beyond = [states[:0]]
    for low, high in zip(bounds[:-1], bounds[1:]):
        go = hops.rows[low:high][taken[low:high]]
        go = np.unique(go[:, [2, 4]], axis=0)
        spots = hops.at(go[:, 0], go[:, 1])
        taken[spots[spots >= 0]] = True
        beyond.append(go[(go[:, 0] >> 32) > last])
    return np.flatnonzero(taken), np.unique(np.concatenate(beyond), axis=0)


def jumps(hops: Hops) -> np.ndarray:
    """``(node, kind, node, kind)``: where the states of the first frame leave the interval."""
    if not len(hops.rows):
        return np.zeros((0, 4), dtype=np.int64)
    last = int(hops.node[-1]) >> 32
    start = hops.rows[hops.node >> 32 == hops.node[0] >> 32][:, :2]
    now = start
    while len(now) and int(now[0, 0]) >> 32 <= last:
        spots = hops.at(now[:, 0], now[:, 1])
        start, now = start[spots >= 0], hops.rows[spots[spots >= 0]][:, [2, 4]]
    return np.column_stack([start, now])
