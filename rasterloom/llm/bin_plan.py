"""Bin packing over a histogram of sizes: Martello-Toth dominance reduction, then best fit decreasing.

Items of one size are interchangeable, so the plan is made over at most ``capacity`` sizes with their counts, however
many items there are: a step treats all bins that are in the same state at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict


class Pool:
    """Counts of the sizes not yet placed."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, w: int, m: int) -> None:
        self.n[w] -= m
        if not self.n[w]:
            del self.n[w]
            self.sizes.pop(bisect_left(self.sizes, w))

    def largest(self, most: int) -> int:
        """The largest size of at most most, or 0."""
        i = bisect_right(self.sizes, most)
        return self.sizes[i - 1] if i else 0

    def smallest(self, k: int) -> list[int]:
        """The k smallest items, or fewer."""
        out: list[int] = []
        for w in self.sizes[:k]:
            out += [w] * min(k - len(out), self.n[w])
            if len(out) == k:
                break
        return out


def _pairs(pool: Pool, room: int):
    """For each size h the largest size i <= h with h + i <= room that is there beside it: every other pair has a part that is smaller."""
    for h in pool.sizes:
        if h >= room:
            return
        i = pool.largest(min(h, room - h))
        if i == h and pool.n[h] < 2:
            i = pool.largest(h - 1)
        if i:
            yield h, i


def _dominating(pool: Pool, room: int) -> tuple[int, ...] | None:
    """The other members of a set that provably dominates every set with an item leaving room, of which pool holds the rest; None if no such set is found."""
    least = pool.smallest(3)
    if not least or least[0] > room:
        return ()
    single = pool.largest(room)
    if single == room or sum(least[:2]) > room or len(least) < 2:
        return (single,)  # it takes in all that could stand there
    if sum(least) <= room and len(least) == 3:
        return None  # three others fit: no small set is known to dominate
    a, b = max(_pairs(pool, room), key=lambda p: (p[0] + p[1], p[0]))
    if single >= a + b:
        return (single,)
    if single <= a and all((h <= a and i <= b) or h + i <= a for h, i in _pairs(pool, room)):
        return (a, b)
    return None


def reduce(pool: Pool, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes out of pool the bins that some best packing has: (sizes, how many such bins). Repeats until nothing more can be fixed."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        for j in reversed(list(pool.sizes)):
            while j in pool.n:
                pool.take(j, 1)
                others = _dominating(pool, capacity - j)
                if j in pool.n:
                    pool.n[j] += 1
                else:
                    pool.n[j] = 1
                    insort(pool.sizes, j)
                if others is None:
                    break
                need: dict[int, int] = defaultdict(int)
                for w in (j, *others):
                    need[w] += 1
                times = min(pool.n[w] // k for w, k in need.items())
                for w, k in need.items():
                    pool.take(w, k * times)
                fixed.append(((j, *others), times))
                again = True
    return fixed


def best_fit(pool: Pool, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing of all that pool holds; bins in the same state are filled together."""
    rooms: list[int] = []
    at: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, bins: tuple[int, ...], m: int) -> None:
        if room not in at:
            at[room] = []
            insort(rooms, room)
        at[room].append((bins, m))

    for w in reversed(list(pool.sizes)):
        left = pool.n[w]
        while left:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                bins, m = at[room].pop()
                if not at[room]:
                    del at[room]
                    rooms.pop(i)
            else:
                room, bins, m = capacity, (), left
            each = room // w  # the next of equal items fits the same bin best
            full = min(m, left // each)
            if full:
                put(room - each * w, (*bins, *[w] * each), full)
            elif left:
                put(room - left * w, (*bins, *[w] * left), 1)
            used = full or 1
            left -= full * each if full else left
            if bins and m > used:
                put(room, bins, m - used)
    return [x for groups in at.values() for x in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (sizes, how many bins hold just these); together they hold every item once."""
    if any(not 0 < w <= capacity for w in counts):
        raise ValueError(f"sizes must be from 1 to {capacity}")
    pool = Pool(counts)
    return [*reduce(pool, capacity), *best_fit(pool, capacity)]
