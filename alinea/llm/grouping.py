"""A grouping genetic algorithm for filling containers: one island's population over one bounded set of items.

An individual is a list of bins, a bin a tuple of item numbers. Crossover injects well-filled bins of one parent into the
other, removes the bins that hold one of their items, and puts the other items of these back by best fit, largest first.
Mutation does the same with the emptiest bin and some others. The fitness is the mean squared fill of the bins. A
population begins with a packing that looks ahead (``least_slack``), best fit decreasing, and best fit in random orders.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate

Bins = list[tuple[int, ...]]


def best_fit(sizes: list[int], capacity: int, bins: Bins, items: list[int]) -> Bins:
    """``bins`` with ``items`` put, in the given order, each into the fullest bin that has room, or a new one."""
    filled = [list(b) for b in bins]
    free_of: dict[int, list[int]] = {}
    mask = 0  # bit f is set if some bin has f left
    for k, b in enumerate(bins):
        f = capacity - sum(sizes[i] for i in b)
        free_of.setdefault(f, []).append(k)
        mask |= 1 << f
    for i in items:
        s = sizes[i]
        fits = mask >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            k = free_of[f].pop()
            if not free_of[f]:
                mask &= ~(1 << f)
            filled[k].append(i)
        else:
            f, k = capacity, len(filled)
            filled.append([i])
        f -= s
        free_of.setdefault(f, []).append(k)
        mask |= 1 << f
    return [tuple(b) for b in filled if b]


def least_slack(sizes: list[int], capacity: int) -> Bins:
    """A packing made bin by bin: the largest item left, then one, two or three items that fill the bin exactly, the larger
    ones first, or else the largest that fits, and so on. What sizes there are is a set of bits, so that two items for a
    given room are found by one shift."""
    items: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sizes):
        items[s].append(i)
    there, mirror = 0, 0  # bit s and bit capacity - s for every size s that is left
    for s in items:
        there |= 1 << s
        mirror |= 1 << (capacity - s)

    def take(s: int) -> int:
        nonlocal there, mirror
        i = items[s].pop()
        if not items[s]:
            there ^= 1 << s
            mirror ^= 1 << (capacity - s)
        return i

    def give_back(s: int, i: int) -> None:
        nonlocal there, mirror
        items[s].append(i)
        there |= 1 << s
        mirror |= 1 << (capacity - s)

    def two(room: int) -> tuple[int, int] | None:
        both = there & (mirror >> (capacity - room))  # sizes x with room - x there, too
        if not room % 2 and both >> (room // 2) & 1 and len(items[room // 2]) < 2:
            both ^= 1 << (room // 2)
        x = both.bit_length() - 1
        return (x, room - x) if x > 0 else None

    def exact(room: int) -> list[int] | None:
        """The items, taken, of the one, two or three sizes that fill ``room``, or None."""
        if there >> room & 1:
            return [take(room)]
        if pair := two(room):
            return [take(s) for s in pair]
        below = there & ((1 << room) - 1)
        while below:
            x = below.bit_length() - 1
            if 3 * x < room:  # x would be the largest of the three
                return None
            below ^= 1 << x
            i = take(x)
            if pair := two(room - x):
                return [i, *(take(s) for s in pair)]
            give_back(x, i)
        return None

    bins = []
    while there:
        s = there.bit_length() - 1
        filled, room = [take(s)], capacity - s
        while room and (fits := there & ((1 << (room + 1)) - 1)):
            if more := exact(room):
                filled += more
                break
            s = fits.bit_length() - 1
            filled.append(take(s))
            room -= s
        bins.append(tuple(filled))
    return bins


def fitness(sizes: list[int], capacity: int, bins: Bins) -> float:
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound of the bins needed: for each size a, items that leave less than a, those above half a bin, and the rest's volume."""
    s = sorted(sizes)
    sums = [0, *accumulate(s)]
    half = bisect_right(s, capacity // 2)
    best = -(-sums[-1] // capacity) if s else 0
    for a in sorted({0, *s[:half]}):
        big = bisect_right(s, capacity - a) if a else len(s)  # from here on an item leaves less than a
        big = max(big, half)
        low = bisect_left(s, a)
        middle, room = big - half, (big - half) * capacity - (sums[big] - sums[half])
        best = max(best, len(s) - big + middle + max(0, -(-(sums[half] - sums[low] - room) // capacity)))
    return best


def crossover(sizes: list[int], capacity: int, a: Bins, b: Bins, rng: random.Random) -> Bins:
    """``a`` with some of the well-filled bins of ``b``."""
    ranked = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    pool = ranked[: max(1, (2 * len(ranked)) // 3)]
    injected = rng.sample(pool, max(1, int(len(pool) * rng.uniform(0.1, 0.6))))
    held = {i for x in injected for i in x}
    kept, displaced = list(injected), []
    for x in a:
        if held.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in held]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, capacity, kept, displaced)


def mutate(sizes: list[int], capacity: int, a: Bins, rng: random.Random) -> Bins:
    """``a`` with its emptiest bin and a few others dissolved, their items put back in random order."""
    if len(a) < 2:
        return a
    emptiest = min(range(len(a)), key=lambda k: sum(sizes[i] for i in a[k]))
    gone = {emptiest, *rng.sample(range(len(a)), min(len(a), 2 + len(a) // 20))}
    loose = [i for k in gone for i in a[k]]
    rng.shuffle(loose)
    return best_fit(sizes, capacity, [x for k, x in enumerate(a) if k not in gone], loose)


def evolve(sizes: list[int], capacity: int, population: list[Bins], migrants: list[Bins], seed: int, members: int, generations: int) -> list[Bins]:
    """``generations`` children on from ``population`` (begun anew if empty) and ``migrants``; best first.

    A child takes the place of the worst member if it is fitter. Ends early once the best needs no more bins than the
    lower bound, as no packing has fewer.
    """
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    members_ = list(population)
    if not members_:
        members_ += [least_slack(sizes, capacity), best_fit(sizes, capacity, [], order)]
        while len(members_) < members:
            rng.shuffle(order)
            members_.append(best_fit(sizes, capacity, [], order))
    ranked = sorted(((len(x), -fitness(sizes, capacity, x), k, x) for k, x in enumerate([*members_, *migrants])), key=lambda e: e[:3])[:members]
    least, count = least_bins(sizes, capacity), len(members_) + len(migrants)
    for _ in range(generations):
        if ranked[0][0] <= least:
            break
        a, b = (min(rng.sample(ranked, min(2, len(ranked))), key=lambda e: e[:3])[3] for _ in range(2))
        child = crossover(sizes, capacity, a, b, rng)
        if rng.random() < 0.3:
            child = mutate(sizes, capacity, child, rng)
        entry = (len(child), -fitness(sizes, capacity, child), count, child)
        count += 1
        if entry[:2] < ranked[-1][:2]:
            ranked[-1] = entry
            ranked.sort(key=lambda e: e[:3])
    return [e[3] for e in ranked]
