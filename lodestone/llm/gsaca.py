"""Suffix arrays by linear grouping construction, for many strings at once.

Phase 1 groups the suffixes of a string by their first symbol and handles the groups in descending order.
For each suffix of a group, the previous-smaller pointer leads to the nearest suffix before it that is in a
lower group; that suffix continues with this group's prefix. Suffixes that are pointed at leave their group
for new ones right above it, more often pointed at above less often. When all groups are done, each holds
the suffixes that share their longest Lyndon prefix.

Phase 2 emits the order: from the smallest suffix on, the suffix one before the current one, then those on
its chain of previous-smaller pointers, take the next free place of their group, up to one already placed.
Nothing is renamed and nothing recurses.

The groups of one string have to be handled one after another, but strings don't depend on each other: all
strings of a batch take a step together, as numpy operations over the members of their current groups. The
work is linear in the symbols, apart from pointer jumps.
"""

import numpy as np


def suffix_arrays(strings: list[np.ndarray]) -> list[np.ndarray]:
    """The suffix array of each string of symbols >= 1. The end of a string sorts below every symbol."""
    if not strings:
        return []
    lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + 1  # with an end symbol
    spans = lengths + 1  # with a guard cell in front, below every group
    guard = np.concatenate([[0], np.cumsum(spans)[:-1]])
    base, size = guard + 1, int(spans.sum())
    symbol = np.zeros(size, np.int64)
    for at, s in zip(base, strings):
        symbol[at : at + len(s)] = s
    owner = np.repeat(np.arange(len(strings)), spans)
    cell = np.ones(size, bool)
    cell[guard] = False
    group, previous = _group(symbol, owner, cell, base, lengths)
    out = _emit(group, previous, cell, base, lengths)
    return [out[b : b + n][1:] - b for b, n in zip(base.tolist(), lengths.tolist())]


def _group(symbol, owner, cell, base, lengths):
    """Phase 1: for each cell the first place of its group, and its previous-smaller pointer."""
    at = np.flatnonzero(cell)
    order = at[np.lexsort((symbol[at], owner[at]))]
    place, slot = np.zeros(len(cell), np.int64), np.full(len(cell), -1, np.int64)  # suffix at a place; place of a suffix
    places = at  # the places of a string are its cells
    place[places] = order
    slot[order] = places
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (symbol[order][1:] != symbol[order][:-1])
    starts = places[fresh]
    group = np.full(len(cell), -1, np.int64)
    group[order] = starts[np.cumsum(fresh) - 1]
    size = np.zeros(len(cell), np.int64)
    size[starts] = np.diff(np.append(np.flatnonzero(fresh), len(order)))
    previous = np.arange(len(cell)) - 1
    moving = np.zeros(len(cell), bool)
    pointed, seen, wide = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64), int(lengths.max()) + 1
    first, end = base.copy(), base + lengths
    while len(end):
        low = group[place[end - 1]]
        counts = end - low
        members = place[np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))]
        own = np.repeat(low, counts)
        # Pointers: over cells of this group and of higher ones, whose pointers are known.
        q, todo = members - 1, np.arange(len(members))
        previous[members] = q
        while len(todo):
            ahead = group[q[todo]] >= own[todo]
            todo = todo[ahead]
            if len(todo):
                q[todo] = previous[q[todo]]
                previous[members[todo]] = q[todo]
        q = q[cell[q]]
        if len(q):
            np.add.at(pointed, q, 1)
            seen[q] = np.arange(len(q))
            movers = q[seen[q] == np.arange(len(q))]  # each once
            times = pointed[movers]
            pointed[movers] = 0
            old = group[movers]
            order = np.argsort(old * wide + times)
            movers, times, old = movers[order], times[order], old[order]
            new_old = np.ones(len(old), bool)
            new_old[1:] = old[1:] != old[:-1]
            head = np.flatnonzero(new_old)
            k = np.diff(np.append(head, len(old)))
            tail = np.repeat(old[head] + size[old[head]] - k, k)
            target = tail + np.arange(len(old)) - np.repeat(head, k)
            new = new_old.copy()
            new[1:] |= times[1:] != times[:-1]
            # Whoever stands in the tail and stays takes a place that a mover leaves.
            moving[movers] = True
            there = place[target]
            staying = there[~moving[there]]
            left = np.sort(slot[movers][slot[movers] < tail]) if len(staying) else staying
            place[left] = staying
            slot[staying] = left
            place[target] = movers
            slot[movers] = target
            moving[movers] = False
            size[old[head]] -= k
            begin = np.flatnonzero(new)
            group[movers] = np.repeat(target[begin], np.diff(np.append(begin, len(old))))
            size[target[begin]] = np.diff(np.append(begin, len(old)))
        more = low > first
        end, first = low[more], first[more]
    return group, previous


def _emit(group, previous, cell, base, lengths):
    """Phase 2: the suffixes in ascending order, in the places of their string."""
    out = np.full(len(cell), -1, np.int64)
    following = np.arange(len(cell))  # next free place of the group that starts at a place
    placed = ~cell
    last = base + lengths - 1
    out[base] = last
    placed[last] = True
    following[base] += 1
    order = np.argsort(-lengths, kind="stable")
    base, lengths = base[order], lengths[order]
    live = len(base)
    for i in range(int(lengths.max())):
        while live and lengths[live - 1] <= i:
            live -= 1
        s = out[base[:live] + i] - 1
        s = s[~placed[s]]
        while len(s):
            g = group[s]
            out[following[g]] = s
            following[g] += 1
            placed[s] = True
            s = previous[s]
            s = s[~placed[s]]
    return out
