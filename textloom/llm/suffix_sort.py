"""Suffix arrays by linear grouping construction.

Phase 1 groups suffixes by their longest Lyndon prefix. It starts with one group per first symbol and
goes through the groups from the largest down. Each suffix of the group at hand points to its
previous smaller suffix: the nearest one to its left that lies in a lower group. A suffix pointed to
has that group's string as the next part of its own Lyndon prefix, so it moves to a new group right
above its old one; those pointed to more often move further up. Phase 2 walks the finished order
from the smallest suffix and hands every suffix its place at the front of its group, following the
same pointers. Nothing is renamed and nothing is sorted again recursively.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of all suffixes in order. The last symbol must be the only smallest one."""
    n = len(symbols)
    group_of, previous = _lyndon_groups(symbols)
    order, placed, front = [0] * n, [False] * n, list(range(n))
    order[0], placed[n - 1] = n - 1, True
    for i in range(n):
        at = order[i] - 1
        while at >= 0 and not placed[at]:
            group = group_of[at]
            order[front[group]] = at
            front[group] += 1
            placed[at] = True
            at = previous[at]
    return order


def _lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int]]:
    """The group (number of the first place it takes) and the previous smaller one of each suffix."""
    n = len(symbols)
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(symbols):
        by_symbol.setdefault(symbol, []).append(i)
    group_of, previous = [0] * n, [-1] * n
    members: dict[int, list[int]] = {}
    start_by_end: dict[int, int] = {}
    end_of: dict[int, int] = {}
    place = 0
    for symbol in sorted(by_symbol):
        own = by_symbol[symbol]
        members[place] = own
        for i in own:
            group_of[i] = place
        end_of[place] = place + len(own)
        start_by_end[place + len(own)] = place
        place += len(own)
    while place > 0:
        start = start_by_end[place]
        pointed: dict[int, int] = {}
        # Left to right, so that a suffix of this group met on the way knows its own pointer.
        own = [i for i in members[start] if group_of[i] == start]
        own.sort()
        for i in own:
            at = i - 1
            while at >= 0 and group_of[at] >= start:
                at = previous[at]
            previous[i] = at
            if at >= 0:
                pointed[at] = pointed.get(at, 0) + 1
        if len(pointed) == 1:
            moves = {(1, group_of[at]): [at] for at in pointed}
        else:
            moves = {}
            for at, times in pointed.items():
                moves.setdefault((times, group_of[at]), []).append(at)
        for key in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            rising, old = moves[key], key[1]
            end = end_of[old]
            if end - old == len(rising):
                continue  # the whole group rises: it stays where it is
            new = end - len(rising)
            for at in rising:
                group_of[at] = new
            members[new] = rising
            end_of[new], end_of[old] = end, new
            start_by_end[end], start_by_end[new] = new, old
        place = start
    return group_of, previous


def longest_earlier(symbols: list[int], weights: list[int]) -> list[int]:
    """For each suffix, the weight of the longest prefix it shares with a suffix that starts before.

    The sum of the symbols' weights is what counts, not their number.
    """
    n = len(symbols)
    order = suffix_array(symbols)
    rank = [0] * n
    for place, i in enumerate(order):
        rank[i] = place
    total = [0] * (n + 1)
    for i, weight in enumerate(weights):
        total[i + 1] = total[i] + weight
    shared = [0] * (n + 1)  # with the suffix one place before
    length = 0
    for i in range(n):
        place = rank[i]
        if place == 0:
            length = 0
            continue
        other = order[place - 1]
        while symbols[i + length] == symbols[other + length]:  # ends at the unique last symbol
            length += 1
        shared[place] = total[i + length] - total[i]
        if length:
            length -= 1
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    found = [0] * n
    for i in range(n - 1, -1, -1):  # later suffixes leave the list first
        place = rank[i]
        left, right = shared[place], shared[after[place]]
        if left >= right:
            found[i], shared[after[place]] = left, right
        else:
            found[i], shared[after[place]] = right, left
        if before[place] >= 0:
            after[before[place]] = after[place]
        if after[place] < n:
            before[after[place]] = before[place]
    return found
