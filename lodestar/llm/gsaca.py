"""Suffix array by linear grouping (Baier 2016): no renaming, no recursion.

First phase: suffixes are grouped by their first symbol, and groups are taken in descending order. When a group is
taken, its members leave the line of open positions, and each member's previous smaller suffix is the nearest open
position to its left. Positions found this way extend their Lyndon prefix by the group's, once for each member that
found them; those of one group with the same number of finds become a group of their own just above it. In the end,
a group holds the suffixes with one Lyndon prefix, and groups are in lexicographic order.
Second phase: suffixes are emitted in ascending order. When a suffix has its place, those whose Lyndon prefix ends
where it begins are next in their groups; they are one step to the left and then along the previous-smaller pointers.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of ``text`` in lexicographic order (a proper prefix comes first)."""
    n = len(text)
    if not n:
        return []
    # groups: a list in ascending order, linked downwards, as only the next lower one is asked for
    first: dict[int, list[int]] = {}
    for i, x in enumerate(text):
        first.setdefault(x, []).append(i)
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    group = [0] * n
    for x in sorted(first):
        g = len(members)
        for i in first[x]:
            group[i] = g
        members.append(first[x])
        below.append(g - 1)
        above.append(g + 1)
    above[-1] = -1
    top = len(members) - 1

    left = list(range(n))  # left[i] == i: open; else where to look further to the left
    before = [-1] * n  # the previous smaller suffix
    size = list(map(len, members))  # of a group, without those who have gone to another

    def move(some: list[int], old: int) -> None:
        """Make a group of some of a group's members, just above it. All of them are one already."""
        if len(some) == size[old]:
            return
        to, over = len(members), above[old]
        members.append(some)
        size.append(len(some))
        size[old] -= len(some)
        below.append(old)
        above.append(over)
        above[old] = to
        if over >= 0:
            below[over] = to
        for j in some:
            group[j] = to

    g = top
    while g >= 0:
        inside = members[g]
        if size[g] != len(inside):
            inside = members[g] = [i for i in inside if group[i] == g]
        for i in inside:
            left[i] = i - 1
        finds: dict[int, int] = {}
        for i in inside:
            j = i - 1
            while j >= 0 and left[j] != j:
                j = left[j]
            k = i
            while left[k] > j:  # shorten the way for those who come later
                left[k], k = j, left[k]
            before[i] = j
            if j >= 0:
                finds[j] = finds.get(j, 0) + 1
        if len(finds) == 1:
            for j in finds:
                if size[group[j]] > 1:
                    move([j], group[j])
        elif finds:
            alike: dict[tuple[int, int], list[int]] = {}
            for j, times in finds.items():
                alike.setdefault((-times, group[j]), []).append(j)
            for (_, old), some in sorted(alike.items()) if len(alike) > 1 else alike.items():
                move(some, old)
        g = below[g]

    place, at = [0] * len(members), 0  # the next free place of each group
    g = 0
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = above[g]

    out = [-1] * n
    done = bytearray(n)
    s = n
    for r in range(-1, n):
        if r >= 0:
            s = out[r]
        i = s - 1
        while i >= 0 and not done[i]:
            out[place[group[i]]] = i
            place[group[i]] += 1
            done[i] = 1
            i = before[i]
    return out
