"""A radix trie over ordered n-gram sets, and the similarity join inside one block of sets.

Sets are written in one global order, whose most frequent n-grams come first in the trie, so that
similar sets share long paths. A probe walks the trie once; the overlap counted along a shared path
serves every set below it. A subtree is left as soon as the n-grams that are left on either side
cannot lift the overlap to what the smallest set below it needs.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """Union-find; the smallest position is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


class Node:
    """An edge with its n-grams, the sets that end at it, and bounds on what lies below."""

    __slots__ = ("grams", "ends", "children", "shortest", "deepest", "depth")

    def __init__(self, grams: np.ndarray, depth: int):
        self.grams, self.depth = grams, depth  # depth: n-grams on the path, this edge included
        self.ends: list[int] = []
        self.children: list[Node] = []
        self.shortest = self.deepest = 0


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as ascending ranks from the end of the global order, in which integers ascend."""
    every = np.concatenate(sets)
    values, inverse = np.unique(every, return_inverse=True)
    rank = len(values) - 1 - inverse.ravel()
    marks = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(x) for x in np.split(rank, marks)], len(values)


def build(sets: list[np.ndarray], sizes: np.ndarray) -> Node:
    """Insert the sets in lexicographic order, so only the last path is ever split."""
    root = Node(np.empty(0, np.int64), 0)
    path = [root]
    before: np.ndarray | None = None
    for i in sorted(range(len(sets)), key=lambda k: sets[k].astype(">i8").tobytes()):
        own, shared = sets[i], 0
        if before is not None:
            m = min(len(before), len(own))
            differ = np.flatnonzero(before[:m] != own[:m])
            shared = int(differ[0]) if len(differ) else m
        while path[-1].depth > shared:
            last = path.pop()
            if path[-1].depth < shared:  # the edge is shared in part
                keep = shared - path[-1].depth
                upper = Node(last.grams[:keep], shared)
                last.grams = last.grams[keep:]
                upper.children = [last]
                path[-1].children[-1] = upper
                path.append(upper)
        if len(own) > path[-1].depth:
            leaf = Node(own[path[-1].depth :], len(own))
            path[-1].children.append(leaf)
            path.append(leaf)
        path[-1].ends.append(i)
        before = own
    todo, order = [root], []
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.children)
    for node in reversed(order):
        below = node.children
        own = [node.depth] if node.ends else []
        node.shortest = min([int(sizes[i]) for i in node.ends] + [c.shortest for c in below], default=0)
        node.deepest = max(own + [c.deepest for c in below], default=0)
    return root


def similar(
    sets: list[np.ndarray],
    groups: list[int],
    num: int = 75,
    den: int = 100,
    sizes: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Links that join sets of different groups, enough to connect every similar pair.

    Two sets are similar when den * intersection >= num * union. ``sizes`` tells their sizes if they
    have n-grams of their own that are not listed. A pair that is connected already, by ``groups``
    or by earlier links, is not reported. Sets connected with the largest group are not probed: the
    probes of all others meet them.
    """
    sizes = np.array([len(s) for s in sets]) if sizes is None else sizes
    forest, links = Forest(len(sets)), []
    members: dict[int, list[int]] = {}
    for i, g in enumerate(groups):
        members.setdefault(g, []).append(i)
        forest.union(members[g][0], i)
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        alike = (den + num) * common >= num * int(sizes.sum())
        return [(0, 1)] if alike and len(members) > 1 else []
    ranks, size = ranked(sets)
    root = build(ranks, sizes)
    base = max(members.values(), key=len)[0]
    whole = len(members[groups[base]]) > 1  # its members are met by the probes of the others
    held = np.zeros(size, dtype=bool)
    for i in range(len(sets)) if whole else [base, *range(len(sets))]:
        if forest.root(i) == forest.root(base) and (whole or links or i != base):
            continue
        own, n = ranks[i], int(sizes[i])
        held[own] = True
        todo = [(root, 0)]
        while todo:
            node, overlap = todo.pop()
            if len(node.grams):
                overlap += int(np.count_nonzero(held[node.grams]))
                left = len(own) - int(np.searchsorted(own, node.grams[-1], "right"))
                most = overlap + min(left, node.deepest - node.depth)
                # overlap / (own + other - overlap) >= num / den, at best for the smallest other
                if (den + num) * most < num * (n + max(node.shortest, most)):
                    continue
            for j in node.ends:
                if (den + num) * overlap >= num * (n + int(sizes[j])):
                    if forest.root(i) != forest.root(j):
                        forest.union(i, j)
                        links.append((i, j))
            todo.extend((c, overlap) for c in node.children)
        held[own] = False
    return links
