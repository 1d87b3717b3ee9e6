"""Links between sets of a block: prefix-tree join."""

from __future__ import annotations

import numpy as np


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of many stretches, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


class PrefixTree:
    """Sets, as ascending sequences of ranks in one order for all (frequent tokens first), in a compressed trie.

    Sequences are sorted, so a subtree is a range of them (``lo`` to ``hi``). Nodes
    are numbered breadth first: children of a node stand together. An edge is the
    stretch of its first sequence from the parent's depth to its own.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        self.n_ranks = len(count)
        seqs = [np.sort(r) for r in np.split(rank[inverse], np.cumsum(sizes)[:-1])]
        self.order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        self.seqs = [seqs[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.flat = np.concatenate(self.seqs) if self.seqs else np.zeros(0, np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self._number(self._grow())

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _grow(self) -> list[list]:
        """Nodes ``[parent's depth, depth, lo, hi, children]`` from the common prefixes of neighbours."""
        nodes = [[0, 0, 0, len(self.seqs), []]]
        path = [0]
        for i, seq in enumerate(self.seqs):
            common = self._common(self.seqs[i - 1], seq) if i else 0
            last = None
            while nodes[path[-1]][1] > common:
                last = path.pop()
                nodes[last][3] = i
            top = nodes[path[-1]]
            if top[1] < common:  # split the edge to the node just left
                between = len(nodes)
                nodes.append([top[1], common, nodes[last][2], 0, [last]])
                nodes[last][0] = common
                top[4][-1] = between
                path.append(between)
            if len(seq) > nodes[path[-1]][1]:
                leaf = len(nodes)
                nodes.append([nodes[path[-1]][1], len(seq), i, i + 1, []])
                nodes[path[-1]][4].append(leaf)
                path.append(leaf)
        for k in path:
            nodes[k][3] = len(self.seqs)
        return nodes

    def _number(self, nodes: list[list]) -> None:
        order, first_child, n_children = [0], [], []
        for k in order:
            first_child.append(len(order))
            n_children.append(len(nodes[k][4]))
            order.extend(nodes[k][4])
        made = np.array([nodes[k][:4] for k in order], np.int64).reshape(-1, 4)
        self.above, self.depth, self.lo, self.hi = made.T
        self.first_child, self.n_children = np.array(first_child), np.array(n_children)
        self.start = (self.at[self.lo] + self.above) if len(self.seqs) else self.above
        self.length = self.depth - self.above
        n = len(self.seqs)
        if n:
            edges = np.stack([self.lo, self.hi], 1).ravel()
            pad = np.append(self.sizes, 0)
            self.smallest, self.largest = np.minimum.reduceat(np.append(self.sizes, 1 << 60), edges)[::2], np.maximum.reduceat(pad, edges)[::2]
            ends = [int(np.searchsorted(self.sizes[a:b] != d, True)) for a, b, d in zip(self.lo.tolist(), self.hi.tolist(), self.depth.tolist(), strict=True)]
            self.own = np.array(ends, np.int64)  # sequences that end at the node: the first of its range
            self.own[0] = int((self.sizes == 0).sum())


def link(sets: list[np.ndarray], percent: int, joined: list[int] | None = None) -> list[int]:
    """By set, the first of those it hangs together with through links (100 * intersection >= percent * union).

    ``joined``: groups known before, by the number of a member. Sets that hang
    together already are not compared again, which changes no component. A set
    that is not (yet) in the largest component walks the tree, level by level: the
    overlap of a path grows by that of each edge, and the walk turns back where
    even all remaining tokens would not do, or everything below is already joined.
    A link that is missing in the end would have an end that has walked.
    """
    n = len(sets)
    tree = PrefixTree(sets)
    group = np.arange(n)  # by place in the tree's order
    mask = np.zeros(tree.n_ranks, bool)

    def union(a: int, b: int) -> None:
        x, y = group[a], group[b]
        if x != y:
            group[group == max(x, y)] = min(x, y)

    def enough(overlap, both):
        return 100 * overlap >= percent * (both - overlap)

    if joined is not None:
        at = {x: i for i, x in enumerate(tree.order)}
        for i, j in enumerate(joined):
            union(at[i], at[j])
    for i in range(1, n):
        if group[i] != group[i - 1]:
            mask[tree.seqs[i - 1]] = True
            if enough(int(np.count_nonzero(mask[tree.seqs[i]])), int(tree.sizes[i] + tree.sizes[i - 1])):
                union(i, i - 1)
            mask[tree.seqs[i - 1]] = False
    main = int(np.flatnonzero(group == np.bincount(group).argmax())[0])
    edges = np.stack([tree.lo, tree.hi], 1).ravel()

    def walk(x: int) -> None:
        seq, size = tree.seqs[x], int(tree.sizes[x])
        mask[seq] = True
        padded = np.append(group, 0)
        one = np.minimum.reduceat(np.append(group, n), edges)[::2] == np.maximum.reduceat(padded, edges)[::2]
        nodes, overlap = tree.first_child[0] + np.arange(tree.n_children[0]), np.zeros(tree.n_children[0], np.int64)
        while len(nodes):
            open_ = ~(one[nodes] & (group[tree.lo[nodes]] == group[x]))
            nodes, overlap = nodes[open_], overlap[open_]
            if not len(nodes):
                break
            length = tree.length[nodes]
            hit = mask[tree.flat[ranges(tree.start[nodes], length)]]
            overlap = overlap + np.add.reduceat(hit, np.cumsum(length) - length, dtype=np.int64)
            after = size - np.searchsorted(seq, tree.flat[tree.start[nodes] + length - 1], "right")
            most = overlap + np.minimum(after, tree.largest[nodes] - tree.depth[nodes])
            good = enough(most, size + tree.smallest[nodes])
            nodes, overlap = nodes[good], overlap[good]
            ends = tree.own[nodes]
            for k in np.flatnonzero((ends > 0) & enough(overlap, size + tree.depth[nodes])).tolist():
                for y in range(int(tree.lo[nodes[k]]), int(tree.lo[nodes[k]] + ends[k])):
                    union(x, y)
            width = tree.n_children[nodes]
            nodes, overlap = ranges(tree.first_child[nodes], width), np.repeat(overlap, width)
        mask[seq] = False

    for x in range(n):
        if group[x] != group[main]:
            walk(x)
    first = np.full(n, n, np.int64)
    members = np.array(tree.order)
    np.minimum.at(first, group, members)
    out = np.empty(n, np.int64)
    out[members] = first[group]
    return out.tolist()
