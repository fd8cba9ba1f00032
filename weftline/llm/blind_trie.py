"""Deep-shallow sorting of byte strings with common-prefix lengths."""

from __future__ import annotations

import numpy as np

END = -1  # what stands after the last byte; below every byte


def at(s: bytes, i: int) -> int:
    return s[i] if i < len(s) else END


class BlindTrie:
    """Inner nodes hold a depth and children by the symbol there; leaves hold strings. What lies between two depths is not looked at on the way down."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def add(self, s: bytes) -> None:
        if self.root is None:
            self.root = s
            return
        node, path = self.root, []
        while not isinstance(node, bytes):
            path.append(node)
            depth, children = node
            c = at(s, depth)
            node = children.get(c) or next(iter(children.values()))
        if node == s:
            return
        n = min(len(s), len(node))
        a, b = np.frombuffer(s, np.uint8, n), np.frombuffer(node, np.uint8, n)
        differ = a != b
        lcp = int(differ.argmax()) if n and differ.any() else n
        above = None
        for above_depth, children in path:  # the last inner node above the branching depth
            if above_depth > lcp:
                break
            above = (above_depth, children)
        if above and above[0] == lcp:
            above[1][at(s, lcp)] = s
            return
        below = self.root if above is None else above[1][at(s, above[0])]
        fresh = (lcp, {at(node, lcp): below, at(s, lcp): s})
        if above is None:
            self.root = fresh
        else:
            above[1][at(s, above[0])] = fresh

    def sorted(self) -> tuple[list[bytes], list[int]]:
        """The strings in order, and the common prefix of each with the one before it (0 for the first)."""
        out, lcps, stack, lcp = [], [], [(self.root, 0)], 0
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, bytes):
                out.append(node)
                lcps.append(lcp)
            elif node is not None:
                depth, children = node
                keys = sorted(children)
                stack += [(children[k], depth) for k in reversed(keys[1:])]
                stack.append((children[keys[0]], lcp))
        return out, lcps


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """The order of rows of keys, equal rows as they come.

    A range of rows is parted by its middle row's key into smaller, equal and larger ones; the
    equal ones go on at the next key. All ranges of a round are parted at once.
    """
    n, width = keys.shape
    order, lo, size, depth = np.arange(n), np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)
    while True:
        open_ = (size > 1) & (depth < width)
        lo, size, depth = lo[open_], size[open_], depth[open_]
        if not len(lo):
            return order
        group = np.repeat(np.arange(len(lo)), size)
        place = np.arange(len(group)) + np.repeat(lo - (np.cumsum(size) - size), size)
        rows = order[place]
        key, pivot = keys[rows, depth[group]], keys[order[lo + size // 2], depth][group]
        side = 3 * group + 1 + (key > pivot) - (key < pivot)
        order[place] = rows[np.argsort(side, kind="stable")]
        counts = np.bincount(side, minlength=3 * len(lo))
        lo = np.repeat(lo - (np.cumsum(size) - size), 3) + np.cumsum(counts) - counts
        size, depth = counts, (depth[:, None] + np.array([0, 1, 0])).ravel()


def deep_shallow(strings: list[bytes], shallow: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """order and lcp: order sorts the strings; lcp[i] is the common prefix of the strings at order[i - 1] and order[i].

    Multikey quicksort with eight-byte keys orders the strings to the shallow depth (a multiple of 8); a blind trie orders what is still equal there. Equal strings keep their order.
    """
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.zeros((n, shallow), np.uint8)
    size = np.array([len(s) for s in strings])
    joined = np.frombuffer(b"".join(s[:shallow] for s in strings), np.uint8)
    head[np.arange(shallow) < np.minimum(size, shallow)[:, None]] = joined
    keys = head.view(">u8").astype(np.uint64)
    clipped = np.minimum(size, shallow)
    order = multikey_quicksort(np.column_stack([keys, clipped.astype(np.uint64)]))  # where one string ends, padding looks like zeros
    a, b = head[order[:-1]], head[order[1:]]
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), shallow)
    lcp = np.concatenate([[0], np.minimum(first, np.minimum(clipped[order[:-1]], clipped[order[1:]]))])
    tied = np.concatenate([[False], (lcp[1:] == shallow)])
    starts = np.flatnonzero(~tied)
    stops = np.append(starts[1:], n)
    for lo, hi in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist()):
        members = order[lo:hi].tolist()
        by = {}
        for i in members:
            by.setdefault(strings[i], []).append(i)
        trie = BlindTrie()
        for s in by:
            trie.add(s)
        at_ = lo
        for s, prefix in zip(*trie.sorted()):
            for j, i in enumerate(by[s]):
                order[at_] = i
                if at_ > lo:
                    lcp[at_] = len(s) if j else prefix
                at_ += 1
    return order, lcp
