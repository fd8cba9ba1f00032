"""Components merged into packages that can be built apart. edges: graph, src, dst (src before dst), acyclic."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .schedule import CyclicGraph


def _rows(at: np.ndarray, to: np.ndarray, n: int) -> tuple[list, list]:
    """Neighbours of all nodes in one list, and where each node's begin."""
    return np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).tolist(), to[np.argsort(at, kind="stable")].tolist()


def merged(nodes: list, src: list, dst: list) -> dict:
    """node -> least member of its part.

    Nodes come dependents first. A node that exactly one part needs (after reduction) joins that
    part, which then needs what the node needed outside of it; any other node is a part of its own.
    Memory is in proportion to nodes and edges: what can be reached is searched for where it is asked.
    """
    ids = np.sort(np.asarray(nodes))
    n = len(ids)
    if not n:
        return {}
    src, dst = np.asarray(src, ids.dtype), np.asarray(dst, ids.dtype)
    a, b = (np.minimum(np.searchsorted(ids, x), n - 1) for x in (src, dst))
    known = (a != b) & (ids[a] == src) & (ids[b] == dst)
    a, b = np.divmod(np.unique(a[known] * n + b[known]), n)
    first, needs = _rows(b, a, n)
    left = np.bincount(a, minlength=n).tolist()
    order = [i for i in range(n) if not left[i]]
    for u in order:  # grows as it goes
        for m in needs[first[u] : first[u + 1]]:
            left[m] -= 1
            if not left[m]:
                order.append(m)
    if len(order) < n:
        raise CyclicGraph(f"{n - len(order)} nodes lie on or before a cycle")
    # from here on a node is its place in that order
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = place[a], place[b]
    first, needs = _rows(b, a, n)
    since, users = _rows(a, b, n)
    part, members = list(range(n)), [[i] for i in range(n)]

    def reaches(p: int, v: int) -> bool:
        """Whether what p needs outside of it, other than v, reaches v: a step up from v and a step down from p in turn, until they meet or have passed each other."""
        up, down = set(users[since[v] : since[v + 1]]), set()
        back, fore = [-u for u in up], []
        heapify(back)
        own, i = members[p], 0
        while back:
            u = -heappop(back)
            for w in users[since[u] : since[u + 1]]:
                if w in down or part[w] == p and part[u] != p:
                    return True
                if w not in up:
                    up.add(w)
                    heappush(back, -w)
            if mine := i < len(own) and (not fore or own[i] < fore[0]):
                x, i = own[i], i + 1
            elif fore:
                x = heappop(fore)
            else:
                return False
            for m in needs[first[x] : first[x + 1]]:
                if m < v and m not in down and not (mine and part[m] == p):
                    if m in up:
                        return True
                    down.add(m)
                    heappush(fore, m)
            ahead = min(own[i] if i < len(own) else v, fore[0] if fore else v)
            if not back or ahead > -back[0]:
                return False
        return False

    for v in range(n):
        wanted_by = {part[u] for u in users[since[v] : since[v + 1]]}
        if len(wanted_by) > 1:
            free = []
            for p in sorted(wanted_by, reverse=True):  # the nearest first: it is the likeliest to want v
                if not reaches(p, v):
                    free.append(p)
                    if len(free) > 1:
                        break
            wanted_by = free
        if len(wanted_by) == 1:
            (p,) = wanted_by
            part[v] = p
            members[p].append(v)
            members[v] = None
    least = np.full(n, n)
    np.minimum.at(least, part, order)
    got = np.empty(n, np.int64)
    got[order] = least[part]
    return dict(zip(ids.tolist(), ids[got].tolist()))


def partitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node, part (its least member). The condensed graph of a workspace is one group and has to fit a worker."""
    kind = dict(nodes.dtypes)

    def run(pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        got = merged(pdf["node"].to_numpy(), links["src"].to_numpy(), links["dst"].to_numpy())
        return pd.DataFrame({"graph": pdf["graph"].iloc[0] if len(pdf) else [], "node": list(got), "part": list(got.values())})

    return nodes.select("graph", "node").groupBy("graph").cogroup(edges.select("graph", "src", "dst").groupBy("graph")).applyInPandas(run, f"graph {kind['graph']}, node {kind['node']}, part {kind['node']}")
