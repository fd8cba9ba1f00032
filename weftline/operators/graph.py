"""Graph operators over edge tables: components, closure, reduction, downset, anchors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import paths


def cut(df: DataFrame, every: bool = True) -> DataFrame:
    """Cut lineage with a checkpoint in the folder that the cluster shares; one of our own only where none is set and Spark is local."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weftline-"))
    return df.checkpoint(every)


def resolved(deps: DataFrame, symbols: DataFrame, parent) -> DataFrame:
    """src, dep, path: each dependency's symbol, by its own path or else by its parent's; others are dropped.

    Two equi-joins on keys; no side is held in memory unless the optimizer finds it small.
    """
    exact = symbols.select(F.col("path").alias("dep"), F.col("path").alias("own"))
    above = symbols.select(F.col("path").alias("up"), F.col("path").alias("outer"))
    out = deps.join(exact, "dep", "left").withColumn("up", F.when(F.col("own").isNull(), parent(F.col("dep")))).join(above, "up", "left")
    return out.select("src", "dep", F.coalesce("own", "outer").alias("path")).filter("path is not null")


def anchors(impls: DataFrame, edges: DataFrame, anchor_of: DataFrame) -> DataFrame:
    """impl, anchor: for each impl its anchor with the fewest incoming edges, the smallest among equals."""
    degree = edges.groupBy(F.col("t").alias("anchor")).agg(F.count("*").alias("n"))
    c = anchor_of.join(impls, "impl", "left_semi").join(degree, "anchor", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.groupBy("impl").agg(F.min(F.struct("n", "anchor")).alias("m")).select("impl", F.col("m.anchor").alias("anchor"), F.col("m.n").alias("in_degree"))


def with_back_edges(edges: DataFrame, impls: DataFrame) -> DataFrame:
    """edges (graph, s, t) and, for each impl that refers to anchors of its graph, one from the anchor with the fewest incoming edges to the impl, so that both are one component. impls: impl."""
    own = edges.select(F.col("s").alias("impl"), F.col("t").alias("anchor"), "graph")
    back = anchors(impls, edges, own.select("impl", "anchor")).join(own, ["impl", "anchor"])
    return edges.select("graph", "s", "t").union(back.select("graph", F.col("anchor").alias("s"), F.col("impl").alias("t"))).distinct()


def external_targets(deps: DataFrame) -> DataFrame:
    """symbol, targets: the targets of other prefixes that each symbol's dependencies name, one for each dependency. deps: symbol, dep, prefix (of the symbol's target)."""
    target = paths.bracketed_target(F.col("dep"))
    out = deps.filter(~F.startswith("dep", F.col("prefix"))).select("symbol", target.alias("target")).filter("target is not null")
    return out.groupBy("symbol").agg(F.sort_array(F.collect_list("target")).alias("targets"))


def _strong(s: list, t: list) -> dict:
    """Strong components by an explicit-stack depth-first search; each node's component is its least member."""
    out, index, low, on, stack, done = {}, {}, {}, set(), [], {}
    for a, b in zip(s, t):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = [stack.pop()]
                    while members[-1] != v:
                        members.append(stack.pop())
                    on.difference_update(members)
                    done.update(dict.fromkeys(members, min(members)))
    return done


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node, scc (the least member). nodes: graph, node; edges: graph, s, t, within one graph each.

    A graph (a target) is a group; it has to fit one worker. Nodes without edges never get there.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _strong(pdf["s"].tolist(), pdf["t"].tolist())
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "node": list(got), "scc": list(got.values())}, columns=["graph", "node", "scc"])

    kind = dict(edges.dtypes)
    found = edges.groupBy("graph").applyInPandas(run, f"graph {kind['graph']}, node {kind['s']}, scc {kind['s']}")
    return nodes.join(found, ["graph", "node"], "left").withColumn("scc", F.coalesce("scc", "node"))


def condensed_edges(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """src, dst: dependency before dependent, between components, distinct."""
    a = scc.select(F.col("node").alias("s"), F.col("scc").alias("dst"))
    b = scc.select(F.col("node").alias("t"), F.col("scc").alias("src"))
    return edges.join(a, "s").join(b, "t").select("src", "dst").filter("src <> dst").distinct()


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """a, b: b can be reached from a over one edge or more. Paths double in length each round."""
    have = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    n = have.count()
    for _ in range(rounds):
        step = have.join(have.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        have = cut(have.union(step).distinct())
        if (m := have.count()) == n:
            return have
        n = m
    raise RuntimeError("closure did not settle")


def reduction(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """The edges (src, dst) of an acyclic graph that no longer path replaces. reach: its closure."""
    by = edges.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(reach.select(F.col("a").alias("m"), F.col("b")), "m").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return edges.select("src", "dst").join(by, ["src", "dst"], "left_anti")


def downset(edges: DataFrame, selected: DataFrame, rounds: int = 10_000) -> DataFrame:
    """node: the selected nodes and all that they depend on. edges: src before dst; a frontier a round."""
    have = front = cut(selected.select("node").distinct())
    for _ in range(rounds):
        front = cut(edges.join(front, edges.dst == front.node).select(F.col("src").alias("node")).distinct().join(have, "node", "left_anti"))
        if front.isEmpty():
            return have
        have = cut(have.union(front))
    raise RuntimeError("downset did not settle")


def intra_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """graph, s, t: edges with both ends of one owner. owner: node, graph."""
    a, b = owner.select(F.col("node").alias("s"), "graph"), owner.select(F.col("node").alias("t"), F.col("graph").alias("other"))
    return edges.join(a, "s").join(b, "t").filter("graph = other").select("graph", "s", "t")


def dense_groups(horizons: DataFrame) -> DataFrame:
    """grp: the rank of a horizon among the distinct ones of its graph, from 0."""
    return horizons.withColumn("grp", (F.dense_rank().over(Window.partitionBy("graph").orderBy("horizon")) - 1).cast("long"))
