"""Critical-path schedules of build graphs. nodes: graph, node, cost_ns; edges: graph, src, dst (src before dst)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = "start_ns long, finish_ns long, longest_from_ns long, slack_ns long, critical boolean, forward_pred {n}, backward_succ {n}"


class CyclicGraph(ValueError):
    """The graph has a cycle and so no schedule."""


def ordered(nodes: list, before: dict, after: dict) -> list:
    """Nodes with each one's predecessors first."""
    left = {n: len(before[n]) for n in nodes}
    ready = sorted((n for n in nodes if not left[n]), reverse=True)
    out = []
    while ready:
        n = ready.pop()
        out.append(n)
        for m in after[n]:
            left[m] -= 1
            if not left[m]:
                ready.append(m)
    if len(out) < len(nodes):
        raise CyclicGraph(f"{len(nodes) - len(out)} nodes lie on or behind a cycle")
    return out


def adjacency(nodes: list, src: list, dst: list) -> tuple[dict, dict]:
    before, after = {n: [] for n in nodes}, {n: [] for n in nodes}
    for a, b in sorted(set(zip(src, dst))):
        if a != b and a in before and b in before:
            before[b].append(a)
            after[a].append(b)
    return before, after


def passes(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Forward and backward pass over one graph. Edges from or to unknown nodes and loops are ignored."""
    names, cost = nodes["node"].tolist(), dict(zip(nodes["node"].tolist(), nodes["cost_ns"].tolist()))
    before, after = adjacency(names, edges["src"].tolist(), edges["dst"].tolist())
    order = ordered(names, before, after)
    start, pred, tail, succ = {}, {}, {}, {}
    for n in order:
        best, who = 0, None
        for m in before[n]:
            if start[m] + cost[m] > best:
                best, who = start[m] + cost[m], m
        start[n], pred[n] = best, who
    for n in reversed(order):
        best, who = 0, None
        for m in after[n]:
            if cost[m] + tail[m] > best:
                best, who = cost[m] + tail[m], m
        tail[n], succ[n] = best, who
    whole = max((start[n] + cost[n] for n in names), default=0)
    slack = {n: max(0, whole - start[n] - cost[n] - tail[n]) for n in names}
    text = nodes["node"].dtype == object
    who = lambda d: pd.array([d[n] for n in names], dtype="object" if text else "Int64")
    return pd.DataFrame({"graph": nodes["graph"].iloc[0] if len(nodes) else [], "node": names, "cost_ns": [cost[n] for n in names], "start_ns": [start[n] for n in names], "finish_ns": [start[n] + cost[n] for n in names], "longest_from_ns": [tail[n] for n in names], "slack_ns": [slack[n] for n in names], "critical": [slack[n] == 0 for n in names], "forward_pred": who(pred), "backward_succ": who(succ)})


def schedule(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The passes for each graph, in one task a graph: a build graph of targets fits a worker, its symbols don't come here."""
    kind = dict(nodes.dtypes)
    schema = f"graph {kind['graph']}, node {kind['node']}, cost_ns long, " + FIELDS.format(n=kind["node"])
    return nodes.select("graph", "node", "cost_ns").groupBy("graph").cogroup(edges.select("graph", "src", "dst").groupBy("graph")).applyInPandas(passes, schema)


def summary(sched: DataFrame) -> DataFrame:
    """For each graph: critical_path_ns, total_cost_ns, parallelism_ratio (0 without a path), target_count, critical_count. `lanes` has the lane of each node."""
    s = sched.groupBy("graph").agg(F.max("finish_ns").alias("critical_path_ns"), F.sum("cost_ns").alias("total_cost_ns"), F.count("*").alias("target_count"), F.sum(F.col("critical").cast("long")).alias("critical_count"))
    return s.withColumn("parallelism_ratio", F.when(F.col("critical_path_ns") > 0, F.round(F.col("total_cost_ns") / F.col("critical_path_ns"), 9)).otherwise(0.0))


def peak(sched: DataFrame) -> DataFrame:
    """graph, peak: targets that run at once, at most; ends come before starts of the same time. For positive costs."""
    ticks = sched.filter("cost_ns > 0").select("graph", F.explode(F.array(F.struct(F.col("start_ns").alias("at"), F.lit(1).alias("d")), F.struct(F.col("finish_ns").alias("at"), F.lit(-1).alias("d")))).alias("x")).select("graph", "x.*")
    ticks = ticks.groupBy("graph", "at").agg(F.sum("d").alias("d"))
    run = F.sum("d").over(Window.partitionBy("graph").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return ticks.select("graph", run.alias("n")).groupBy("graph").agg(F.max("n").alias("peak"))


def lanes(sched: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node, lane: greedy lanes in order of (start, finish, node).

    A lane is free for a target if its last one has finished. Of the free lanes one that no
    direct dependency uses comes first, then the nearest to the predecessor's, then the lowest.
    """
    kind = dict(sched.dtypes)

    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["start_ns", "finish_ns", "node"])
        names = nodes["node"].tolist()
        before, _ = adjacency(names, links["src"].tolist(), links["dst"].tolist())
        until, lane = [], {}
        for n, start, finish, pred in zip(names, nodes["start_ns"].tolist(), nodes["finish_ns"].tolist(), nodes["forward_pred"].tolist()):
            free = [i for i, t in enumerate(until) if t <= start]
            if free:
                taken = {lane[m] for m in before[n] if m in lane}
                near = lane.get(pred)
                at = min(free, key=lambda i: (i in taken, abs(i - near) if near is not None else 0, i))
                until[at] = finish
            else:
                at = len(until)
                until.append(finish)
            lane[n] = at
        return pd.DataFrame({"graph": nodes["graph"], "node": names, "lane": [lane[n] for n in names]})

    return sched.groupBy("graph").cogroup(edges.select("graph", "src", "dst").groupBy("graph")).applyInPandas(run, f"graph {kind['graph']}, node {kind['node']}, lane long")


def horizons(nodes: DataFrame, edges: DataFrame, own: DataFrame) -> DataFrame:
    """graph, node, horizon: the largest own horizon of a node and of all before it. own: graph, node, horizon; 0 where missing."""
    kind = dict(nodes.dtypes)

    def run(pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names, have = pdf["node"].tolist(), dict(zip(pdf["node"].tolist(), pdf["horizon"].tolist()))
        before, after = adjacency(names, links["src"].tolist(), links["dst"].tolist())
        for n in ordered(names, before, after):
            have[n] = max([have[n], *(have[m] for m in before[n])])
        return pd.DataFrame({"graph": pdf["graph"], "node": names, "horizon": [have[n] for n in names]})

    start = nodes.select("graph", "node").join(own, ["graph", "node"], "left").withColumn("horizon", F.coalesce("horizon", F.lit(0)).cast("long"))
    return start.groupBy("graph").cogroup(edges.select("graph", "src", "dst").groupBy("graph")).applyInPandas(run, f"graph {kind['graph']}, node {kind['node']}, horizon long")


def path_through(sched: DataFrame, node) -> DataFrame:
    """graph, step, node: the longest path through one node, from its first predecessor to its last successor. sched: as `schedule` gives it, small enough for a worker."""
    kind = dict(sched.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pred, succ = ({n: None if pd.isna(m) else m for n, m in zip(pdf["node"], pdf[c])} for c in ("forward_pred", "backward_succ"))
        way, at = [], node if node in pred else None
        while at is not None:
            way.append(at)
            at = pred[at]
        way.reverse()
        at = succ[node] if way else None
        while at is not None:
            way.append(at)
            at = succ[at]
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "step": range(len(way)), "node": way}, columns=["graph", "step", "node"])

    return sched.select("graph", "node", "forward_pred", "backward_succ").groupBy("graph").applyInPandas(run, f"graph {kind['graph']}, step long, node {kind['node']}")
