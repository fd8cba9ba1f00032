"""What-if changes of a target graph: a part of a target taken out, or a target split by horizons.

nodes: node, cost_ns, symbol_count; edges: src, dst (src before dst); node names are strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut, downset


def split_target(nodes: DataFrame, edges: DataFrame, parts: DataFrame, part_edges: DataFrame, source: str, new: str, selected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes and edges with `selected` components of `source` and all that they need moved to `new`, and the moved components.

    parts: node, cost_ns, symbol_count; part_edges: src, dst. The new target needs what the source
    needs; the source waits for it only if one of its other components needs a moved one; all
    that wait for the source wait for both. A name that is taken is an error.
    """
    if nodes.filter(F.col("node") == new).limit(1).count():
        raise ValueError(f"{new} exists")
    moved = downset(part_edges, selected.join(parts, "node", "left_semi").select("node")).select("node")
    sums = parts.join(moved, "node", "left_semi").agg(F.coalesce(F.sum("cost_ns"), F.lit(0)).alias("c"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("n")).first()
    is_source = F.col("node") == source
    less = lambda c, v: F.when(is_source, F.greatest(F.col(c) - v, F.lit(0))).otherwise(F.col(c)).cast("long").alias(c)
    spark = nodes.sparkSession
    fresh = spark.createDataFrame([(new, int(sums.c), int(sums.n))], "node string, cost_ns long, symbol_count long")
    out_nodes = nodes.select("node", less("cost_ns", sums.c), less("symbol_count", sums.n)).union(fresh)
    crossing = part_edges.join(moved.select(F.col("node").alias("src")), "src", "left_semi").join(moved.select(F.col("node").alias("dst")), "dst", "left_anti").limit(1).count()
    inherit = edges.filter(F.col("dst") == source).select("src", F.lit(new).alias("dst"))
    follow = edges.filter(F.col("src") == source).select(F.lit(new).alias("src"), "dst")
    out_edges = edges.union(inherit).union(follow)
    if crossing:
        out_edges = out_edges.union(spark.createDataFrame([(new, source)], "src string, dst string"))
    return out_nodes, out_edges.distinct(), moved


def split_targets(nodes: DataFrame, edges: DataFrame, parts: DataFrame, part_edges: DataFrame, operations: list) -> tuple[DataFrame, DataFrame, list]:
    """nodes and edges after each operation (source, new, selected) in turn, and the components that each one moved.

    parts: graph, node, cost_ns, symbol_count; part_edges: graph, src, dst. Components are those of the
    workspace as it was, so a later operation counts again what an earlier one took from the same
    source. A source that is no target or has no components changes and moves nothing.
    """
    every = []
    for source, new, selected in operations:
        own = cut(parts.filter(F.col("graph") == source).select("node", "cost_ns", "symbol_count"))
        if own.isEmpty() or nodes.filter(F.col("node") == source).isEmpty():
            every.append(own.select("node").limit(0))
            continue
        inner = cut(part_edges.filter(F.col("graph") == source).select("src", "dst"))
        nodes, edges, moved = split_target(nodes, edges, own, inner, source, new, selected)
        nodes, edges = cut(nodes), cut(edges)
        every.append(moved)
    return nodes, edges, every


def shattered(nodes: DataFrame, edges: DataFrame, groups: DataFrame, group_edges: DataFrame, needs: DataFrame, used: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with `target` replaced by target::group_N.

    groups: grp, cost_ns, symbol_count; group_edges: src, dst (group numbers); needs: grp, src (targets that
    a group's symbols refer to); used: grp, dst (targets whose symbols refer to a group's). All that
    waited for the target wait for the last group, and for the groups that they use.
    """
    name = lambda c: F.concat(F.lit(f"{target}::group_"), c.cast("string"))
    known = nodes.filter(F.col("node") != target).select("node")
    out_nodes = nodes.filter(F.col("node") != target).select("node", "cost_ns", "symbol_count").union(groups.select(name(F.col("grp")), "cost_ns", "symbol_count"))
    last = groups.agg(F.max("grp").alias("grp"))
    rest = edges.filter((F.col("src") != target) & (F.col("dst") != target)).select("src", "dst")
    waits = edges.filter(F.col("src") == target).select("dst").join(F.broadcast(last)).select(name(F.col("grp")).alias("src"), "dst")  # one row
    inner = group_edges.filter("src <> dst").select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"))
    before = needs.join(known.withColumnRenamed("node", "src"), "src", "left_semi").select("src", name(F.col("grp")).alias("dst"))
    after = used.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select(name(F.col("grp")).alias("src"), "dst")
    return out_nodes, rest.union(waits).union(inner).union(before).union(after).distinct()


def moved_dependencies(deps: DataFrame, moved: DataFrame, old: str, new: str) -> DataFrame:
    """symbol, dep with the prefix [old] replaced by [new] where the dependency moved. moved: path."""
    hit = moved.select(F.col("path").alias("dep"), F.lit(True).alias("hit"))
    tail = F.substring(F.col("dep"), len(old) + 3, 1 << 30)
    return deps.join(hit, "dep", "left").select("symbol", F.when(F.col("hit") & F.startswith("dep", F.lit(f"[{old}]")), F.concat(F.lit(f"[{new}]"), tail)).otherwise(F.col("dep")).alias("dep")).distinct()
