"""Connected components of a table of links, in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links and the smallest node that each reaches, by pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        differ = p != q
        if not differ.any():
            return nodes, nodes[root]
        x, y = x[differ], y[differ]
        np.minimum.at(root, np.maximum(p, q)[differ], np.minimum(p, q)[differ])
        while (root[root] != root).any():
            root = root[root]


def forest(batches, most: int = 2_000_000):
    """The links of a partition, less those that follow from others; at most `most` are held at once."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        if len(held[0]) >= most:
            nodes, root = union(*held)
            if 2 * np.count_nonzero(nodes != root) > most:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != root]), pa.array(root[nodes != root])], ["a", "b"])
                nodes = root = nodes[:0]
            held = [nodes[nodes != root], root[nodes != root]]
    nodes, root = union(*held)
    yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != root]), pa.array(root[nodes != root])], ["a", "b"])


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: each node of links (a, b) and the smallest node that it reaches.

    Large-star and small-star rounds: each node's neighbours are joined to its smallest one, until
    every link leads to a root. Each partition first drops the links that follow from its others.
    A hot node is a group of partial minima and one side of a join that Spark can split.
    """
    links = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(forest, "a long, b long"), "links")
    for _ in range(rounds):
        # large star: the larger neighbours of u, and u's smallest
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours of u and u itself, and u's smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        down = stored(down.mapInArrow(forest, "a long, b long").distinct(), "links")
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        if least.filter("n > 1").limit(1).count() == 0:
            tops = down.select(F.col("b").alias("a")).join(down.select("a"), "a", "left_semi").limit(1).count()
            if tops == 0:
                links = down
                break
            hop = down.select(F.col("a").alias("c"), F.col("b").alias("d"))
            links = stored(down.join(hop, F.col("b") == F.col("c"), "left").select("a", F.coalesce("d", "b").alias("b")), "links")
            continue
        small = down.join(least.select(F.col("a").alias("u"), "m"), F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.*").filter("a <> b")
        links = stored(small.mapInArrow(forest, "a long, b long").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
