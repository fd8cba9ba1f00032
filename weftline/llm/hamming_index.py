"""Operator 3: nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred and turned by learned rotations, of which each loses little when only signs are
kept (iterative quantization from different starts); all signs together are the code. The
rotations and the law by which Hamming distance follows from Euclidean distance are fitted on a bounded
sample; every vector is in the index. A part of the index splits its codes into substrings and has
a table of vectors for each value of each substring. By the pigeonhole principle a code within
radius r of the query's agrees with it to r // m bits in one of the m substrings; probing all such
values finds every code within the radius, and Euclidean distances on the original vectors, in double
precision, rank them. The radius of a query is what the law says for the distance at which the sample
lets its neighbours expect, and is widened until enough are found.

Each part of the index is built once, from the vectors that come first in the task; the queries follow
as a stream of blocks, so that no task and not the driver holds them all. Each query is sent to each part.

Nulls and ties: vectors null, empty, zero, of another length than most rows, or with null or
non-finite components take no part; a null id takes no part. Ties go to the smaller id. A repeated
row is a row of its own, but never its own neighbour; a repeated query is asked once. Fewer
candidates give fewer rows; an empty table gives none. Very long vectors make few bits of their most
telling directions. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .held import tidied
from .scratch import partitions, stored

FOUND = "query_id long, vec_id long, score double"


class Codes:
    """The code of a vector: the signs of (v - centre) @ rotation, in words of 64 bits. law: what `radius` needs."""

    def __init__(self, centre: np.ndarray, rotation: np.ndarray):
        self.centre, self.rotation, self.law = centre, rotation, (0.0, 0.0, 0.0)
        self.bits = rotation.shape[1]

    @classmethod
    def fit(cls, x: np.ndarray, bits: int, rounds: int = 20) -> Codes:
        """bits: rounded up to whole rotations of the directions in which the sample varies most."""
        centre = x.mean(axis=0)
        _, _, axes = np.linalg.svd(np.cov((x - centre).T).reshape(x.shape[1], -1) if len(x) > 1 else np.eye(x.shape[1]))
        axes = axes[: min(64, x.shape[1])].T
        v, turns, rnd = (x - centre) @ axes, [], np.random.default_rng(7)
        for _ in range(-(-bits // axes.shape[1])):
            r = np.linalg.qr(rnd.normal(size=(v.shape[1],) * 2))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            turns.append(axes @ r)
        return cls(centre, np.concatenate(turns, axis=1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of uint64."""
        signs = np.packbits((x - self.centre) @ self.rotation > 0, axis=1, bitorder="little")
        out = np.zeros((len(x), -(-self.bits // 64) * 8), np.uint8)
        out[:, : signs.shape[1]] = signs
        return out.view(np.uint64)

    def learn_law(self, sample: np.ndarray, near: int = 32, probes: int = 512) -> None:
        """Hamming distance of near pairs of the sample as a line over their Euclidean distance, and its spread."""
        own, d, h = self(sample), [], []
        for i in range(0, len(sample), max(1, len(sample) // probes)):
            e = distances(sample, sample[i])
            close = np.argpartition(e, min(near, len(e) - 1))[:near]
            close = close[e[close] > 0]
            d.append(e[close])
            h.append(hamming(own[close], own[i]))
        d, h = np.concatenate(d), np.concatenate(h)
        if len(d) < 3 or np.ptp(d) == 0:
            self.law = (0.0, float(self.bits), 0.0)
            return
        slope, base = np.polyfit(d, h, 1)
        self.law = (float(slope), float(base), float(np.std(h - slope * d - base)))

    def radius(self, sample: np.ndarray, q: np.ndarray, k: int, share: float, spreads: float) -> int:
        """The Hamming distance within which the k nearest of the whole table lie, with a margin of some spreads. share: of the table in the sample."""
        e = distances(sample, q)
        e = e[e > 0]
        if not len(e):
            return self.bits
        at = min(len(e) - 1, max(0, int(np.ceil(k * share)) - 1))
        slope, base, spread = self.law
        return int(np.clip(np.ceil(slope * np.partition(e, at)[at] + base + spreads * spread), 0, self.bits))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class MultiIndex:
    """Tables of the codes of some vectors by the values of substrings of `width` bits (a divisor of 64)."""

    def __init__(self, codes: np.ndarray, bits: int, width: int = 16):
        self.codes, self.width = codes, width
        self.values = codes.view({8: np.uint8, 16: np.uint16}[width])[:, : -(-bits // width)]
        self.m, self.tables = self.values.shape[1], []
        for j in range(self.m):
            order = np.argsort(self.values[:, j], kind="stable")
            self.tables.append((order, np.searchsorted(self.values[order, j], np.arange((1 << width) + 1))))
        self.weight, self.probes = np.bitwise_count(np.arange(1 << width, dtype=np.uint32)), {}

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """All rows whose code is within the radius, and how many codes were looked at: those that agree in a substring to radius // m bits."""
        mine, most = code.view(self.values.dtype), radius // self.m
        if most not in self.probes:
            self.probes[most] = np.flatnonzero(self.weight <= most)
        hit = np.zeros(len(self.codes), bool)
        for j, (order, start) in enumerate(self.tables):
            if hit.all():
                break
            probes = self.probes[most] ^ int(mine[j])
            lo, n = start[probes], start[probes + 1] - start[probes]
            lo, n = lo[n > 0], n[n > 0]
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            hit[order[at]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(self.codes[rows], code) <= radius], len(rows)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def prepared(batches, codes: Codes, sample: np.ndarray, k: int, share: float, spreads: float):
    """vec_id, embedding, radius of queries."""
    for b in batches:
        x = vectors_of(b.column(1), b.num_rows)
        r = [codes.radius(sample, q, k, share, spreads) for q in x]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(r, pa.int32())], ["vec_id", "embedding", "radius"])


def vectors_of(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def searched(batches, codes: Codes, k: int):
    """The k nearest of each part for each query. Rows come sorted by part, those of the index (radius null) before the queries."""

    def answers(index, keys, x, q_keys, q, radius):
        out = []
        for key, v, c, r in zip(q_keys.tolist(), q, codes(q), radius.tolist()):
            others = len(keys) - int((keys == key).sum())
            while True:
                rows, _ = index.within(c, r)
                rows = rows[keys[rows] != key]
                if len(rows) >= min(k, others) or r >= codes.bits:
                    break
                r = min(codes.bits, r + codes.bits // 16 + 1)
            d = distances(x[rows], v)
            best = np.lexsort((keys[rows], d))[:k]
            out.append((np.full(len(best), key), keys[rows][best], d[best]))
        a, c, d = map(np.concatenate, zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    part, held, index, keys, x = None, [], None, None, None
    for b in batches:
        parts = b.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            piece = b.slice(lo, hi - lo)
            if part != parts[lo]:
                part, held, index = parts[lo], [], None
            is_query = piece.column("radius").is_valid()
            rows, asked = piece.filter(pc.invert(is_query)), piece.filter(is_query)
            if rows.num_rows:
                held.append((rows.column("vec_id").to_numpy(), vectors_of(rows.column("embedding"), rows.num_rows)))
            if asked.num_rows and held:
                if index is None:
                    keys, x = (np.concatenate(c) for c in zip(*held))
                    index = MultiIndex(codes(x), codes.bits, 16 if len(keys) > 1 << 16 else 8)  # about a vector for each value or more
                yield answers(index, keys, x, asked.column("vec_id").to_numpy(), vectors_of(asked.column("embedding"), asked.num_rows), asked.column("radius").to_numpy())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 256, sample_rows: int = 8192, spreads: float = 2.0, part_rows: int = 1 << 17) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: vec_id, embedding; queries are rows of vectors.

    sample_rows: the rows that the rotations and the law of distances are fitted on. spreads: the
    margin of the radius. part_rows: about how many vectors make a part of the index.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable)
    rows = clean(vectors)
    by_hash = F.xxhash64("vec_id", F.lit("sample"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = sizes[0].d, sizes[0].n
    rows = rows.filter(F.size("embedding") == dims)
    share = min(1.0, 1.5 * sample_rows / n)
    drawn = rows.filter(F.pmod(by_hash, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec_id", "embedding").limit(sample_rows)
    sample = np.array([r.embedding for r in drawn.orderBy("vec_id").collect()], np.float64).reshape(-1, dims)
    if not len(sample):  # a few rows that the draw missed
        sample = np.array([r.embedding for r in rows.limit(sample_rows).collect()], np.float64)
    codes = Codes.fit(sample, bits)
    codes.learn_law(sample)

    asked = clean(queries).filter(F.size("embedding") == dims).distinct()
    asked = asked.mapInArrow(tidied(partial(prepared, codes=codes, sample=sample, k=k, share=len(sample) / n, spreads=spreads)), "vec_id long, embedding array<double>, radius int")
    parts = max(-(-n // part_rows), min(partitions(spark), -(-n // 8192)))
    index = rows.select(F.pmod(F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"), "vec_id", "embedding", F.lit(None).cast("int").alias("radius"))
    asked = stored(asked, "queries").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "embedding", "radius")
    tasks = index.union(asked).repartitionByRange(parts, "part").sortWithinPartitions("part", F.col("radius").isNotNull())
    found = tasks.mapInArrow(tidied(partial(searched, codes=codes, k=k)), FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter("vec_id % 100 = 0"))
