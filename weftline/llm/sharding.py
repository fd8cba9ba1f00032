"""Operator 5: shards of nearly equal bytes, by range partitioning with sampled splitters.

The key of a row is (hash of its text, hash of its row), so equal texts lie side by side.
A sample, drawn with a chance in proportion to the size, gives the splitters of some hundred
ranges; a text that fills several ranges by itself is split by the second part of the key.
Exact bytes and rows of the ranges, and running sums within a range, give each row its place
in the order of the keys, and the place its shard: a range that is too full for one shard is
divided where the shard ends. Texts and rows are never moved, only their sizes and keys.

Law: bytes. A shard differs from total / shards by less than the largest row.
Nulls and ties: a null text has 8 bytes and crc32 0; a null doc_id is a key like any other;
repeated rows are rows of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored


def splitters(rows: DataFrame, total: int, ranges: int, per_range: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a size-weighted sample of about ranges * per_range keys."""
    want = ranges * per_range
    chance = F.col("size") * (want / max(1, total))
    draw = F.pmod(F.xxhash64("h", "salt", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(draw < chance).select("h", "salt", F.greatest(chance, F.lit(1.0)).alias("w"))
    order = Window.orderBy("h", "salt")  # the sample has a fixed size, whatever the table's
    part = sample.select("h", "salt", (F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) * ranges / F.sum("w").over(Window.partitionBy())).alias("q"))
    part = part.select("h", "salt", F.floor(F.col("q") - 1e-9).alias("q"))
    got = part.filter("q > 0").groupBy("q").agg(F.min(F.struct("h", "salt")).alias("k")).select("k.*").collect()
    return sorted({(r.h, r.salt) for r in got})


def range_of(bounds: list[tuple[int, int]]):
    """The number of splitters at or below the key; of splitters with the same text all but one look at the second part."""
    if not bounds:
        return F.lit(0)
    hs = [h for h, _ in bounds]
    salts = [s if hs.count(h) > 1 else -(1 << 63) for h, s in bounds]
    low = F.lit(salts).cast("array<long>")
    return F.size(F.filter(F.lit(hs).cast("array<long>"), lambda b, i: (b < F.col("h")) | ((b == F.col("h")) & (F.get(low, i) <= F.col("salt")))))


def sharded(docs: DataFrame, shards: int = 24, ranges: int = 512, per_range: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("salt")), "keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows = rows.withColumn("rng", range_of(splitters(rows, total, ranges, per_range)))

    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    bases = sums.select("rng", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_base"))

    within = Window.partitionBy("rng").orderBy("h", "salt")
    placed = rows.withColumn("run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("pos", F.row_number().over(within) - 1)
    placed = placed.join(F.broadcast(bases), "rng")  # a row for each range
    middle = F.col("byte_base") + F.col("run") + F.col("size") / 2
    placed = placed.select("doc_id", "size", "text_crc32", F.least(F.floor(middle * shards / max(1, total)), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("row_base") + F.col("pos")).alias("place"))
    placed = stored(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")  # a row for each shard
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
