"""Operator 2: documents packed into windows by counts that least squares gives.

Documents longer than the window give whole windows first. What is left of each document has
a length below the window; the lengths fall into classes of equal width. A pattern is a
multiset of a few classes whose sum is the window. Non-negative least squares finds how often
each pattern is to be used so that the patterns use up the histogram of the lengths; counts
are rounded down to what there is. The documents of a class take the places of the patterns
in row order. The rest of the documents is a stream of tokens that fills, in order, the gaps
which the patterns leave and then windows of its own; it is cut where a gap ends.

Only the histogram (one row for each length below the window) comes to the driver.

Nulls and ties: a null text is empty and gives its end id only; equal rows are packed like any
others; a null doc_id stays null. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .held import tidied
from .scratch import stored
from .words import in_slices, library_encoder

TOKENS = "rid long, doc_id long, n_tokens long, ids binary"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """rid (a number for the row), doc_id, n_tokens, ids; stored, so that rid stays as it is."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def encode(batches):
        enc = library_encoder(tokenizer)
        width, end = int(enc.dtype[-1]), np.asarray([end_id], enc.dtype).tobytes()
        for b in in_slices(batches):
            ids = enc.batch(b.column(2).to_pylist(), end)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.divide(pc.cast(pc.binary_length(ids), pa.int64()), width), ids], ["rid", "doc_id", "n_tokens", "ids"])

    return stored(rows.mapInArrow(tidied(encode), TOKENS), "tokens")


def patterns(total: int, parts: int) -> np.ndarray:
    """All multisets of at most `parts` classes 1..total with sum total, as rows of counts."""
    found = []

    def go(left, top, have, parts):
        if not left:
            found.append(have)
        elif parts and top * parts >= left:
            for c in range(min(left, top), 0, -1):
                if c * parts < left:
                    break
                go(left - c, c, (*have, c), parts - 1)

    go(total, total, (), parts)
    out = np.zeros((len(found), total + 1))
    for row, have in zip(out, found):
        np.add.at(row, list(have), 1)
    return out[:, 1:]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[used] = -np.inf
        j = int(np.argmax(w)) if n else 0
        if not n or w[j] <= tol:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 1e-12
            gap = x[at][low] - z[low]
            step = np.min(np.where(gap > 0, x[at][low] / np.where(gap > 0, gap, 1), 0))
            x[at] += step * (z - x[at])
            used[at[x[at] <= 1e-12]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def plan(histogram: dict[int, int], window: int, classes: int = 64, parts: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of class counts) and how often each is used.

    The counts never need more documents of a class than there are, and leave tokens enough
    to fill the gaps of the windows (as long as any are left at all).
    """
    width = window // classes
    have, tokens = np.zeros(classes), np.zeros(classes)
    for length, n in histogram.items():
        c = -(-length // width) - 1
        have[c] += n
        tokens[c] += n * length
    shapes = patterns(classes, parts)
    if not have.any():
        return shapes[:0], np.zeros(0, np.int64)
    mean = np.divide(tokens, have, out=np.zeros(classes), where=have > 0)
    x = nnls(shapes.T.copy(), have)
    keep = x >= 1
    shapes, counts = shapes[keep], np.floor(x[keep]).astype(np.int64)
    while ((over := counts @ shapes - have) > 0).any():
        c = int(np.argmax(over))
        p = int(np.argmax(np.where(shapes[:, c] > 0, counts, -1)))
        counts[p] -= 1
    while counts.sum() and window * counts.sum() > tokens.sum():
        counts = (counts * 0.97).astype(np.int64)
    while counts.sum() > 50 and (have - counts @ shapes) @ mean < 1.02 * (window * counts.sum() - counts @ (shapes @ mean)):
        counts = (counts * 0.99).astype(np.int64)
    keep = counts > 0
    return shapes[keep], counts[keep]


def places(shapes: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """(class, first rank, end rank, number of the class in the pattern, first sequence, place of its first piece)."""
    out, taken, sequence = [], np.zeros(shapes.shape[1], np.int64), 0
    for shape, n in zip(shapes.astype(int), counts.tolist()):
        place = 0
        for c in np.flatnonzero(shape):
            m = int(shape[c])
            out.append((int(c) + 1, int(taken[c]), int(taken[c]) + n * m, m, sequence, place))
            taken[c] += n * m
            place += m
        sequence += n
    return out


def running(df: DataFrame, bucket: str, order: str, value: str, by: list[str], out: str) -> DataFrame:
    """out: the sum of value over the rows before, in the order of (bucket, order); in two levels, so that no task gets all rows."""
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_run", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [*by, bucket]).withColumn(out, F.col("_base") + F.col("_run")).drop("_run", "_base")


def fill(window: int, gaps_total: int, tail: int, size: int):
    """For one stretch of positions: pieces of the stream's documents, cut where gaps end."""

    def cut(key, pdf):
        import pandas as pd

        lo, hi = key[0] * size, (key[0] + 1) * size
        docs = pdf[pdf.kind == 0].sort_values("at")
        gaps = pdf[pdf.kind == 1].sort_values("at")
        end = int((docs["at"] + docs["size"]).max()) if len(docs) else lo
        hi, first = min(hi, end), max(lo, gaps_total)
        own = np.arange(first + (gaps_total - first) % window, hi, window) if hi > first else np.zeros(0, np.int64)
        cuts = np.unique(np.concatenate([[lo], docs["at"].to_numpy(), gaps["at"].to_numpy(), [min(gaps_total, hi)], own]).astype(np.int64))
        cuts = cuts[(cuts >= lo) & (cuts < hi)]
        if not len(cuts) or not len(docs):
            return pd.DataFrame(columns=["rid", "start", "length", "sequence_id", "offset"]).astype("int64")
        stop = np.append(cuts[1:], hi)
        d = np.searchsorted(docs["at"].to_numpy(), cuts, "right") - 1
        start = docs["first"].to_numpy()[d] + cuts - docs["at"].to_numpy()[d]
        sequence, offset = tail + (cuts - gaps_total) // window, (cuts - gaps_total) % window
        inside = cuts < gaps_total
        if inside.any():
            g = np.searchsorted(gaps["at"].to_numpy(), cuts[inside], "right") - 1
            sequence[inside] = gaps["rid"].to_numpy()[g]
            offset[inside] = gaps["first"].to_numpy()[g] + cuts[inside] - gaps["at"].to_numpy()[g]
        return pd.DataFrame({"rid": docs["rid"].to_numpy()[d], "start": start, "length": stop - cuts, "sequence_id": sequence, "offset": offset})

    return cut


def pieces(tokens: DataFrame, window: int = 4096, classes: int = 64, parts: int = 6, size: int = 1 << 20) -> DataFrame:
    """rid, start, length, sequence_id, offset: where the tokens of each row go. tokens: rid, n_tokens."""
    spark = tokens.sparkSession
    width = window // classes
    rows = tokens.select("rid", F.shiftright("rid", 33).alias("pid"), F.floor(F.col("n_tokens") / window).cast("long").alias("whole"), (F.col("n_tokens") % window).alias("rest"))
    rest = rows.filter("rest > 0").withColumn("class", F.ceil(F.col("rest") / width).cast("int"))
    histogram = {r["rest"]: r["count"] for r in rest.groupBy("rest").count().collect()}
    shapes, counts = plan(histogram, window, classes, parts)
    table = places(shapes, counts)
    n_pattern = int(counts.sum())

    where = spark.createDataFrame(table, "class int, lo long, hi long, m int, seq long, place int")
    ranked = running(rest.withColumn("one", F.lit(1)), "pid", "rid", "one", ["class"], "rank")
    # one row for each class of each pattern in use: at most classes * parts rows
    placed = ranked.join(F.broadcast(where).withColumnRenamed("class", "c"), (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    placed = stored(placed.select("rid", "pid", "whole", "rest", (F.col("seq") + F.expr("(rank - lo) div m")).alias("sequence_id"), (F.col("place") + F.expr("(rank - lo) % m")).alias("place")), "placed")

    inside = placed.filter("sequence_id is not null")
    order = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    first = inside.select("rid", (F.col("whole") * window).alias("start"), F.col("rest").alias("length"), "sequence_id", F.coalesce(F.sum("rest").over(order), F.lit(0)).alias("offset"))

    gaps = inside.groupBy("sequence_id").agg(F.sum("rest").alias("first")).select("sequence_id", "first", (window - F.col("first")).alias("size"), F.shiftright("sequence_id", 16).alias("pid")).filter("size > 0")
    gaps = running(gaps, "pid", "sequence_id", "size", [], "at").select(F.lit(1).alias("kind"), F.col("sequence_id").alias("rid"), "first", "size", "at")
    stream = placed.filter("sequence_id is null")
    stream = running(stream, "pid", "rid", "rest", [], "at").select(F.lit(0).alias("kind"), "rid", (F.col("whole") * window).alias("first"), F.col("rest").alias("size"), "at")
    both = stored(gaps.union(stream), "stream")
    sums = {r.kind: r.n for r in both.groupBy("kind").agg(F.sum("size").alias("n")).collect()}
    n_gap, n_stream = sums.get(1, 0), sums.get(0, 0)
    tails = max(0, -(-(n_stream - n_gap) // window))
    spread = both.withColumn("bucket", F.explode(F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + size - 1) div {size}"))))
    second = spread.groupBy("bucket").applyInPandas(fill(window, n_gap, n_pattern, size), "rid long, start long, length long, sequence_id long, offset long")

    whole = running(rows.filter("whole > 0"), "pid", "rid", "whole", [], "before")
    whole = whole.select("rid", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("k"), "before")
    third = whole.select("rid", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), (n_pattern + tails + F.col("before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return first.union(second).union(third)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """One row for each piece, with its ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary), width (bytes an id)."""
    tokens = tokenized(docs, tokenizer, end_id)
    spans = pieces(tokens.select("rid", "n_tokens"), window)
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spans"))
    width = F.expr("length(ids) div n_tokens")
    out = tokens.join(spans, "rid").select("doc_id", "ids", F.col("n_tokens").alias("doc_tokens"), width.alias("width"), F.explode("spans").alias("s"))
    cut = F.substring("ids", (F.col("s.start") * F.col("width") + 1).cast("int"), (F.col("s.length") * F.col("width")).cast("int"))
    return out.select("doc_id", "s.start", "s.length", "doc_tokens", "s.sequence_id", "s.offset", cut.alias("ids"), "width")


def digest(df: DataFrame) -> DataFrame:
    """ids replaced by the crc32 of the ids as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def crc(batches):
        for b in batches:
            c = {n: b.column(n) for n in b.schema.names}
            crcs = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(c["ids"].to_pylist(), c["width"].to_pylist())]
            yield pa.RecordBatch.from_arrays([c["doc_id"], c["start"], c["length"], pa.array(crcs, pa.int64()), c["doc_tokens"], c["sequence_id"], c["offset"]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return df.mapInArrow(tidied(crc), schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(packed(docs, public_tokenizers.path("word_bpe_49k.json")))
