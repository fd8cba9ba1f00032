"""Operator 9: removal of long byte strings that occur before, by sorted sparse suffixes.

Every string of `length` bytes holds an anchor: the smallest of its k-grams by hash, which is
the same wherever the string occurs. So two occurrences of a string share an anchor at the same
place in it, and it is enough to sort the suffixes at anchors whose k-gram occurs more than once.

1. Anchors, each with hashes of its k-gram and of its context (all bytes that a string around
   it could take up). Of equal contexts only the first occurrence goes on; the others are
   covered as a whole. Each part does that on its own before anything is moved.
2. Where one k-gram has several contexts, the first occurrence of each is sorted by the bytes
   from the anchor on, and by the bytes before it in reverse: multikey quicksort to a shallow depth,
   eight bytes a key, and blind tries for what is still equal there. The common prefixes of neighbours
   tell which occurrences agree to any depth on both sides, and so which strings occur before. A
   k-gram with very many contexts is not sorted in one task: the digests of its strings are grouped.
3. The covered stretches of each text are joined and cut out.

The texts lie in a table in buckets by row, so that steps 2 and 3 do not move them again.

Nulls and ties: a null text is empty; rows come in the order of doc_id (null last), then in the
order in which they are read. Matches never cross rows. Empty and short texts lose nothing. An
empty table gives none. A very long text is one row's work, in stretches of a fixed size but for its
own length. Other columns, whatever their names, come along in `cleaned_documents` and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blind_trie import deep_shallow
from .held import held, tidied
from .near_dup import mixed
from .scratch import free, partitions, scratch_path, stored

LAST = (1 << 63) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i < n."""
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def tables(n: int):
    """Powers for n places, and a number for each byte; those of one chunk are kept."""
    usual = CHUNK + (1 << 12)
    up, down = held("powers", lambda: powers(usual)) if n <= usual else powers(n)
    return up, down, mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best of x[i : i + w] for each i that has w values."""
    have, size = x, 1
    while 2 * size <= w:
        have = best(have[:-size], have[size:])
        size *= 2
    return best(have[: len(x) - w + 1], have[w - size : w - size + len(x) - w + 1])


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """text, position, k-gram hash and context hash of all anchors of some texts of at least `length` bytes."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(texts), np.uint8)
    n, w = len(b), length - k + 1
    up, down, table = tables(n + 1)
    p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[b] * up[:n], dtype=np.uint64)])
    h = mixed((p[k:] - p[:-k]) * down[: n - k + 1]) | np.uint64(1)
    low = sliding(h, w, np.minimum)  # of the k-grams of the string at each position
    start = np.repeat(ends - sizes, sizes)
    end = start + np.repeat(sizes, sizes)
    low[np.arange(n - length + 1) + length > end[: n - length + 1]] = 0  # strings that leave their text
    wide = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(sliding(wide, w, np.maximum) == h)
    left, right = np.maximum(start[at], at - (length - k)), np.minimum(end[at], at + length)
    ctx = mixed((p[right] - p[left]) * down[left]) + (at - left).astype(np.uint64) * BASE + (right - at).astype(np.uint64)
    owner = np.searchsorted(ends, at, "right")
    return owner, at - (ends - sizes)[owner], h[at].view(np.int64), mixed(ctx).view(np.int64)


ANCHORS = "spread long, gram long, ctx long, doc long, rid long, pos int"
#: gram is null in rows that are decided already.


def found_anchors(batches, length: int, k: int):
    """The anchors of a part. Of equal contexts the first one is to be compared; the others are covered."""

    def one(docs, rids, texts):
        owner, pos, gram, ctx = anchors(texts, length, k)
        doc, rid = np.asarray(docs)[owner], np.asarray(rids)[owner]
        order = np.lexsort((pos, rid, doc, ctx, gram))
        owner, pos, gram, ctx, doc, rid = (x[order] for x in (owner, pos, gram, ctx, doc, rid))
        first = np.concatenate([[True], (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])])
        spread = np.where(first, gram, rid)
        return pa.RecordBatch.from_arrays([pa.array(spread), pa.array(gram, mask=~first), pa.array(ctx), pa.array(doc), pa.array(rid), pa.array(pos.astype(np.int32))], ["spread", "gram", "ctx", "doc", "rid", "pos"])

    docs, rids, texts, size = [], [], [], 0
    for b in batches:
        for rid, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if len(text) < length:
                continue
            docs.append(LAST if doc is None else doc)
            rids.append(rid)
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield one(docs, rids, texts)
                docs, rids, texts, size = [], [], [], 0
    if texts:
        yield one(docs, rids, texts)


def decided(batches):
    """rid, pos, gram: occurrences of k-grams that occur more than once. gram is null where a context occurs before, and so all of it is covered."""
    cols = [[] for _ in range(5)]
    for b in batches:
        known = b.column("gram").is_null().to_numpy(zero_copy_only=False)
        if known.any():
            done = b.filter(pa.array(known))
            yield pa.RecordBatch.from_arrays([done.column("rid"), done.column("pos"), pa.nulls(done.num_rows, pa.int64())], ["rid", "pos", "gram"])
        rest = b.filter(pa.array(~known))
        for c, name in zip(cols, ("gram", "ctx", "doc", "rid", "pos")):
            c.append(rest.column(name).to_numpy())
    if not cols[0]:
        return
    gram, ctx, doc, rid, pos = map(np.concatenate, cols)
    del cols
    order = np.lexsort((pos, rid, doc, ctx, gram))
    gram, ctx, rid, pos = gram[order], ctx[order], rid[order], pos[order]
    if not len(gram):
        return
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    first = new | np.concatenate([[True], ctx[1:] != ctx[:-1]])
    group = np.cumsum(new) - 1
    several = np.bincount(group, weights=first)[group] > 1
    out = ~first | several
    yield pa.RecordBatch.from_arrays([pa.array(rid[out]), pa.array(pos[out]), pa.array(gram[out], mask=~first[out])], ["rid", "pos", "gram"])


def strings(batches, length: int, k: int):
    """start of each string around the anchors of crowded k-grams, and its digest."""
    for b in batches:
        out = []
        for rid, doc, text, asked in zip(*(b.column(i).to_pylist() for i in range(4))):
            starts = {p for x in asked if x["crowded"] for p in range(max(0, x["pos"] - (length - k)), min(x["pos"], len(text) - length) + 1)}
            out += [(hashlib.blake2b(text[p : p + length], digest_size=16).digest(), LAST if doc is None else doc, rid, p) for p in starts]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["key", "doc", "rid", "lo"])


def contexts(batches, length: int, k: int):
    """gram, doc, rid, pos and the bytes on either side, the left ones reversed."""
    for b in batches:
        out = []
        for rid, doc, text, asked in zip(*(b.column(i).to_pylist() for i in range(4))):
            for x in asked:
                if x["crowded"]:
                    continue
                p = x["pos"]
                out.append((x["gram"], LAST if doc is None else doc, rid, p, text[max(0, p - (length - k)) : p][::-1], text[p : p + length]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["gram", "doc", "rid", "pos", "left", "right"])


def cover(doc, rid, pos, left: list[bytes], right: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the stretch around its anchor (bytes before, bytes from it on) whose strings occur before; 0, 0 for none."""
    n = len(pos)
    before, after = np.full(n, -1), np.full(n, -1)
    if not n:
        return before, after
    rank = np.empty(n, np.int64)
    rank[np.lexsort((pos, rid, doc))] = np.arange(n)
    lsize, rsize = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    (lorder, llcp), (rorder, rlcp) = deep_shallow(left), deep_shallow(right)
    lgroup, rgroup = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(length - k + 1):
        lgroup[lorder], rgroup[rorder] = np.cumsum(llcp < o), np.cumsum(rlcp < length - o)
        has = np.flatnonzero((lsize >= o) & (rsize >= length - o))
        key = lgroup[has] * (n + 1) + rgroup[has]
        order = np.lexsort((rank[has], key))
        later = has[order[1:]][key[order[1:]] == key[order[:-1]]]
        before[later] = o
        after[later] = np.where(after[later] < 0, length - o, after[later])
    return before, after


def covered(batches, length: int, k: int):
    cols = [[] for _ in range(5)]
    for b in batches:
        for c, i in zip(cols, range(1, 6)):
            c += b.column(i).to_pylist()
    doc, rid, pos, left, right = cols
    doc, rid, pos = (np.array(x, np.int64) for x in (doc, rid, pos))
    before, after = cover(doc, rid, pos, left, right, length, k)
    ok = before >= 0
    yield pa.RecordBatch.from_arrays([pa.array(rid[ok]), pa.array((pos - before)[ok]), pa.array((pos + after)[ok])], ["rid", "lo", "hi"])


def merged(spans: np.ndarray, n: int) -> np.ndarray:
    """Sorted, disjoint and not touching, as rows (lo, hi) within 0..n."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = np.clip(spans[np.argsort(spans[:, 0], kind="stable")], 0, n)
    top = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > top[:-1]])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], top[np.append(at[1:], len(spans)) - 1]], 1)


RESULT = "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(batches, length: int, k: int, texts: bool):
    for b in batches:
        out = []
        for rid, doc, text, full, part in zip(*(b.column(i).to_pylist() for i in range(5))):
            n = len(text)
            p = np.array(full or [], np.int64)
            spans = np.concatenate([np.stack([p - (length - k), p + length], 1), np.array([(x["lo"], x["hi"]) for x in part or []], np.int64).reshape(-1, 2)])
            spans = merged(spans, n).tolist()
            if spans:
                edges = [0, *(x for s in spans for x in s), n]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))
            else:
                kept = text
            row = (rid, doc, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode("utf-8", "ignore")) if texts else row)
        kinds = (pa.int64(),) * 5 + (pa.string(),) * (2 if texts else 1)
        names = ["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)] + ([b.column(5)] if texts else []), names + ["row"] * texts)


def repeats_removed(docs: DataFrame, length: int = 100, k: int = 50, whole: bool = False, crowd: int = 1000) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    whole: also kept, the text without characters of which a part is gone, and a struct `row` of the other columns of docs.
    crowd: a k-gram with more contexts than that is not sorted in one task; its strings are summed up by their digests instead, with the same result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] * whole
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *row)
    name = f"weftline_texts_{uuid.uuid4().hex}"
    rows.repartition(n, "rid").write.bucketBy(n, "rid").option("path", scratch_path(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: rows knows its files and buckets

    marks = rows.select("rid", "doc_id", "text").mapInArrow(tidied(partial(found_anchors, length=length, k=k)), ANCHORS)
    marks = stored(marks.repartition(n, "spread").mapInArrow(decided, "rid long, pos int, gram long"), "marks")
    crowded = stored(marks.filter("gram is not null").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("gram", F.lit(True).alias("crowded")), "crowded")
    asked = marks.filter("gram is not null").join(crowded, "gram", "left")
    asked = asked.groupBy("rid").agg(F.collect_list(F.struct("pos", "gram", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("asked"))
    asked = rows.select("rid", "doc_id", "text").join(asked, "rid")
    around = asked.select("rid", "doc_id", "text", "asked").mapInArrow(tidied(partial(contexts, length=length, k=k)), "gram long, doc long, rid long, pos int, left binary, right binary")
    part = stored(around.repartition(n, "gram").mapInArrow(tidied(partial(covered, length=length, k=k)), "rid long, lo long, hi long"), "part")
    if not crowded.isEmpty():
        every = asked.filter(F.exists("asked", lambda x: x["crowded"])).select("rid", "doc_id", "text", "asked").mapInArrow(tidied(partial(strings, length=length, k=k)), "key binary, doc long, rid long, lo long")
        every = stored(every.distinct(), "strings")
        first = every.groupBy("key").agg(F.min(F.struct("doc", "rid", "lo")).alias("first"))
        again = every.join(first, "key").filter(F.struct("doc", "rid", "lo") != F.col("first"))
        part = part.union(stored(again.select("rid", "lo", (F.col("lo") + length).alias("hi")), "again"))

    full = marks.filter("gram is null").groupBy("rid").agg(F.collect_list("pos").alias("full"))
    part = part.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("part"))
    every = rows.join(full, "rid", "left").join(part, "rid", "left").select("rid", "doc_id", "text", "full", "part", *["row"] * whole)
    schema = StructType.fromDDL(RESULT + ", kept string" * whole)
    return every.mapInArrow(tidied(partial(cut, length=length, k=k, texts=whole)), schema.add(rows.schema["row"]) if whole else schema)


def cleaned_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeats cut out of their texts; all rows and columns stay. A null text stays null."""
    null = free(docs.columns, "no_text")
    out = repeats_removed(docs.withColumn(null, F.col("text").isNull()), whole=True, **options)
    text = F.when(~F.col("row").getField(null), F.col("kept"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeats_removed(docs).drop("rid")
