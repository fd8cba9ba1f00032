"""Operator 8: near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its word shingles. Documents with equal sets are one class; what
follows looks at one member of each class. A tree sorts the classes by a signature of its own, 16 bits
of each minimum; neighbours in that order with a long enough common prefix are candidates. The depth is adaptive:
a region that few classes share is joined at the shallow depth, a crowded one is cut value by value, to the whole depth at most.
Candidates form groups; a group's sets are compared in full, and links are the pairs that reach
the similarity. Comparing looks at each set's difference from the sets' majority, so that a
group of near copies takes about linear time: members close to the centre are linked through
one of them, and only the others are looked up by the shingles in which they differ. A group
beyond a size in bytes is dealt into blocks, and each pair of blocks is compared on its own.

A link at the similarity is missed if no tree joins it. The number of trees and the deep depth
follow from the similarity, so that this happens to 1.2 in 100,000 links at most (24 trees of depth
6 at 0.85, 29 of depth 5 at 0.8), and to fewer where regions are sparse. Sets are sets of 64-bit hashes.

Nulls and ties: a document without text or words has an empty set and is linked with nothing.
Equal rows are linked; rows with the same doc_id are rows of their own. A null doc_id counts as
larger than all others. An empty table gives none. A very long text is one set, whatever its length.
Other columns, whatever their names, come along in `kept_documents` and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import components
from .held import held, tidied
from .scratch import discard, noted, partitions, release, stored

SPACES = re.compile("[\x20\x09-\x0d]+")
SHALLOW, DEEP, MOST_TREES, MISS = 4, 6, 32, 1.2e-5
LOWER = {c: c + 32 for c in range(65, 91)}
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(33))) * M2
    return h ^ (h >> np.uint64(33))


class Words(dict):
    def __missing__(self, w):
        if len(self) > 300_000:
            self.clear()
        out = self[w] = xxhash.xxh64_intdigest(w.encode())
        return out


def shingles(text: str | None, k: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, lower-cased from A to Z; of the whole sequence if it is shorter."""
    words = SPACES.split((text or "").translate(LOWER))
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(held("words", Words).__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(20240229)
    return rnd.integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(1 << 63, size=n, dtype=np.uint64)


def forest(p: int, q: int) -> tuple[int, int]:
    """Trees and deep depth for links at p / q: the deepest whose trees, MOST_TREES at most, miss a link at p / q with a chance of MISS; at depth 1 as many as that takes."""
    for deep in range(DEEP, 0, -1):
        met = min(1 - 1e-9, (p / q) ** deep)
        trees = math.ceil(math.log(MISS) / math.log1p(-met))
        if trees <= MOST_TREES:
            break
    return trees, deep


def signatures(sets: list[np.ndarray], trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set (none empty) and tree the signature of depth values, 16 bits of each: the first four in one number and the rest in another, so that numbers sort as signatures do."""
    every, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    mul, add = multipliers(trees * depth)
    out = np.zeros((2, len(sets), trees), np.uint64)
    for j in range(trees * depth):
        t, d = divmod(j, depth)
        low = np.minimum.reduceat((every ^ add[j]) * mul[j], at)
        out[d // SHALLOW, :, t] |= (mixed(low) >> np.uint64(48)) << np.uint64(48 - 16 * (d % SHALLOW))
    return out[0], out[1]


def signed(docs: DataFrame, k: int, trees: int, depth: int, whole: bool) -> DataFrame:
    """rid, doc_id, n_shingles, digest (of the set), head and tail (of the signature in each tree), and a struct `row`: the text, or with whole the row of docs."""
    names = docs.columns if whole else ["text"]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    place = names.index("text")

    def sign(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                sets = [shingles(t, k) for t in part.column(2).field(place).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                head, tail = [None] * len(sets), [None] * len(sets)
                if full:
                    x, y = signatures([sets[i] for i in full], trees, depth)
                    for j, i in enumerate(full):
                        head[i], tail[i] = x[j].view(np.int64), y[j].view(np.int64)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = lambda x: pa.array(x, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists(head), lists(tail), part.column(2)], ["rid", "doc_id", "n_shingles", "digest", "head", "tail", "row"])

    schema = StructType.fromDDL("rid long, doc_id long, n_shingles long, digest binary, head array<long>, tail array<long>").add(rows.schema["row"])
    return stored(rows.mapInArrow(tidied(sign), schema), "signed")


PART = "tree int, head long, tail long, a long, b long, n long"
#: n is 0 in rows that are links (a, b); the others are signatures, with their first class a and the number of their classes.


def sorted_part(batches, trees: int):
    """A part's signatures in the order of each tree: links between classes of equal ones, and the distinct ones."""
    rids, head, tail = [np.zeros(0, np.int64)], [np.zeros((0, trees), np.int64)], [np.zeros((0, trees), np.int64)]
    for b in batches:
        if b.num_rows:
            rids.append(b.column(0).to_numpy())
            head.append(b.column(1).flatten().to_numpy().reshape(-1, trees))
            tail.append(b.column(2).flatten().to_numpy().reshape(-1, trees))
    rids, head, tail = map(np.concatenate, (rids, head, tail))
    out = []
    for t in range(trees if len(rids) else 0):
        order = np.lexsort((rids, tail[:, t], head[:, t]))
        x, y = head[order, t], tail[order, t]
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        n = np.diff(np.append(first, len(x)))
        same = rids[order][np.repeat(first, n)]
        link = same != rids[order]
        zero = np.zeros(link.sum(), np.int64)
        out.append((zero, zero, zero, rids[order][link], same[link], zero))
        out.append((np.full(len(first), t), x[first], y[first], rids[order][first], np.full(len(first), -1), n))
    for c in out:
        yield pa.RecordBatch.from_arrays([pa.array(c[0].astype(np.int32))] + [pa.array(x, pa.int64()) for x in c[1:]], ["tree", "head", "tail", "a", "b", "n"])


def neighbours(batches, depth: int, few: int):
    """Candidates from the signatures that agree in the first values of a tree, sorted.

    The common prefix of neighbours in the order cuts it into regions. From the shallow depth on, a
    region of few classes is joined at its depth; a crowded one is cut by the next value, down to the whole depth.
    """
    cols = [np.concatenate(c) for c in zip(*([b.column(i).to_numpy() for i in range(5)] for b in batches))] or [np.zeros(0, np.int64)] * 5
    tree, head, tail, a, n = cols
    if not len(a):
        return
    tail = tail.view(np.uint64)
    order = np.lexsort((a, tail, head, tree))
    tree, head, tail, a, n = (x[order] for x in (tree, head, tail, a, n))
    shallow = min(SHALLOW, depth)
    differ = tail[1:] ^ tail[:-1]
    prefix = shallow + sum((differ >> np.uint64(s) == 0).astype(np.int64) for s in (48, 32, 16, 0))
    prefix[(tree[1:] != tree[:-1]) | (head[1:] != head[:-1])] = 0
    joined = np.zeros(len(a), bool)
    for d in range(shallow, depth + 1):
        first = np.flatnonzero(np.concatenate([[True], prefix < d]))
        length = np.diff(np.append(first, len(a)))
        region = np.repeat((np.add.reduceat(n, first) <= few) | (d == depth), length) & ~joined
        top = np.repeat(a[first], length)
        ok = region & (top != a)
        joined |= region
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(top[ok])], ["a", "b"])


def linked(sets: list[np.ndarray], p: int, q: int, root: np.ndarray) -> None:
    """Union in root (node -> node) all pairs of sets with q * |a & b| >= p * |a | b|.

    With M the shingles that most sets hold, D = A ^ M and S = |A| + |B|, the symmetric
    difference of A and B is |DA| + |DB| - 2 |DA & DB|, and a pair is linked if and only if
    (q + p) * difference <= (q - p) * S.
    """
    n = len(sets)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)

    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if q * both >= p * (len(sets[0]) + len(sets[1]) - both):
            join(0, 1)
        return
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = 2 * count > n
    m = int(common.sum())
    # the differences as (owner, shingle): what a set has beside M, and what it lacks of M
    beside = ~common[ids]
    where = np.full(len(count), -1)
    where[common] = np.arange(m)
    lacking = np.ones((n, m), bool) if m * n <= 1 << 26 else None
    if lacking is None:
        common[:] = False  # sets too large for the table: M is empty and D = A
        m, beside = 0, np.ones(len(ids), bool)
        lacking = np.zeros((n, 0), bool)
    else:
        lacking[owner[~beside], where[ids[~beside]]] = False
    lo, lm = np.nonzero(lacking)
    d_owner, d_id = np.concatenate([owner[beside], lo]), np.concatenate([ids[beside], np.flatnonzero(common)[lm]])
    d = np.bincount(d_owner, minlength=n)
    g = (q + p) * d - (q - p) * sizes
    best = int(np.argmin(g))
    for i in np.flatnonzero(g + g[best] <= 0):
        join(best, int(i))
    rest = np.flatnonzero(g + g[best] > 0)
    if not len(rest):
        return
    by_id = np.argsort(d_id, kind="stable")
    start = np.searchsorted(d_id[by_id], np.arange(len(count) + 1))
    by_owner = np.argsort(d_owner, kind="stable")
    own = np.searchsorted(d_owner[by_owner], np.arange(n + 1))
    holders = d_owner[by_id]
    for i in rest:
        mine = d_id[by_owner[own[i] : own[i + 1]]]
        near = np.concatenate([holders[start[x] : start[x + 1]] for x in mine]) if len(mine) else np.zeros(0, int)
        both = np.bincount(near, minlength=n)
        for j in np.flatnonzero((g[i] + g <= 2 * (q + p) * both) & (np.arange(n) != i)):
            join(int(i), int(j))


def compared(batches, k: int, p: int, q: int):
    """Links (a, b) of each group. Rows come sorted by task; a task's rows are held together."""

    def done(rids, texts):
        root = np.arange(len(rids))
        linked([shingles(t, k) for t in texts], p, q, root)
        return [(rids[i], rids[r]) for i, r in enumerate(root) if r != i]

    task, rids, texts, out = None, [], [], []
    for b in batches:
        for t, rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if t != task:
                out += done(rids, texts) if len(rids) > 1 else []
                task, rids, texts = t, [], []
            rids.append(rid)
            texts.append(text)
    out += done(rids, texts) if len(rids) > 1 else []
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def matched(docs: DataFrame, k: int, p: int, q: int, few: int, block_bytes: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """The signed rows, stored, and what `near_duplicates` gives for them."""
    spark = docs.sparkSession
    trees, depth = forest(p, q)
    rows = signed(docs, k, trees, depth, whole)
    narrow = rows.select("rid", "doc_id", "n_shingles", "digest")
    classes = stored(narrow.filter("digest is not null").groupBy("digest").agg(F.min("rid").alias("cid"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")), "classes")
    reps = rows.select("rid", "head", "tail").join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi")
    parts = stored(reps.select("rid", "head", "tail").mapInArrow(tidied(partial(sorted_part, trees=trees)), PART), "signatures")
    across = parts.filter("n > 0").select("tree", "head", "tail", "a", "n").repartition(partitions(spark), "tree", "head").mapInArrow(tidied(partial(neighbours, depth=depth, few=few)), "a long, b long")
    groups = stored(components(parts.filter("n = 0").select("a", "b").union(across)), "groups")
    discard(parts)

    members = groups.join(rows.select(F.col("rid").alias("node"), F.col("row.text").alias("text")), "node").select("root", F.col("node").alias("rid"), "text")
    sizes = groups.join(rows.select(F.col("rid").alias("node"), F.octet_length("row.text").alias("size")), "node").groupBy("root").agg(F.sum("size").alias("size"))
    blocks = sizes.select("root", F.when(F.col("size") <= block_bytes, 1).otherwise(F.ceil(F.col("size") * 2 / block_bytes)).cast("int").alias("blocks"))
    members = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    tasks = members.select("root", "rid", "text", "block", F.explode(F.when(F.col("blocks") > 1, F.filter(other, lambda o: o != F.col("block"))).otherwise(other)).alias("o"))
    tasks = tasks.select(F.xxhash64("root", F.least("block", "o"), F.greatest("block", "o")).alias("task"), "rid", "text")
    links = tasks.repartition(partitions(spark), "task").sortWithinPartitions("task", "rid").mapInArrow(tidied(partial(compared, k=k, p=p, q=q)), "a long, b long")
    joined = components(links)

    of_class = classes.select("digest", "least", "cid").join(joined.select(F.col("node").alias("cid"), "root"), "cid", "left").select("digest", "least", F.coalesce("root", "cid").alias("root"))
    tops = of_class.groupBy("root").agg(F.min("least").alias("top"))
    of_class = of_class.join(tops, "root").select("digest", F.col("top.doc_id").alias("component_id"), F.col("top.rid").alias("first"))
    out = narrow.join(of_class, "digest", "left").select("rid", "doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first", "rid").alias("first"))
    return rows, out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, few: int = 64, block_bytes: int = 4 << 20) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, first (the rid of the one to keep), kept; links at q * |a & b| >= p * |a | b|.

    few: classes that a region may hold to be joined above the whole depth. block_bytes: a group with
    more text is compared in blocks of half of that, pair by pair.
    """
    return matched(docs, k, p, q, few, block_bytes, False)[1]


def kept_documents(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, few: int = 64, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs that are kept, one for each component, with all their columns.

    The rows are stored once, beside their signatures. Those that go are stored by number, so that
    Spark sees their size and moves the rows only if it has to; all other tables are deleted.
    """
    made: list[str] = []
    with noted(made):
        rows, found = matched(docs, k, p, q, few, block_bytes, True)
        gone = stored(found.filter("rid <> first").select("rid"), "gone")
    release(made, rows, gone)
    return rows.join(gone, "rid", "left_anti").select("row.*")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=3, p=85).select("doc_id", "n_shingles", "component_id", "kept")
