"""Operator 1: token ids of a corpus, concatenated, with Elias-Fano document boundaries.

A store is a folder of Parquet files whose rows are segments. A segment holds the ids of
consecutive documents back to back, and two Elias-Fano sequences: the ends of the documents
and their doc_ids. Rows of a shard follow each other; shards follow each other in doc_id order.

Nulls and ties: a null text is empty; rows with a null doc_id come first; rows with the same
doc_id follow each other in the order of their texts. An empty table gives an empty store.
Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .held import tidied
from .scratch import partitions, scratch_path
from .words import in_slices, library_encoder

MAGIC = b"WTS1"
HEAD = struct.Struct("<4sBxxxIq")
SCHEMA = "shard int, segment int, base long, n_docs long, n_tokens long, blob binary"
READ = "doc_id long, start long, n_tokens long, ids binary"


def pack_segment(doc_ids: list, pieces: list[bytes], width: int) -> bytes:
    """doc_ids ascending, nulls first; one piece of id bytes for each."""
    nulls = sum(x is None for x in doc_ids)
    known = np.asarray(doc_ids[nulls:], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(p) // width for p in pieces])
    head = HEAD.pack(MAGIC, width, nulls, first)
    return head + EliasFano.encode(ends).to_bytes() + EliasFano.encode((known - first).astype(np.uint64)).to_bytes() + b"".join(pieces)


class Segment:
    """Random access to the documents of one segment."""

    def __init__(self, blob: bytes):
        magic, self.width, self.nulls, self.first = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        view = memoryview(blob)
        self.ends, a = EliasFano.from_bytes(view[HEAD.size :])
        self.keys, b = EliasFano.from_bytes(view[HEAD.size + a :])
        self.body = view[HEAD.size + a + b :]

    def __len__(self) -> int:
        return self.ends.n

    def span(self, i: int) -> tuple[int, int]:
        """Offsets of document i in the segment, by two selects."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return np.frombuffer(self.body[a * self.width : b * self.width], f"<u{self.width}")

    def doc_ids(self) -> list:
        return [None] * self.nulls + (self.keys.values() + self.first).tolist()


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, segment_tokens: int = 1 << 18) -> None:
    """Encode every text, append end_id, and write the store. segment_tokens: a segment ends with the document that reaches it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = rows.repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches):
        from pyspark import TaskContext

        enc = library_encoder(tokenizer)
        width = int(enc.dtype[-1])
        end = np.asarray([end_id], enc.dtype).tobytes()
        shard, segment, base, size, keys, pieces = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def row():
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "base": [base], "n_docs": [len(keys)], "n_tokens": [size], "blob": pa.array([pack_segment(keys, pieces, width)], pa.binary())})

        for batch in in_slices(batches):
            for key, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1).to_pylist(), end).to_pylist()):
                keys.append(key)
                pieces.append(ids)
                size += len(ids) // width
                if size >= segment_tokens:
                    yield row()
                    segment, base, size, keys, pieces = segment + 1, base + size, 0, [], []
        if keys:
            yield row()

    parts.mapInArrow(tidied(encode), SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32 bits)."""
    store = spark.read.schema(SCHEMA).parquet(path)
    # one row for each shard: as many as the writer had partitions
    totals = sorted(store.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases, at = {}, 0
    for r in totals:
        bases[r.shard], at = at, at + r.n

    def decode(batches):
        for batch in batches:
            for shard, base, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = Segment(blob)
                ends = s.ends.values()
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(s.body, f"<u{s.width}").astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids(), pa.int64()), pa.array(starts + base + bases[shard], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return store.select("shard", "base", "blob").mapInArrow(decode, READ)


def ids_crc32(df: DataFrame) -> DataFrame:
    """ids replaced by their unsigned crc32."""
    return df.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "token-store")
    write_token_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return ids_crc32(read_token_store(spark, path))


def crc_of(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
