"""Operator 6: byte-level BPE by a file of ranks, encoding and decoding.

Bytes are written as printable characters (the usual table of byte-level BPE), the ranks
become the vocabulary and the merges of a model of the tokenizers library, and texts go
through it in Arrow batches. Decoding turns characters back into bytes; a character whose
bytes lie in several tokens is whole again once the bytes are joined.

Nulls: a null text is empty (no ids). A null doc_id stays null. Repeated rows give repeated
rows. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .held import held, tidied
from .words import ChunkEncoder, in_slices, letters_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def model_of(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the library with the same ids: each pair whose union has a rank is a merge, in order of that rank."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    names = byte_characters()
    show = lambda b: "".join(map(names.__getitem__, b))
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pairs = [(token[:i], token[i:]) for i in range(1, len(token))]
        pairs = [p for p in pairs if p[0] in ranks and p[1] in ranks]
        merges += [(show(a), show(b)) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    t = Tokenizer(models.BPE(vocab={show(k): v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


class ByteBPE:
    """encode(text) -> ids, offsets(text) -> ids and spans, decode(ids) -> bytes."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.library = model_of(ranks, pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        back = {c: i for i, c in enumerate(byte_characters())}
        for shown, rank in self.library.get_vocab().items():
            self.bytes_of[rank] = bytes(map(back.__getitem__, shown))
        self.name_of = list(map(str, range(len(self.bytes_of))))
        dtype = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"
        self.chunks = ChunkEncoder(lambda s: self.library.encode(s, add_special_tokens=False).ids, dtype, letters=letters_of(self.library, False))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.chunks(text), self.chunks.dtype).tolist()

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first character, end character); the tokens of a split character all cover it."""
        lead = np.array([(b & 0xC0) != 0x80 for b in text.encode()], bool)
        before = np.concatenate([[0], np.cumsum(lead)])
        out, at = [], 0
        for i in self.encode(text):
            end = at + len(self.bytes_of[i])
            out.append((i, int(before[at + 1]) - 1, int(before[end])))
            at = end
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_text(self, ids) -> str:
        return self.decode(ids).decode("utf-8", "replace")

    def decode_stream(self, ids):
        """Text as ids arrive; a character appears once its last byte is there."""
        part = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := part.decode(self.bytes_of[i]):
                yield text
        if text := part.decode(b"", True):
            yield text


def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return held(("ranks", path, pattern), lambda: ByteBPE(path, pattern))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array), starts and ends (array: the characters that each id covers)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for b in batches:
            got = [bpe.offsets(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([[x[k] for x in g] for g in got], pa.list_(pa.int32())) for k in range(3)], ["doc_id", "ids", "starts", "ends"])

    return rows.mapInArrow(tidied(run), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes, text, from doc_id and ids; null ids are none."""

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for b in batches:
            got = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in got], pa.string())], ["doc_id", "bytes", "text"])

    return ids.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text: n_tokens and digests of the ids and of the decoded bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for b in in_slices(batches):
            n, names, back = [], [], []
            for raw in bpe.chunks.batch(b.column(1).to_pylist()).to_pylist():
                ids = np.frombuffer(raw, bpe.chunks.dtype).tolist()
                n.append(len(ids))
                names.append(hashlib.sha256(",".join(map(bpe.name_of.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(tidied(run), SCHEMA)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
