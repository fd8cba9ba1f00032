"""Whole-text tokenization through a table of the chunks seen so far.

A chunk starts at a space or line feed that follows a non-space character. None of the
supported pre-tokenizers joins characters across that point, so the ids of a text are the
ids of its chunks in a row. Texts are cut into chunks by Arrow, each distinct chunk of a
stretch of texts is looked up once, and the ids are gathered by Arrow. A chunk that the table
lacks goes to the tokenizer itself. Texts with other white space or with runs of spaces go to
it whole.

Strings of special tokens are ordinary text: a document cannot forge an end of document.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .held import held

ODD = re.compile("[\x09\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ODD_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
RUNS = ("  ", "\n\n", " \n", "\n ")
#: A line feed, Latin letters that stay as they are up to the model but for their case, and marks (an apostrophe can begin a piece of its own).
PARTS = re.compile("(\n?)([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
PROBES = ("êeux***", "\nThe", "\nÉtre", "\nEnd.###", "a%", "b_", "c]", "d/e", "The", "of", "Straße", "été", "aninth", "X", "ÀÉ", "tion,", "end.", "a", "Mañana", "sdfkjhweriu")


def plain(text: str) -> bool:
    """Whether single spaces and line feeds between other characters are all the white space."""
    if any(r in text for r in RUNS) or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(c in text for c in ODD_ASCII) if text.isascii() else not ODD.search(text)


class _Table(dict):
    """Ids by chunk. Once there are `most` they become the older half, from which those in use come back.

    A chunk of Latin letters, with a line feed before and marks behind it at most, is the ids of
    its three parts; only those of the letters are kept.
    """

    def __init__(self, encode, letters, lead, dtype, most):
        super().__init__()
        self.encode, self.letters, self.lead, self.dtype, self.most, self.old, self.bare = encode, letters, lead, dtype, most, {}, {}
        self.code = "H" if dtype == "<u2" else "I"

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            if type(word) is tuple:
                out = array(self.code, self.letters("", word[1])).tobytes()
            elif self.letters and (parts := PARTS(word)):
                if word.isalpha():
                    out = array(self.code, self.letters(self.lead, word)).tobytes()
                else:
                    feed, core, marks = parts.groups()
                    return (self.part(feed) + self["\n", core] if feed else self[core]) + (self.part(marks) if marks else b"")
            else:
                out = np.asarray(self.encode(word if word[:1] == "\n" else self.lead + word), self.dtype).tobytes()
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def part(self, marks):
        out = self.bare.get(marks)
        if out is None:
            if len(self.bare) >= 10_000:
                self.bare.clear()
            out = self.bare[marks] = np.asarray(self.encode(marks), self.dtype).tobytes()
        return out


class ChunkEncoder:
    """ids of whole texts as bytes of `dtype` (little-endian).

    letters(lead, word): the ids of a word of Latin letters by a shorter way; it is only used
    if it gives the tokenizer's own ids for the probes. most: chunks in each half of the table.
    """

    def __init__(self, encode, dtype="<u2", most=300_000, lead=" ", letters=None):
        self.whole, self.dtype, self.firsts = encode, dtype, {}
        self.table = _Table(encode, letters, lead, dtype, most)
        if letters and any(self.table[w] != self.as_bytes(w if w[0] == "\n" else lead + w) for w in PROBES):
            self.table = _Table(encode, None, lead, dtype, most)

    def as_bytes(self, text: str) -> bytes:
        return np.asarray(self.whole(text), self.dtype).tobytes()

    def first(self, word: str) -> bytes:
        """ids of the chunk that begins a text, which no space precedes."""
        out = self.firsts.get(word)
        if out is None:
            if len(self.firsts) >= 50_000:
                self.firsts.clear()
            out = self.firsts[word] = self.as_bytes(word)
        return out

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0].as_py()

    def batch(self, texts: list[str], end: bytes = b"", stretch: int = 1 << 22) -> pa.Array:
        """The ids of each text and end, as a binary array. stretch: characters that are cut at a time."""
        out, lo, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= stretch:
                out.append(self.stretch(texts[lo : i + 1], end))
                lo, size = i + 1, 0
        if lo < len(texts) or not out:
            out.append(self.stretch(texts[lo:], end))
        return pa.concat_arrays(out)

    def stretch(self, texts: list[str], end: bytes) -> pa.Array:
        n = len(texts)
        if not n:
            return pa.array([], pa.binary())
        simple = [not t or plain(t) for t in texts]
        cut = pc.split_pattern(pc.replace_substring(pa.array([t if s else "" for t, s in zip(texts, simple)], pa.string()), "\n", " \n"), " ")
        starts = cut.offsets.to_numpy().astype(np.int64)
        chunks = cut.flatten().dictionary_encode()
        words = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.table.__getitem__, words))
        for t, s in zip(texts, simple):
            ids.append(b"" if not t else self.first(t.split(" ", 1)[0].split("\n", 1)[0]) if s else self.as_bytes(t))
        ids.append(end)
        at = chunks.indices.to_numpy().astype(np.int32)
        at[starts[:-1]] = np.arange(len(words), len(words) + n)
        at = np.insert(at, starts[1:], len(ids) - 1)
        got = pa.array(ids, pa.binary()).take(pa.array(at))
        offsets = np.frombuffer(got.buffers()[1], np.int32)[: len(at) + 1][starts + np.arange(n + 1)]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets)), got.buffers()[2]])


def letters_of(t, lower: bool):
    """The model's ids for a word of Latin letters, without the steps before the model, which only lower-case it or show its bytes as characters."""
    from tokenizers import pre_tokenizers

    shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenize, names = t.model.tokenize, {c: shown.pre_tokenize_str(c)[0][0] for c in map(chr, (*range(32, 127), *range(160, 256)))}

    def ids(lead, word):
        text = word.lower() if lower else word
        if not text.isascii():
            text = "".join(map(names.__getitem__, text))
        return [x.id for x in tokenize(text if lower or not lead else names[lead] + text)]

    return ids


def library_tokenizer(path: str):
    """A tokenizer of the tokenizers library; strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def library_encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and file, kept from task to task."""

    def make():
        t = library_tokenizer(path)
        dtype = "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"
        lower = t.normalizer is not None and t.normalizer.normalize_str(" A") in (" a", "a")
        return ChunkEncoder(lambda s: t.encode(s, add_special_tokens=False).ids, dtype, letters=letters_of(t, lower))

    return held(("tokenizer", path), make)


def in_slices(batches, rows: int = 1000):
    """The batches in pieces of so many rows, so that a worker holds few texts as strings at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
