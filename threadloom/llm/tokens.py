"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 6).

Ids come from the tokenizers library over Arrow batches; decoding and offsets
use the byte-to-character table of byte-level BPE directly.

Defined results: a null or empty text has no ids; text that looks like a special
token is plain text; ids are never capped, however long the text; extra columns
are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts are handed to the tokenizer in groups of about so many characters.
GROUP_CHARS = 1 << 20


def load_tokenizer(path: str):
    """The tokenizer with special tokens read as plain text, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t) + 1
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def batch_ids(tokenizer, texts: list[str | None]) -> Iterator[list[int]]:
    for group in _groups([t or "" for t in texts]):
        for e in tokenizer.encode_batch_fast(group, add_special_tokens=False):
            yield e.ids


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE's table: printable bytes stand for themselves, the others
    take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own}
    for n, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(256 + n)] = b
    return table


def id_bytes(path: str) -> dict[int, bytes]:
    """Token id -> the bytes it stands for."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table = byte_of_char()
    return {i: bytes(table[c] for c in s) if all(c in table for c in s) else s.encode() for s, i in vocab.items()}


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load_tokenizer(tokenizer)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            offsets, parts, n = [0], [], 0
            for ids in batch_ids(t, texts.to_pylist()):
                parts.append(np.asarray(ids, dtype=np.int32))
                n += len(ids)
                offsets.append(n)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, ids], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load_tokenizer(tokenizer)
        for b in batches:
            n = [len(ids) for ids in batch_ids(t, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def spans(ids: list[int], table: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, first character, end character) of each token.  A token that
    holds only part of a character spans that whole character."""
    data = [table[i] for i in ids]
    ends = np.cumsum([len(d) for d in data]) if data else np.zeros(0, int)
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character each byte belongs to
    starts = ends - np.array([len(d) for d in data], dtype=int) if data else ends
    if not len(raw):
        return starts, starts, ends
    return starts, char[np.minimum(starts, len(raw) - 1)], char[np.maximum(ends - 1, 0)] + 1


def encode_with_offsets(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): id, first byte, first and end character of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, table = load_tokenizer(tokenizer), id_bytes(tokenizer)
        kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("id", "byte_start", "char_start", "char_end")]))
        for b in batches:
            rows = []
            for ids in batch_ids(t, b.column(1).to_pylist()):
                cols = spans(ids, table)
                rows.append([dict(zip(("id", "byte_start", "char_start", "char_end"), map(int, x))) for x in zip(ids, *cols)])
                if len(rows) >= 200:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(0, len(rows)), pa.array(rows, kind)], [key, "tokens"])
                    b, rows = b.slice(len(rows)), []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], [key, "tokens"])

    k = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {k}, tokens array<struct<id:int,byte_start:int,char_start:int,char_end:int>>")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id") -> DataFrame:
    """(key, ids) -> (key, text).  Bytes are joined before they are read as UTF-8,
    so characters split between tokens come out whole; a stream that ends inside
    a character ends with U+FFFD; unknown ids and null lists give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_bytes(tokenizer)
        for b in batches:
            out = []
            for ids in b.column(1).to_pylist():
                try:
                    out.append(None if ids is None else b"".join(table[i] for i in ids).decode("utf-8", "replace"))
                except KeyError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
