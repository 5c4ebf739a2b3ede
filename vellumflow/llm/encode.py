"""Encoding of a corpus with a byte-level BPE read from a local rank file.

The rank file is a parameter (``Bpe(path)``); it is loaded once per Python worker. Texts
longer than ``LONG`` code points are cut before they reach the encoder, at places where the
pre-tokenizer pattern ends a match whatever surrounds it, so that the ids are those of the
whole text:

* after a letter and before a character that is no letter - a run of letters is consumed
  greedily and nothing that starts before its end reaches beyond it;
* after a character that is no white space and before white space - no alternative of the
  pattern runs from other characters into white space.

A text without such a place stays whole.

Results for odd input: NULL and empty text give an empty list of ids (size 0).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies and the file used when none is named.
TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"

#: Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points from which a text is pre-split, and the size aimed at.
LONG = 16_384
#: Ids per Arrow batch handed back to the JVM.
IDS_PER_BATCH = 2_000_000

_SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\S)(?=\s)")


class Bpe:
    """Encoder and raw-byte decoder over a rank file."""

    def __init__(self, path: str = BYTE_BPE_50K, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def segments(self, text: str) -> Iterator[str]:
        """``text`` in pieces whose ids can be joined."""
        if len(text) <= LONG:
            yield text
            return
        start = 0
        while len(text) - start > LONG:
            found = _SAFE.search(text, start + LONG)
            if found is None or found.start() >= len(text):
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        if len(text) <= LONG:
            return np.asarray(self._encoding.encode_ordinary(text), dtype=np.int32)
        return np.concatenate([np.asarray(self._encoding.encode_ordinary(s), dtype=np.int32) for s in self.segments(text)])

    def count(self, text: str | None) -> int:
        return sum(len(self._encoding.encode_ordinary(s)) for s in self.segments(text)) if text else 0

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``; a list cut inside a character still decodes."""
        return b"".join(self._encoding.decode_single_token_bytes(int(i)) for i in ids)


@lru_cache(maxsize=4)
def bpe(path: str = BYTE_BPE_50K) -> Bpe:
    """The encoder of this Python worker."""
    return Bpe(path)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row, in one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            first, held, parts = 0, 0, []
            for row, text in enumerate(texts):
                ids = encoder.encode(text.as_py())
                parts.append(ids)
                held += len(ids)
                if held >= IDS_PER_BATCH:
                    yield _ids_batch(keys.slice(first, len(parts)), parts)
                    first, held, parts = row + 1, 0, []
            if parts:
                yield _ids_batch(keys.slice(first, len(parts)), parts)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def _ids_batch(keys: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))], ["id", "ids"])


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``id_col`` and ``n_tokens`` of every row; only these leave the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for batch in batches:
            sizes = pa.array([encoder.count(text.as_py()) for text in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], ["id", "n_tokens"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens bigint").select(F.col("id").alias(id_col), "n_tokens")


def decode_ids(ids: Column, path: str = BYTE_BPE_50K) -> Column:
    """The text of an id list; NULL for NULL, bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def run(series):
        decoder = bpe(path)
        return series.map(lambda x: None if x is None else decoder.decode(x).decode("utf-8", "replace"))

    return run(ids)
