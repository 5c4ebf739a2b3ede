"""Tokens: Latin words and numbers in the JVM, ideographs by bigrams or a lexicon."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import contained_names


def latin_tokens(text: Column, lower: bool = False) -> Column:
    """Runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit("[A-Za-z0-9]+"), F.lit(0))


#: At every ideograph: it and the next one, or it alone if it stands alone.
_GRAM = "(?=([一-鿿]{2}|(?<![一-鿿])[一-鿿](?![一-鿿])))"


def mixed_tokens(text: Column) -> Column:
    """Latin tokens, then ideograph bigrams in order; a lone ideograph counts. Two passes of
    a pattern, without a fold over characters."""
    return F.concat(latin_tokens(text), F.regexp_extract_all(text, F.lit(_GRAM), F.lit(1)))


def mixed_counts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """``row, term, count`` of the distinct ``mixed_tokens`` of every text, term by term, and the
    number of tokens of every text, over all characters of a batch at once."""
    rows = [t or "" for t in texts.to_pylist()]
    whole = "\n".join(rows) + "\n"
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(t) + 1 for t in rows])
    ideograph = (code >= 0x4E00) & (code <= 0x9FFF)
    two = np.flatnonzero(ideograph[:-1] & ideograph[1:])
    beside = np.append(False, ideograph[:-1]) | np.append(ideograph[1:], False)
    lone = np.flatnonzero(ideograph & ~beside)
    latin = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    edge = np.flatnonzero(np.diff(latin.astype(np.int8), prepend=0))
    first, end = edge[::2], edge[1::2]
    words = pa.array([whole[a:b] for a, b in zip(first.tolist(), end.tolist())], pa.string()).dictionary_encode()
    # a pair is below 2^32, a lone ideograph below 2^16, words are numbered from 2^32
    keys = np.concatenate([code[two] << 16 | code[two + 1], code[lone], words.indices.to_numpy().astype(np.int64) + (1 << 32)])
    at = np.concatenate([row[two], row[lone], row[first]])
    found, times = np.unique(keys << 29 | at, return_counts=True)
    key = found >> 29
    new = np.diff(key, prepend=-1) != 0
    kinds, kind = key[new], np.cumsum(new) - 1
    listed = words.dictionary.to_pylist()
    names = pa.array([listed[k - (1 << 32)] if k >> 32 else (chr(k >> 16) if k >> 16 else "") + chr(k & 0xFFFF) for k in kinds.tolist()], pa.string())
    return found & ((1 << 29) - 1), names.take(pa.array(kind)), times, np.bincount(at, minlength=len(rows))


class LongestMatch:
    """Segmentation by the longest entry of a lexicon; an ideograph outside is a token."""

    def __init__(self, lexicon: Iterable[str]):
        self.words = {w for w in lexicon if len(w) >= 2}
        self.longest = max(map(len, self.words), default=1)

    def cut(self, text: str | None) -> list[str]:
        out, i, text = [], 0, text or ""
        while i < len(text):
            ch = text[i]
            if ch.isascii() and ch.isalnum():
                j = i
                while j < len(text) and text[j].isascii() and text[j].isalnum():
                    j += 1
                out.append(text[i:j])
                i = j
                continue
            for n in range(min(self.longest, len(text) - i), 1, -1):
                if text[i : i + n] in self.words:
                    break
            else:
                n = 1
            if n > 1 or "一" <= ch <= "鿿":
                out.append(text[i : i + n])
            i += n
        return out


def lexicon_tokens(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, word_col: str) -> DataFrame:
    """``id_col, tokens`` by longest match.

    Which words stand in a text comes from an equi-join on n-grams, so that each text carries
    its own few words to the matcher and no lexicon is sent as a whole, however long it is.
    """
    rows = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).distinct()
    found = contained_names(rows, lexicon, "_id", "_text", word_col).groupBy("_id").agg(F.collect_set("name").alias("_words"))

    @F.pandas_udf("array<string>")
    def run(text: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([LongestMatch(w if w is not None else ()).cut(t) for t, w in zip(text, words)], index=text.index)

    joined = rows.join(found, "_id", "left")
    return joined.select(F.col("_id").alias(id_col), run("_text", F.coalesce("_words", F.array().cast("array<string>"))).alias("tokens"))
