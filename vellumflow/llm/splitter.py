"""Cutting of oversized texts into overlapping pieces at natural boundaries.

A text is tokenised into sentences and clauses whose end offsets (prefix sums of the token
lengths) are the sorted boundary arrays: paragraph ends, sentence ends, clause ends, blanks.
A piece that begins at ``start`` ends at the last boundary of the strongest kind in the
second half of its room, found by binary search; failing all kinds, at a hard cut that keeps
combining marks with their base. The next piece begins ``overlap`` before that end, moved
forward to the first boundary in the overlap if there is one.

Only texts over the limit reach Python; the others are measured and passed on in the JVM.

Results for odd input: NULL text gives one piece with NULL content and ``char_count`` 0, an
empty text one empty piece; a text of exactly ``limit`` code points stays whole; repeated
rows are cut alike, each on its own; other columns of the table are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1_500
OVERLAP = 100

#: A token is text up to and with the mark that ends it. The kinds, strongest first.
_KINDS = (
    re.compile(r"[^\n]*\n+|[^\n]+"),
    re.compile(r"[^。！？!?.…\n]*(?:[。！？!?…]+[”’」』）)\"']*|\.(?=\s|$)[”’\"')]*\s*|\.|\n+)|[^。！？!?.…\n]+"),
    re.compile(r"[^；;，,、：:]*[；;，,、：:]+\s*|[^；;，,、：:]+"),
    re.compile(r"\S*\s+|\S+"),
)
_SENTENCE = 1


def boundaries(text: str) -> list[list[int]]:
    """Sorted end offsets of the tokens of each kind."""
    found = []
    for k, kind in enumerate(_KINDS):
        ends = list(accumulate(len(m.group()) for m in kind.finditer(text)))
        if k == _SENTENCE:  # a dot inside a number or name ends nothing
            ends = [e for e in ends if not (text[e - 1] == "." and e < len(text) and not text[e].isspace())]
        found.append(ends)
    return found


def _joined(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would part a character from its marks."""
    mark = text[at]
    return bool(unicodedata.combining(mark)) or mark in "‍️︎" or text[at - 1] == "‍" or 0x1F3FB <= ord(mark) <= 0x1F3FF or text[at - 1 : at + 1] == "\r\n"


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece; together they cover ``text`` without a gap."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    kinds, out, start = boundaries(text), [], 0
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        most, least = start + limit, start + limit // 2
        end = 0
        for ends in kinds:
            k = bisect_right(ends, most)
            if k and ends[k - 1] > least:
                end = ends[k - 1]
                break
        if not end:
            end = most
            while end > least and _joined(text, end):
                end -= 1
            end = end if end > least else most
        out.append((start, end))
        back = max(start + 1, end - overlap)
        start = back
        for ends in kinds[1:]:
            k = bisect_left(ends, back)
            if k < len(ends) and ends[k] < end:
                start = ends[k]
                break
        else:
            while start < end and _joined(text, start):
                start += 1


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``id_col, piece_no, n_pieces, start, content, char_count``, one row per piece."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
    kind = source.schema["id"].dataType.simpleString()
    long = F.length("content") > limit
    whole = source.filter(~long | F.col("content").isNull()).select("id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, nos, of, starts, texts = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                cuts = spans(text, limit, overlap)
                for no, (a, b) in enumerate(cuts):
                    take.append(row)
                    nos.append(no)
                    of.append(len(cuts))
                    starts.append(a)
                    texts.append(text[a:b])
            ids = batch.column(0).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(nos, pa.int32()), pa.array(of, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], ["id", "piece_no", "n_pieces", "start", "content"])

    cut = source.filter(long).mapInArrow(run, f"id {kind}, piece_no int, n_pieces int, start int, content string")
    return whole.unionByName(cut).withColumn("char_count", F.coalesce(F.length("content"), F.lit(0))).withColumnRenamed("id", id_col)
