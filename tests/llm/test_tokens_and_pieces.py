import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumflow.llm import encode, packing, splitter

# --- encoding


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


TEXTS = ["", "人参的性状。", "it's they'll  we've\n\n x", "<|endoftext|>", "👍🏽🌿‍", " \t\n ", "12345 a1b2", "ü" * 30, "x" * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_other_library(reference, text):
    bpe = encode.bpe()
    assert bpe.encode(text).tolist() == reference(text)
    assert bpe.decode(bpe.encode(text)).decode() == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sltre 人参。1\n\t  é👍-"), max_size=60))
def test_presplitting_changes_nothing(text):
    bpe, long = encode.bpe(), encode.LONG
    whole = bpe.encode(text).tolist()
    try:
        encode.LONG = 3
        assert "".join(bpe.segments(text)) == text
        assert bpe.encode(text).tolist() == whole and bpe.count(text) == len(whole)
    finally:
        encode.LONG = long


def test_encode_corpus(spark, reference):
    texts = [*TEXTS, None, "人参 " * 30_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df).collect()}
    assert got == {i: reference(t) if t else [] for i, t in enumerate(texts)}
    sizes = {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    back = {r["doc_id"]: r["t"] for r in encode.encode_corpus(df).select("doc_id", encode.decode_ids(F.col("ids")).alias("t")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode.encode_corpus(df.filter("false")).count() == 0


# --- packing


def first_fit(sizes, capacity):
    rooms, places = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, room in enumerate(rooms):
            if room >= sizes[i]:
                break
        else:
            b = len(rooms)
            rooms.append(capacity)
        rooms[b] -= sizes[i]
        places[i] = b
    return [places[i] for i in range(len(sizes))]


def test_tournament_equals_a_scan():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.randint(0, 50) for _ in range(rng.randint(0, 70))]
        assert packing.first_fit_decreasing(np.array(sizes), 50).tolist() == first_fit(sizes, 50)


def test_pack(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 1, 30, 99, 100, 101, 250, 1000])) for i in range(900)] + [(5000, None), (5001, -3), (None, 7), (5002, 100), (5002, 100)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, n_tokens bigint, id string, size int")
    got = packing.pack(df, 100, group_rows=300).collect()
    sizes = {i: max(0, n or 0) for i, n in rows}
    held, parts = {}, {}
    for r in got:
        held[r["container_id"]] = held.get(r["container_id"], 0) + r["size"]
        parts.setdefault(r["doc_id"], []).append((r["piece_no"], r["item_start"], r["item_end"]))
    assert max(held.values()) <= 100 and set(parts) == set(sizes)
    for i, p in parts.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and p[0][1] == 0 and p[-1][2] == sizes[i]
        assert all(a[2] == b[1] for a, b in zip(p, p[1:])) and (len(p) == 1 or sizes[i] > 100)
    assert len(held) <= -(-sum(sizes.values()) // 100) * 1.1 + 4
    assert packing.pack(df.filter("false"), 100).count() == 0


# --- splitting


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("甲乙ab 。，\n.1́"), max_size=400), st.integers(8, 40), st.integers(0, 3))
def test_pieces_cover_and_fit(text, limit, overlap):
    cuts = splitter.spans(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(b - a <= limit for a, b in cuts)


def test_natural_boundaries():
    text = "甲" * 60 + "。" + "乙" * 30 + "，" + "丙" * 60
    assert splitter.spans(text, 100, 0) == [(0, 61), (61, 152)]
    assert splitter.spans("甲" * 250, 100, 10) == [(0, 100), (90, 190), (180, 250)]
    pieces = [("第一段。\n" * 30)[a:b] for a, b in splitter.spans("第一段。\n" * 30, 60, 0)]
    assert all(p.endswith("\n") for p in pieces)
    assert splitter.spans("a" * 99 + "́" + "b" * 60, 100, 0)[0] == (0, 100)
    assert splitter.spans("a" * 100 + "́" + "b" * 60, 100, 0)[0] == (0, 99)


def test_split_oversized(spark):
    rows = [(1, "甲" * 1500), (2, "甲乙。" * 501), (3, None), (4, ""), (2, "甲乙。" * 501), (5, "长" * 200_000)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "k bigint, t string, content string, id int")
    got = splitter.split_oversized(df, "k", "t").collect()
    assert max(r["char_count"] for r in got) <= 1500 and all(r["char_count"] == len(r["content"] or "") for r in got)
    assert sorted((r["k"], r["n_pieces"]) for r in got if r["k"] in (1, 3, 4)) == [(1, 1), (3, 1), (4, 1)]
    two = [r for r in got if r["k"] == 2]
    assert sorted(r["piece_no"] for r in two) == [0, 0, 1, 1]
    long = sorted((r for r in got if r["k"] == 5), key=lambda r: r["piece_no"])
    whole = long[0]["content"]
    for r in long[1:]:
        assert len(whole) - r["start"] == 100
        whole += r["content"][len(whole) - r["start"] :]
    assert whole == "长" * 200_000
