import random

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import tables, text
from vellumflow.operators import answer, bm25, catalog, chunk, dialogue, diagnose, evaluate, fusion, matching, models, queryparse, retrieve, segment, sessions, tokens, vector


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'int'}" for k, v in row.items()))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("黄芩皂昔 ", "黄芩皂苷"), ("人参皂苷昔", "人参皂苷"), ("照髙效液相色谱法（通则。512）", "照高效液相色谱法（通则0512）"), ("通则05120", "通则5120"), ("１２Ａｂ", "12Ab"),
        ("　　甲\t\t乙　\n\n\n\n丙", "甲 乙\n\n丙"), ("完■", "完。"), ("", ""), ("　 \n", ""), (None, None), ("【検查】水", "【检查】水"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert value(spark, text.clean_text(F.col("x")), x=raw) == clean


def test_clean_name_and_lookup(spark):
    assert value(spark, text.clean_name(F.col("x")), x="黄 茂") == "黄芪"
    assert value(spark, text.lookup(F.col("x")), x="用法") == "用法与用量"
    assert value(spark, text.lookup(F.col("x")), x="性状") == "性状"
    assert value(spark, text.count_of(F.col("x"), "ab"), x="ababa") == 2


def test_markdown(spark):
    rows = spark.createDataFrame([([["a", "b"], ["1"], ["x\ny", "2", "3"]],), ([],)], "rows array<array<string>>")
    got = [r[0] for r in rows.select(tables.to_markdown(F.col("rows"))).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 1 |  |\n| x y | 2 |", ""]


BLOCKS = [
    ("para", "Normal", "前言"), ("para", "Heading #3", "人参"), ("para", "Body text|3", "Renshen"), ("para", "Body text|3", "GINSENG RADIX"), ("para", "Normal", "本品为人参的根。"),
    ("para", "Normal", "【性状】主根呈纺锤形。"), ("para", "Normal", "表面灰黄色。"), ("table", None, "| a |"), ("table", None, "| b |"), ("para", "Normal", "〔来源〕"), ("para", "Normal", "栽培。"),
    ("para", "Heading #4", "饮片"), ("para", "Normal", "【炮制】洗净。"), ("para", "Heading #4", "人参茎叶"), ("para", "Normal", "【性状】叶"), ("para", "Body text|4", "黄芪片"), ("para", "Normal", ""), ("para", "Normal", "Huangqi"), ("para", "Normal", "【处方】黄芪"),
]


def test_parse_entries(spark):
    rows = [("d", i, k, s, t) for i, (k, s, t) in enumerate(BLOCKS)]
    blocks = spark.createDataFrame(rows, "doc_id string, block_idx bigint, kind string, style string, text string")
    got = {r["entry_no"]: r for r in segment.parse_entries(blocks).collect()}
    assert [got[n]["drug_name"] for n in (1, 2, 3, 4)] == ["人参", "人参-饮片", "人参茎叶", "黄芪片"]
    assert [got[n]["parent_drug"] for n in (1, 2, 3, 4)] == ["", "人参", "人参", ""]
    first = got[1]
    assert (first["pinyin_name"], first["latin_name"], first["intro_text"]) == ("Renshen", "GINSENG RADIX", "本品为人参的根。")
    assert [(s["section_name"], s["content"], s["table_markdown"]) for s in first["sections"]] == [("性状", "主根呈纺锤形。\n表面灰黄色。", "| a |\n\n| b |"), ("来源", "栽培。", None)]
    assert [got[n]["category_hint"] for n in (1, 2, 3, 4)] == ["药材和饮片", "药材和饮片", "成方制剂和单味制剂", "成方制剂和单味制剂"]
    assert (first["para_start"], first["para_end"]) == (1, 10)
    assert segment.parse_entries(blocks.filter("false")).count() == 0


def fold(parts, limit, overlap):
    out, cur = [], ""
    for p in parts:
        if len(cur) + len(p) > limit and cur:
            out.append(cur)
            cur = cur[-overlap:] + p
        else:
            cur += p
    return out + [cur] if cur else out


def test_sliding_windows_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(["".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 12))],) for _ in range(80)]
    got = spark.createDataFrame(rows, "p array<string>").select("p", chunk.sliding_windows(F.col("p"), 50, 7).alias("w")).collect()
    assert all(r["w"] == fold(r["p"], 50, 7) for r in got)


def pack(parts, limit):
    out, cur, n = [], [], 0
    for p in parts:
        if n + len(p) > limit and cur:
            out.append("\n".join(cur))
            cur, n = [], 0
        cur.append(p)
        n += len(p)
    return out + ["\n".join(cur)] if cur else out


def test_greedy_pack_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(["x" * rng.randint(1, 40) for _ in range(rng.randint(0, 9))],) for _ in range(60)]
    got = spark.createDataFrame(rows, "p array<string>").select("p", chunk.greedy_pack(F.col("p"), 60).alias("w")).collect()
    assert all(r["w"] == pack(r["p"], 60) for r in got)


def test_splits(spark):
    assay = "照高效液相色谱法测定。\n黄芩照高效液相色谱法（通则0512）测定。\n取。\n连翘照薄层色谱法测定。"
    assert value(spark, chunk.split_components(F.col("x")), x=assay) == ["照高效液相色谱法测定。\n黄芩照高效液相色谱法（通则0512）测定。\n取。", "连翘照薄层色谱法测定。"]
    assert value(spark, chunk.split_components(F.col("x")), x="无") == ["无"]
    items = "水分 不得过12.0%（通则0832第二法烘干法）。\n总灰分 不得过10.0%（通则2302），另取一份复核。\n其他"
    assert value(spark, chunk.split_items(F.col("x")), x=items) == items.split("\n")[:2]
    assert value(spark, chunk.fixed_slices(F.col("x"), 2), x="abcde") == ["ab", "cd", "e"]
    assert value(spark, chunk.fixed_slices(F.col("x"), 2), x="") == []


def test_chunk_entries(spark):
    schema = "entry_id bigint, drug_name string, pinyin_name string, latin_name string, category_hint string, intro_text string, parent_drug string, sections array<struct<section_name:string,content:string,table_markdown:string>>"
    long = "取本品粉末，加水煎煮。" * 160
    rows = [
        (1, "短", None, None, None, "概述", "", [("性状", "白色", None), ("检查", "", "| t |")]),
        (2, "长药名", "Chang", "", "药材", "概述文字", "母", [("性状", long, None), ("贮藏", "密闭", None), ("注意", "孕妇慎用", None), ("来源", "短", None), ("鉴别", "一", "| t |"), ("空", "", None)]),
        (3, "空", None, None, None, None, None, None),
    ]
    got = chunk.sequential_ids(chunk.chunk_entries(spark.createDataFrame(rows, schema))).orderBy("chunk_seq").collect()
    first = [r for r in got if r["entry_id"] == 1]
    assert [r["content"] for r in first] == ["概述\n【性状】白色\n【检查-表格】\n| t |"]
    second = [r for r in got if r["entry_id"] == 2]
    assert [r["chunk_type"] for r in second] == ["summary", "window", "window", "detailed", "clinical"]
    assert second[0]["content"] == "药品名称：长药名（母的子剂型）\n拼音：Chang\n分类：药材\n概述：概述文字"
    assert second[-1]["content"] == "【贮藏】密闭\n【注意】孕妇慎用\n【来源】短"
    assert second[3]["content"] == "一\n\n| t |" and second[3]["table_markdown"] == "| t |"
    assert [r["chunk_id"] for r in got] == [f"chunk_{i:06d}" for i in range(len(got))]
    assert not [r for r in got if r["entry_id"] == 3]


def test_tokens(spark):
    assert value(spark, tokens.mixed_tokens(F.col("x")), x="人参皂苷Rg1，甲 2020") == ["Rg1", "2020", "人参", "参皂", "皂苷", "甲"]
    df = spark.createDataFrame([(1, "人参叶和人参 Rg1"), (2, None), (3, "")], "k int, x string")
    words = spark.createDataFrame([("人参",), ("人参叶",), (None,), ("参",)], "w string")
    got = {r["k"]: r["tokens"] for r in tokens.lexicon_tokens(df, "k", "x", words, "w").collect()}
    assert got == {1: ["人参叶", "和", "人参", "Rg1"], 2: [], 3: []}


def test_bm25_against_a_loop(spark, tmp_path):
    import math
    from collections import Counter

    docs = {1: "人参 补气 补气", 2: "黄芪 补气", 3: "", 4: "人参 叶"}
    df = spark.createDataFrame(list(docs.items()), "id bigint, text string")
    index = bm25.build(df, F.filter(F.split("text", " "), lambda x: x != ""))
    index.save(str(tmp_path / "index"))
    index = bm25.Bm25Index.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([("a", "人参"), ("a", "补气"), ("a", "补气"), ("b", "无")], "qid string, term string")
    toks = {i: t.split() for i, t in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df_ = Counter(t for ts in toks.values() for t in set(ts))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df_.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    want = {}
    for i, ts in toks.items():
        s = sum(idf[t] * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in ("人参", "补气", "补气") if t in ts)
        if s > 0:
            want[i] = round(s, 9)
    got = {r["id"]: round(r["score"], 9) for r in bm25.search(index, asked, 10).collect()}
    assert got == want


def test_vector_top_k_ties_and_filters(spark):
    rows = [(i, [1.0, 0.0] if i < 5 else [0.0, 1.0], i % 2) for i in range(8)]
    v = spark.createDataFrame(rows, "id bigint, embedding array<float>, label int").repartition(3)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<float>")
    assert [r["id"] for r in vector.top_k(v, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r["id"] for r in vector.top_k(v, q, 3, where=F.col("label") == 1).orderBy("rank").collect()] == [1, 3, 5]
    assert vector.top_k(v, q.filter("false"), 3).count() == 0
    assert value(spark, vector.normalise(F.array(F.lit(0.0), F.lit(0.0))), x="a") == [0.0, 0.0]


def test_fusion(spark):
    a = spark.createDataFrame([("q", i, r + 1) for r, i in enumerate([10, 11, 12, 13, 14])], "qid string, id bigint, rank int")
    b = spark.createDataFrame([("q", i, r + 1) for r, i in enumerate([12, 10, 20, 11, 21])], "qid string, id bigint, rank int")
    got = fusion.fuse({"vector": a, "bm25": b}, k=0).orderBy("rank").collect()
    assert [r["id"] for r in got] == [10, 12, 11, 20, 13, 14, 21]
    assert got[0]["sources"] == ["vector", "bm25"] and got[3]["sources"] == ["bm25"]
    assert abs(got[0]["rrf_score"] - (1 / 61 + 1 / 62)) < 1e-12


NAMES = ["人参", "人参叶", "黄连", "双黄连口服液", "甘草"]


def test_query_parse(spark):
    names = spark.createDataFrame([(n,) for n in [*NAMES, "", "参"]], "drug_name string")
    asked = [("1", "双黄连口服液的功能主治是什么？"), ("2", "哪些药材有补气作用"), ("3", "人参叶和人参怎么鉴别"), ("4", "列出治疗感冒的方剂"), ("5", None)]
    got = {r["qid"]: r for r in queryparse.parse(spark.createDataFrame(asked, "qid string, query string"), names, "drug_name").collect()}
    assert got["1"]["names"] == ["双黄连口服液"] and got["1"]["intent"] == "功效查询" and "功能与主治" in got["1"]["sections"]
    assert got["2"]["is_listing"] and got["2"]["category"] == "药材" and got["2"]["name_filter"] is None
    assert got["3"]["names"] == ["人参叶"] and not got["3"]["is_listing"]
    assert got["4"]["category"] == "成方制剂"
    assert got["5"]["names"] == []


def test_related_names(spark):
    pool = spark.createDataFrame([(n,) for n in [*NAMES, ""]], "name string")
    asked = spark.createDataFrame([("x", "人参"), ("y", "双黄连口服液"), ("z", "")], "k string, a string")
    got = {(r["k"], r["name"]) for r in matching.related_names(asked, pool, "k", "a", "name").collect()}
    assert got == {("x", "人参"), ("x", "人参叶"), ("y", "双黄连口服液"), ("y", "黄连")}


def assemble(items, cap, total_cap, least):
    out, total = [], 0
    for it in items:
        it = it[:cap]
        if total + len(it) > total_cap:
            rest = total_cap - total
            if rest > least:
                out.append(it[:rest])
            break
        out.append(it)
        total += len(it)
    return "\n---\n".join(out)


def test_context_equals_a_loop(spark):
    rng = random.Random(5)
    lists = {q: ["x" * rng.randint(1, 90) for _ in range(rng.randint(1, 12))] for q in range(60)}
    df = spark.createDataFrame([(q, r + 1, t) for q, l in lists.items() for r, t in enumerate(l)], "qid bigint, rank int, item string")
    got = {r["qid"]: r["context"] for r in retrieve.assemble_context(df, 60, 200, 10).collect()}
    assert all(got[q] == assemble(l, 60, 200, 10) for q, l in lists.items())


def test_hybrid_search_finds_named_documents(spark):
    docs = [(i, n, s, c, f"【{s}】{n}的内容{t}") for i, (n, s, c, t) in enumerate([("人参", "性状", "药材和饮片", "纺锤形"), ("黄连", "鉴别", "药材和饮片", "薄层"), ("甘草片", "规格", "成方制剂和单味制剂", "每片"), ("人参", "鉴别", "药材和饮片", "显微")])]
    df = spark.createDataFrame(docs, "chunk_seq bigint, drug_name string, section string, category string, content string")
    asked = spark.createDataFrame([("a", "人参的鉴别"), ("b", "哪些药材可以鉴别"), ("c", "规格")], "qid string, query string")
    got = retrieve.hybrid_search(asked, df).collect()
    assert {r["name"] for r in got if r["qid"] == "a"} == {"人参"}
    assert {r["category"] for r in got if r["qid"] == "b"} == {"药材和饮片"}
    plain = retrieve.hybrid_search(asked, df, enable_reranker=False, enable_filter=False).collect()
    assert {r["id"] for r in plain if r["qid"] == "a"} > {0, 3}


def test_dialogue(spark):
    rows = [("s", 1, "user", "人参的性状"), ("s", 2, "assistant", "纺锤形"), ("s", 3, "user", "它怎么样"), ("t", 1, "user", "今天股票"), ("t", 2, "user", ""), ("t", 3, "user", "嗯")]
    turns = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["verdict"], r["reason"]) for r in dialogue.guard(turns.filter("role = 'user'")).collect()}
    assert got == {("s", 1): ("pass", "on_topic"), ("s", 3): ("pass", "trusted"), ("t", 1): ("reject", "off_topic"), ("t", 2): ("reject", "empty"), ("t", 3): ("pass", "default")}
    entity = F.nullif(F.regexp_extract("text", "^([一-鿿]{2})的", 1), F.lit(""))
    resolved = {r["turn"]: r["resolved"] for r in dialogue.resolve_pointers(turns.filter("conv_id = 's'"), entity).collect()}
    assert resolved[3] == "人参怎么样"


def test_answer(spark):
    df = spark.createDataFrame([("口服，一次5 g，100%，6片。\n\n\n\n完 ", ["人参", "人参", ""], ["性状", "性状", "x"], ["6片", "5g", ""])], "a string, n array<string>, s array<string>, c array<string>")
    got = df.select(answer.post_process(F.col("a"), F.col("n"), F.col("s"), F.col("c")).alias("p")).first()["p"]
    assert got["citations"] == ["药典-人参-性状"] and got["issues"] == ["5 g"] and got["has_disclaimer"]
    assert got["answer"] == "口服，一次5 g，100%，6片。\n\n完\n\n**参考来源：**\n- [1] 药典-人参-性状\n\n具体用药请遵医嘱。"


def test_evaluate(spark):
    rng = random.Random(8)
    groups = {"a": [float(i) for i in range(37)], "b": [float(rng.randint(0, 5)) for _ in range(1000)], "c": [1.5], "d": [rng.random() for _ in range(3000)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)], "g string, v double")
    for accuracy in (10_000, 50):
        got = {r["g"]: r for r in evaluate.nearest_percentiles(df, "v", ["g"], [0, 50, 95, 99], accuracy).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert [got[g][f"p{p}"] for p in (0, 50, 95, 99)] == [sorted(vs)[min(int(len(vs) * p / 100), len(vs) - 1)] for p in (0, 50, 95, 99)]
    hits = spark.createDataFrame([("a", "人参叶", ["人参"]), ("b", "", ["人参"]), ("c", "x", []), ("d", "x", None)], "k string, n string, e array<string>")
    got = {r["k"]: r["h"] for r in hits.select("k", evaluate.is_hit(F.col("n"), F.col("e")).alias("h")).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True}


def test_models(spark):
    df = spark.createDataFrame([(1, "人参"), (2, ""), (3, None)], "id int, t string")
    norms = [round(sum(x * x for x in r["v"]), 3) for r in df.select(models.embed(F.col("t")).alias("v")).collect()]
    assert norms[0] == 1.0

    def failing():
        def chat(prompt):
            raise RuntimeError("no model")

        return chat

    got = models.generate(df, "id", "t", failing, attempts=2, wait=0.0).collect()
    assert {r["answer"] for r in got} == {"[ERROR]"} and {r["error"] for r in got} == {"no model"}


def test_catalog_and_sessions(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", None)], "k int, n string, c string")
    assert [r["k"] for r in catalog.select_rows(t, {"c": "x", "n": None}, "k", 0).collect()] == [1, 2]
    assert [r["k"] for r in catalog.select_rows(t, {}, "k", 1).collect()] == [1]
    new = spark.createDataFrame([(2, "z", "1"), (2, "y", "2"), (9, "n", "1")], "k int, n string, c string")
    assert sorted(tuple(r) for r in catalog.upsert(t.filter("c = 'x'"), new, "k", "c").collect()) == [(1, "a", "x"), (2, "y", "2"), (9, "n", "1")]
    assert catalog.list_names(t, "n", limit=1).first()["total"] == 2
    ok = sessions.valid_request(F.col("q"), F.lit(0.3), F.lit(None).cast("int"), F.lit(31))
    assert value(spark, ok, q="x") is False
    have = spark.createDataFrame([("人参",), ("黄连片",)], "n string")
    asked = spark.createDataFrame([("人参-饮片",), ("黄连",), ("无此药",)], "name string")
    assert {r["name"]: r["suggestion"] for r in diagnose.missing_names(asked, have, "n").collect()} == {"黄连": "黄连片", "无此药": None}


def test_filtered_vectors_against_brute_force(spark):
    import numpy as np

    rng = random.Random(11)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)], rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"])) for i in range(3_000)]
    asked = [(q, [rng.choice([-1.0, 1.0]) for _ in range(4)], rng.choice([None, [], ["a"], ["b", "z"]]), rng.choice([None, None, ["y"]])) for q in range(25)]
    v = spark.createDataFrame(rows, "id bigint, embedding array<float>, name string, kind string").repartition(3)
    q = spark.createDataFrame(asked, "qid bigint, embedding array<float>, names array<string>, kinds array<string>")

    def brute(qv, names, kinds):
        fits = [(round(-float(np.dot(qv, e)), 9), i) for i, e, n, k in rows if (names is None or n in names) and (kinds is None or k in kinds)]
        return [i for _, i in sorted(fits)[:7]]

    want = {(qid, i, r + 1) for qid, e, n, k in asked for r, i in enumerate(brute(e, n, k))}
    for block in (100, 4):
        got = vector.top_k(v, q, 7, within={"name": "names", "kind": "kinds"}, block=block).select("qid", "id", "rank").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_block_top_keeps_the_best_over_many_batches():
    import pyarrow as pa

    queries = pa.table({"qid": ["p", "q"], "embedding": pa.array([[1.0], [-1.0]], pa.list_(pa.float32()))})
    best = vector.BlockTop(queries, 3, 0)
    for first in range(0, 40_000, 1_000):
        ids = pa.array(range(first, first + 1_000))
        best.add(pa.RecordBatch.from_arrays([ids, pa.array([[float(i % 500)] for i in range(first, first + 1_000)], pa.list_(pa.float32()))], ["id", "embedding"]))
    got = best.result().to_pydict()
    assert got["qid"] == ["p"] * 3 + ["q"] * 3 and got["id"] == [499, 999, 1499, 0, 500, 1000]


def test_names_of_one_character(spark):
    texts = spark.createDataFrame([(1, "姜和生姜"), (2, "参"), (3, ""), (4, None)], "id int, t string")
    names = spark.createDataFrame([("姜",), ("生姜",), ("参",), ("",), (None,)], "n string")
    got = {tuple(r) for r in matching.contained_names(texts, names, "id", "t", "n").collect()}
    assert got == {(1, "姜"), (1, "生姜"), (2, "参")}
    scanned = {(r["id"], r["term"], r["n"]) for r in diagnose.term_scan(texts, "id", "t", names.toDF("term")).collect()}
    assert scanned == {(1, "姜", 2), (1, "生姜", 1), (2, "参", 1)}


def test_many_query_terms_give_the_same_hits(spark):
    docs = spark.createDataFrame([(i, "人参 性状 " * (i % 3) + f"甘草{i}") for i in range(40)], "id int, t string")
    index = bm25.build(docs, tokens.mixed_tokens(F.col("t")))
    asked = spark.createDataFrame([(q, t) for q in range(5) for t in ("人参", "性状", "甘草")], "qid int, term string")
    few, many = (sorted(bm25.search(index, asked, 4, most=most).collect()) for most in (1_000, 2))
    assert few == many and len(few) == 20


def test_index_of_a_text_counts_its_mixed_tokens(spark):
    texts = ["人参 性状ab人a参3人参", "人", "", None, "一鿿。丁", "a\nb人\n参", "x😀人😀参黄", "AB12人参人参人参", "é人ａ１"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    slow, fast = bm25.build(docs, tokens.mixed_tokens(F.col("t"))), bm25.build_mixed(docs, "t")
    assert sorted(slow.postings.collect()) == sorted(fast.postings.collect()) and slow.stats.first() == fast.stats.first()


def test_pruned_search_gives_the_lists_of_a_whole_one(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    monkeypatch.setattr(bm25, "LEAST_POSTINGS", 300)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [[rng.choice(words[: rng.choice((2, 8, 60))]) for _ in range(rng.randrange(40))] for _ in range(400)]
    asked = [rng.sample(words, rng.randrange(1, 6)) for _ in range(60)]
    asked += [asked[0], asked[0] * 2, ["w0"], ["w0", "none"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id bigint, t string")
    terms = spark.createDataFrame([(q, t) for q, a in enumerate(asked) for t in a], "qid bigint, term string")
    index = bm25.build(docs, F.filter(F.split("t", " "), lambda x: x != ""))
    lists, members = bm25.search_groups(index, terms, 7)
    assert members.count() == len(asked) and members.select("gid").distinct().count() < len(asked) - 1
    got = {}
    for r in members.join(lists, "gid").collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], round(r["score"], 6)))

    df = Counter(t for x in texts for t in set(x))
    raw = {t: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor, mean = sum(raw.values()) / len(raw) * bm25.EPSILON, sum(map(len, texts)) / len(texts)
    for q, a in enumerate(asked):
        score = {}
        for d, x in enumerate(texts):
            for t in a:
                if n := x.count(t):
                    score[d] = score.get(d, 0) + (floor if raw[t] < 0 else raw[t]) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(x) / mean))
        best = sorted((-round(s, 9), d) for d, s in score.items())[:7]
        assert sorted(got.get(q, [])) == [(i + 1, d, round(-s, 6)) for i, (s, d) in enumerate(best) if s < 0], q


@pytest.mark.parametrize("dense", (0, 8, 1_000))
def test_shard_returns_the_best_with_terms_below_zero(monkeypatch, dense):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(bm25, "DENSE", dense)
    rng = np.random.default_rng(5)
    tf = rng.integers(1, 5, (300, 12)) * (rng.random((300, 12)) < np.linspace(0.02, 0.9, 12))
    dl = rng.integers(1, 40, 300)
    doc, slot = np.nonzero(tf)
    places = pa.table({"slot": slot, "id": doc, "tf": tf[doc, slot].astype(np.int32), "dl": dl[doc].astype(np.int32)})
    bags = [(rng.choice(14, n := rng.integers(1, 7), replace=False), rng.choice((-0.4, 0.5, 2.0, 4.0), n)) for _ in range(200)]
    queries = pa.table({"gid": range(200), "slots": [list(map(int, b[0])) for b in bags], "factors": [b[1].tolist() for b in bags], "least": np.zeros(200)})
    got = {}
    for r in bm25._shard_top(places, queries, 4, 1.5, 0.75, 20.0).to_pylist():
        got.setdefault(r["gid"], []).append((-round(r["score"], 9), r["id"]))
    weight = np.hstack([tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl[:, None] / 20.0)), np.zeros((300, 2))])
    for q, (terms, factors) in enumerate(bags):
        score = weight[:, terms] @ factors
        assert sorted(got.get(q, [])) == sorted((-round(s, 9), d) for d, s in enumerate(score.tolist()) if s > 1e-9)[:4], q


def test_equal_documents_of_different_shards_have_equal_scores():
    """Whatever else a shard holds: sums of another order may differ in what rounding sees."""
    import pyarrow as pa

    rng = random.Random(1)
    bags = [[rng.uniform(0.1, 2) for _ in range(6)] for _ in range(40)]

    def scores(*others):
        rows = [(slot, 7, 1, 20) for slot in range(6)] + list(others)
        slots, ids, tf, dl = zip(*rows)
        places = pa.table({"slot": slots, "id": ids, "tf": pa.array(tf, pa.int32()), "dl": pa.array(dl, pa.int32())})
        queries = pa.table({"gid": range(40), "slots": [list(range(6))] * 40, "factors": bags, "least": [0.0] * 40})
        return {r["gid"]: r["score"] for r in bm25._shard_top(places, queries, 9, 1.5, 0.75, 30.0).to_pylist() if r["id"] == 7}

    one = scores()
    assert len(one) == 40 and all(scores((slot, 8, 50, 5), (other, 9, 9, 5)) == one for slot in range(6) for other in range(6))


def test_index_saved_where_it_is_counted(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"人参性状{'甘草' * (i % 3)} a{i}") for i in range(30)] + [(30, None)], "id int, t string")
    bm25.build_mixed(docs, "t").save(f"{tmp_path}/a")
    bm25.build_mixed(docs, "t", path=f"{tmp_path}/b")
    a, b = (bm25.Bm25Index.load(spark, f"{tmp_path}/{x}") for x in "ab")
    for part in ("postings", "terms", "stats"):
        rows = sorted(getattr(a, part).collect())
        assert rows == sorted(getattr(b, part).collect()) and rows


def test_answer_questions(spark):
    from vellumflow.operators import pipeline

    docs = spark.createDataFrame([(1, "人参", "贮藏", "药材和饮片", "置阴凉干燥处，每次3g。"), (2, "黄连", "性状", "药材和饮片", "断面黄色。")], "chunk_seq bigint, drug_name string, section string, category string, content string")
    rows = [(1, "s", 1, "人参的性状"), (2, "s", 2, "它怎么样"), (3, None, 3, "今天股票"), (4, None, 4, None), (5, "t", 5, "它怎么样")]
    asked = spark.createDataFrame(rows, "qid bigint, conv_id string, turn bigint, text string")
    got = {r["qid"]: r for r in pipeline.answer_questions(asked, docs, chat=lambda: lambda prompt: "用量9g。").collect()}
    assert [got[i]["verdict"] for i in range(1, 6)] == ["pass", "pass", "reject", "reject", "pass"]
    assert got[2]["resolved"] == "人参怎么样" and got[5]["resolved"] == "它怎么样"
    assert got[1]["citations"][0] == "药典-人参-贮藏" and got[1]["issues"] == ["9g"] and got[1]["has_disclaimer"]
    assert got[3]["answer"] == got[4]["answer"] == pipeline.REJECTED and got[3]["n_sources"] == 0
    assert pipeline.answer_questions(asked.filter("false"), docs).count() == 0


def test_filtered_lists_and_once_searched_texts(spark):
    """Many queries of few texts: the lists of words are filtered as after the search, and the
    answers of equal questions are equal."""
    from vellumflow.operators import pipeline

    docs = spark.createDataFrame([(i, ("人参", "黄连", "红参")[i % 3], "性状", "药材和饮片", "人参断面" * (i % 5) + f"黄连色{i}") for i in range(60)], "chunk_seq bigint, drug_name string, section string, category string, content string")
    asked = spark.createDataFrame([(q, f"{('人参', '黄连', '人参黄连', '')[q % 4]}的断面") for q in range(12)], "qid bigint, query string")
    names = docs.select("drug_name").distinct()
    parsed = queryparse.parse(asked, names, "drug_name").cache()
    allowed = retrieve.allowed_names(parsed, names, "drug_name").cache()
    index = bm25.build_mixed(docs, "content", "chunk_seq")
    by = [parsed, docs, allowed, "chunk_seq", "drug_name", "category"]
    slow = retrieve.post_filter(retrieve.word_recall(index, parsed, 5, 2), *by)
    fast = retrieve.filtered_word_recall(index, *by, 5, 2)
    key = lambda df: sorted((r["qid"], r["id"], r["rank"]) for r in df.collect())
    assert key(slow) == key(fast) and fast.count() > 30
    turns = asked.select("qid", F.lit(None).cast("string").alias("conv_id"), F.col("qid").alias("turn"), F.col("query").alias("text"))
    got = {r["qid"]: r for r in pipeline.answer_questions(turns, docs).collect()}
    assert len(got) == 12 and all(got[q]["answer"] == got[q % 4]["answer"] and got[q]["n_sources"] > 0 for q in got)


def test_many_queries_are_searched_without_a_copy_of_the_vectors(spark, monkeypatch):
    """More queries than one old block: no shards, each query's list is the exact one."""
    import numpy as np

    monkeypatch.setattr(vector, "_sharded_top", None)
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(300, 4)).round(1), rng.normal(size=(5_000, 4)).round(1)
    names = [f"n{i % 7}" for i in range(300)]
    stored = spark.createDataFrame([(i, x.tolist(), n) for i, (x, n) in enumerate(zip(v, names))], "id bigint, embedding array<float>, name string")
    lets = [None if i % 2 else [f"n{i % 5}", "n6"] for i in range(5_000)]
    asked = spark.createDataFrame([(i, x.tolist(), n) for i, (x, n) in enumerate(zip(q, lets))], "qid bigint, embedding array<float>, names array<string>")
    got = {}
    for r in vector.top_k(stored, asked, 5, within={"name": "names"}).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    scores = np.round(q.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 9)
    for i in range(5_000):
        open_ = [j for j in range(300) if lets[i] is None or names[j] in lets[i]]
        assert [j for _, j in sorted(got[i])] == sorted(open_, key=lambda j: (-scores[i, j], j))[:5], i


def test_session_table(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n int")
    asked = spark.createDataFrame([("a",), ("z",), ("a",)], "session_id string")
    assert [r["n"] for r in sessions.get(s, asked).collect()] == [1] and [r["n"] for r in sessions.delete(s, asked).collect()] == [2]
