import json
import time
import zipfile

from pyspark.sql import functions as F

from vellumflow.session import broadcast_checked, checkpoint_dir, cut, latest, only
from vellumflow.sources import blocks, stores
from vellumflow.streaming import sessions as streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(path):
    p = lambda t, s=None: f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('1')}{p('2')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('人参', 'h3')}{table}{p('正文')}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="h3"><w:name w:val="Heading #3"/></w:style></w:styles>')


def test_block_source(spark, tmp_path):
    word_file(tmp_path / "a.docx")
    spark.dataSource.register(blocks.BlockSource)
    got = spark.read.format("blocks").load(str(tmp_path)).orderBy("block_idx").collect()
    assert [(r["kind"], r["style"], r["text"]) for r in got] == [("para", "Heading #3", "人参"), ("table", None, None), ("para", "Normal", "正文")]
    assert got[1]["cells"] == [["a", "b"], ["1\n2"]]


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "text", None)], "chunk_id string, content string, table_markdown string")
    stores.write_json(rows, str(tmp_path / "chunks"))
    back = stores.read_chunks(spark, str(tmp_path / "chunks")).first()
    assert back["chunk_id"] == "c1" and back["drug_name"] is None
    v = spark.createDataFrame([(1, [0.5])], "id int, embedding array<float>")
    stores.write_vectors(v, str(tmp_path / "v"))
    stores.write_vectors(v, str(tmp_path / "v"), append=True)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    stores.truncate(spark, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 0
    cases = [{"id": f"Q{i}", "type": "a" if i % 2 else "b", "query": str(i), "expected_drugs": [], "expected_sections": [], "expected_answer_keywords": []} for i in range(6)]
    (tmp_path / "set.json").write_text(json.dumps({"name": "n", "queries": cases}))
    assert [r["id"] for r in stores.read_eval_set(spark, str(tmp_path / "set.json"), "a", 2).collect()] == ["Q1", "Q3"]
    one = spark.createDataFrame([(1,)], "n int")
    stores.write_report(one, spark.createDataFrame([("t", 2)], "type string, n int"), one, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report/report")).first()[0]) == {"n": 1, "by_type": [{"type": "t", "n": 2}]}
    assert spark.read.json(str(tmp_path / "report/results")).count() == 1


def test_latest_and_cut(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d"), (1, 2, "b")]
    df = spark.createDataFrame(rows, "k int, at int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in latest(df, "k", "at").collect()) == [(0, "d"), (1, "b"), (2, "c")]
    assert sorted((r["k"] or 0, r["v"]) for r in latest(df, "k", "at", max_rows=0).collect()) == [(0, "d"), (1, "b"), (2, "c")]
    assert cut(df).count() == 5 and checkpoint_dir(spark)


def test_session_stream(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 03:00:00"), ("u", "2024-01-03 00:00:00"), ("w", "2024-01-01 01:00:00"), ("z", "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "user string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streams.session_windows(stream, "user", "ts").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["user"], r["n_events"]) for r in spark.table("closed").collect()}
    assert got == {("u", 2), ("u", 1), ("w", 1)}  # the last one is still open
    batch = {(r["user"], r["n_events"]) for r in streams.session_windows(df, "user", "ts").collect()}
    assert batch == got | {("z", 1)}


def test_trust_stream(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "你好"), ("s", 2, "性状"), ("s", 3, "嗯"), ("t", 1, "嗯")], "sid string, turn bigint, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streams.trust(stream, "sid", "turn", "性状|鉴别").writeStream.format("memory").queryName("trusted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    ends = time.time() + 120  # a query with a timeout runs on after the last row
    while time.time() < ends and query.isActive and spark.table("trusted").count() < 4:
        time.sleep(0.2)
    query.stop()
    got = {(r["key"], r["turn"]): r["verdict"] for r in spark.table("trusted").collect()}
    assert got == {("s", 1): "ask", ("s", 2): "pass", ("s", 3): "pass", ("t", 1): "ask"}


def test_event_rows(spark):
    rows = streams.event_rows(spark.createDataFrame([(1, "x" * 120)], "id int, a string"), "id", "a").orderBy("seq").collect()
    assert [r["kind"] for r in rows] == ["content"] * 3 + ["metadata"] and json.loads(rows[-1]["payload"]) == {"length": 120}
    line = streams.sse_lines(spark.createDataFrame([(1, "content", "y")], "seq int, kind string, payload string")).first()["line"]
    assert line.startswith("data: ") and json.loads(line[6:]) == {"kind": "content", "payload": "y"}


def test_broadcast_is_checked(spark, tmp_path):
    df = spark.range(1000)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(spark.range(5).join(broadcast_checked(df), "id"))
    assert "strategy=broadcast" not in plan(spark.range(5).join(broadcast_checked(df, 10), "id"))


def test_word_files_from_any_file_system(spark, tmp_path):
    word_file(tmp_path / "b.docx")
    got = blocks.word_blocks(spark, f"file://{tmp_path}").orderBy("block_idx").collect()
    assert [(r["doc_id"], r["kind"], r["text"]) for r in got] == [("b.docx", "para", "人参"), ("b.docx", "table", None), ("b.docx", "para", "正文")]
    assert got[1]["cells"] == [["a", "b"], ["1\n2"]]


def test_chunk_table(spark, tmp_path):
    try:
        for buckets in (0, 4):
            name = f"vellum_chunks_{buckets}"
            stores.create_chunk_table(spark, name, buckets=buckets)
            stores.create_chunk_table(spark, name, buckets=buckets)  # there already
            spark.createDataFrame([("c1", "人参")], "chunk_id string, drug_name string").selectExpr("chunk_id", "'t' content", "drug_name", "'' pinyin_name", "'' latin_name", "'' category", "'' section", "'' chunk_type", "false is_yinpian", "false is_sub_formulation", "'' parent_drug", "'' table_markdown", "1 char_count").write.insertInto(name)
            assert [r["drug_name"] for r in spark.table(name).collect()] == ["人参"]
    finally:
        for buckets in (0, 4):
            spark.sql(f"DROP TABLE IF EXISTS vellum_chunks_{buckets}")


def test_only_keeps_rows_of_few_keys(spark):
    df, few = spark.range(10), spark.createDataFrame([(3,), (3,), (20,), (None,)], "id bigint")
    for bound in (0, 100):
        assert [r["id"] for r in only(df, few, "id", bound).collect()] == [3]


def test_vectors_are_read_back(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.5])], "id int, embedding array<float>")
    stores.write_vectors(v, str(tmp_path / "v"))
    assert stores.read_vectors(spark, str(tmp_path / "v")).collect() == v.collect()
