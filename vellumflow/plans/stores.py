"""Round trips through the stores, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.operators import bm25, evaluate, tokens
from vellumflow.session import read_table, shared_path
from vellumflow.sources import stores
from vellumflow.streaming import sessions as streams

from .dialogue import _REPLIES, _replies
from .ranking import _BM25, _docs
from .relational import _HITS_AT, _RANKS, _ranks


def s04_entries_store(spark, folder):
    path = shared_path(spark)
    names = [field.split(" ", 1)[0] for field in stores.ENTRIES.split(", ")]
    stores.write_json(read_table(spark, folder, "drug_entries").select(*names), path)
    return stores.read_entries(spark, path).select("drug_name", "category_hint", F.size("sections").alias("n_sections"), F.md5(F.try_element_at("sections", F.lit(1))["content"]).alias("first"))


def s05_chunks_store(spark, folder):
    path = shared_path(spark)
    names = [field.split(" ", 1)[0] for field in stores.CHUNKS.split(", ")]
    stores.write_json(read_table(spark, folder, "chunks").select(*names), path)
    return stores.read_chunks(spark, path).select("chunk_id", "section", "is_yinpian", "char_count", F.md5("content").alias("content"))


def s06_index_store(spark, folder):
    """A saved and loaded index answers as a fresh one does, for all questions."""
    path = shared_path(spark)
    bm25.build_mixed(_docs(spark, folder), "content", "chunk_seq", path)
    asked = read_table(spark, folder, "query_results").select(F.col("result_id").alias("qid"), "query").distinct()
    terms = asked.select("qid", F.explode(tokens.mixed_tokens(F.col("query"))).alias("term"))
    return bm25.search(bm25.Bm25Index.load(spark, path), terms, 5).select("qid", "id", "rank")


def s07_vector_store(spark, folder):
    path = shared_path(spark)
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    stores.write_vectors(vectors, path)
    stores.write_vectors(vectors.filter("vec_id < 10"), path, append=True)
    return stores.read_vectors(spark, path).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"))


def s10_truncate(spark, folder):
    path = shared_path(spark)
    stores.write_vectors(read_table(spark, folder, "embeddings"), path)
    stores.truncate(spark, path)
    return stores.read_vectors(spark, path).agg(F.count(F.lit(1)).alias("n"))


def s11_eval_set(spark, folder):
    """The section catalog, which does not grow, as an evaluation set."""
    path = shared_path(spark)
    none = F.array().cast("array<string>")
    case = F.struct(F.concat(F.lit("Q"), F.col("canon_id")).alias("id"), F.col("section_group").alias("type"), F.col("section_name").alias("query"), none.alias("expected_drugs"), F.array("section_name").alias("expected_sections"), F.coalesce("aliases", none).alias("expected_answer_keywords"))
    catalog = read_table(spark, folder, "section_catalog").select("canon_id", case.alias("q"))
    one = catalog.agg(F.array_sort(F.collect_list(F.struct("canon_id", "q"))).alias("c")).select(F.lit("catalog").alias("name"), F.transform("c", lambda c: c["q"]).alias("queries"))
    one.select(F.to_json(F.struct("*"))).coalesce(1).write.text(path)
    first = stores.read_eval_set(spark, path).first()["type"]
    return stores.read_eval_set(spark, path, first, 3).select("id", "query", F.size("expected_answer_keywords").alias("n_keywords"))


def s12_report_store(spark, folder):
    path = shared_path(spark)
    ranks = _ranks(spark, folder)
    stores.write_report(evaluate.retrieval_report(ranks, []), evaluate.retrieval_report(ranks, ["query_type"]), ranks, path)
    kind = "n bigint, hit_at_1 double, hit_at_3 double, hit_at_5 double, mrr double, by_type array<struct<query_type:string>>"
    back = spark.read.text(f"{path}/report").select(F.from_json("value", kind).alias("r")).select("r.n", "r.hit_at_1", "r.hit_at_3", "r.hit_at_5", "r.mrr", F.size("r.by_type").alias("n_types"))
    return back.crossJoin(spark.read.json(f"{path}/results").agg(F.count(F.lit(1)).alias("n_results")))  # one row each


def s13_event_lines(spark, folder):
    """The lines of the event stream of every reply."""
    rows = streams.event_rows(_replies(spark, folder).filter("raw_answer <> ''"), "response_id", "raw_answer")
    return streams.sse_lines(rows).select("response_id", "seq", F.substring("line", 1, 6).alias("head"), F.get_json_object(F.substring_index(F.substring("line", 7, 1_000), "\n\n", 1), "$.payload").alias("payload"))


QUERIES = {f.__name__: f for f in (s04_entries_store, s05_chunks_store, s06_index_store, s07_vector_store, s10_truncate, s11_eval_set, s12_report_store, s13_event_lines)}

_ALL_ASKED = "(SELECT DISTINCT result_id AS qid, query FROM query_results)"

SQL = {
    "s04_entries_store": "SELECT drug_name, category_hint, len(sections)::INT AS n_sections, md5(sections[1].content) AS first FROM drug_entries",
    "s05_chunks_store": "SELECT chunk_id, section, is_yinpian, char_count, md5(content) AS content FROM chunks",
    "s06_index_store": f"WITH {_BM25.replace('@asked', _ALL_ASKED)} SELECT qid, id, rank FROM bm WHERE rank <= 5",
    "s07_vector_store": "SELECT vec_id, CASE WHEN vec_id < 10 THEN 2 ELSE 1 END * count(*) AS n, max(len(embedding))::INT AS dim FROM embeddings GROUP BY vec_id",
    "s10_truncate": "SELECT 0 AS n",
    "s11_eval_set": "SELECT 'Q' || canon_id AS id, section_name AS query, coalesce(len(aliases), 0)::INT AS n_keywords FROM section_catalog WHERE section_group = (SELECT arg_min(section_group, canon_id) FROM section_catalog) ORDER BY canon_id LIMIT 3",
    "s12_report_store": f"SELECT count(*) AS n, {_HITS_AT}, (SELECT count(DISTINCT query_type) FROM {_RANKS})::INT AS n_types, count(*) AS n_results FROM {_RANKS}",
    "s13_event_lines": f"SELECT response_id, (i // 50)::INT AS seq, 'data: ' AS head, substr(raw_answer, i + 1, 50) AS payload FROM (SELECT response_id, raw_answer, unnest(range(0, length(raw_answer), 50))::INT AS i FROM {_REPLIES} WHERE raw_answer <> '') UNION ALL SELECT response_id, ((length(raw_answer) + 49) // 50)::INT, 'data: ', '{{\"length\":' || length(raw_answer) || '}}' FROM {_REPLIES} WHERE raw_answer <> ''",
}
