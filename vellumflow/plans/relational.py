"""Catalog, stores, evaluation, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.functions.text import any_of
from vellumflow.operators import catalog, diagnose, evaluate
from vellumflow.session import latest, read_table

from .blocks import BLOCKS_SQL, block_stream
from .common import any_sql
from .ranking import _BM25_CTES, _DOCS, _LONGEST, _bm25, _docs, q01_entities

KEY = ["chunk_seq", "drug_name", "section", "chunk_type"]


def _chunks(spark, folder):
    return read_table(spark, folder, "chunks")


def m01_point_lookup(spark, folder):
    return catalog.select_rows(_chunks(spark, folder), {"chunk_id": "chunk_000042"}, "chunk_seq").select(*KEY)


def m02_multi_lookup(spark, folder):
    ids = read_table(spark, folder, "query_results").select(F.col("result_id").alias("chunk_seq")).filter("hit")
    return catalog.by_ids(_chunks(spark, folder), ids, "chunk_seq").select(*KEY)


def m03_dynamic_filter(spark, folder):
    return catalog.select_rows(_chunks(spark, folder), {"category": "药材和饮片", "chunk_type": ["detailed", "clinical"], "section": None, "is_yinpian": False}, "chunk_seq").select(*KEY)


def m04_distinct_names(spark, folder):
    return catalog.distinct_names(_chunks(spark, folder), "drug_name")


def m05_count(spark, folder):
    return _chunks(spark, folder).agg(F.count(F.lit(1)).alias("n"))


def m06_stats(spark, folder):
    return catalog.grouped_counts(_chunks(spark, folder), ["category", "chunk_type"], "drug_name")


def s08_append(spark, folder):
    """Late rows appended to all rows; ids are not made unique."""
    rows = _chunks(spark, folder).select("chunk_seq", "loaded_at", "created_at")
    late = rows.filter(F.col("loaded_at") > F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    return rows.unionByName(late).select("chunk_seq", "loaded_at")


def s09_upsert(spark, folder):
    rows = _chunks(spark, folder).select("chunk_seq", "loaded_at", "char_count")
    cut = F.lit("2024-07-01").cast("timestamp")
    new = rows.filter(F.col("loaded_at") >= cut).withColumn("char_count", F.lit(-1))
    return catalog.upsert(rows.filter(F.col("loaded_at") < cut), new, "chunk_seq", "loaded_at")


def s11_eval_cases(spark, folder):
    cases = read_table(spark, folder, "query_results").filter("query_type = '多轮对话'").orderBy("result_id", "loaded_at").limit(50)
    return cases.select("result_id", "query", "query_type")


def s12_report_json(spark, folder):
    report = evaluate.retrieval_report(_ranks(spark, folder), ["query_type"])
    return report.select("query_type", F.to_json(F.struct("n", "hit_at_1")).alias("json"))


def a01_post_topk_filter(spark, folder):
    """The section filter stands above the limit, so fewer rows come back."""
    meta = _docs(spark, folder).select(F.col("chunk_seq").alias("id"), "section", F.substring("content", 1, 500).alias("content"))
    return _bm25(spark, folder).filter("rank <= 5").join(meta, "id").filter("section = '性状'").select("qid", "id", "rank", "content")


def a02_catalog(spark, folder):
    allowed = _chunks(spark, folder).filter("category = '药材和饮片'")
    return catalog.list_names(_chunks(spark, folder), "drug_name", "白", allowed, 20)


def a03_stats(spark, folder):
    vectors = read_table(spark, folder, "embeddings").agg(F.count(F.lit(1)).alias("n_vectors"))
    chunks = _chunks(spark, folder).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("drug_name").alias("n_names"))
    return chunks.crossJoin(vectors)  # one row each


def _results(spark, folder):
    return latest(read_table(spark, folder, "query_results"), "result_id")


def _hits(spark, folder):
    expected = q01_entities(spark, folder).groupBy("qid").agg(F.collect_list("name").alias("expected"))
    results = _results(spark, folder).select(F.col("result_id").alias("qid"), F.posexplode("retrieved_drugs").alias("pos", "name"))
    return results.join(expected, "qid", "left").withColumn("rank", F.col("pos") + 1)


def e01_hit(spark, folder):
    return _hits(spark, folder).select("qid", "rank", evaluate.is_hit(F.col("name"), F.col("expected")).alias("hit"))


def e02_first_rank(spark, folder):
    return evaluate.first_hit(_hits(spark, folder), "qid", "name", "expected")


def _ranks(spark, folder):
    return _results(spark, folder).select("query_type", F.coalesce("first_hit_rank", F.lit(0)).alias("first_hit_rank"), F.col("retrieval_latency").alias("latency"))


def e03_hit_mrr(spark, folder):
    r = F.col("first_hit_rank")
    return _ranks(spark, folder).agg(*[F.round(evaluate.hit_at(r, k), 6).alias(f"hit_at_{k}") for k in (1, 3, 5)], F.round(evaluate.mrr(r), 6).alias("mrr"))


def e04_percentile(spark, folder):
    found = evaluate.nearest_percentiles(_ranks(spark, folder), "latency", [], [50, 95, 99])
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def e05_by_type(spark, folder):
    return evaluate.retrieval_report(_ranks(spark, folder), ["query_type"])


def e06_coverage(spark, folder):
    return _results(spark, folder).select("result_id", F.round(evaluate.keyword_coverage(F.col("answer"), F.col("retrieved_sections")), 6).alias("coverage"), evaluate.scored_disclaimer(F.col("answer")).alias("disclaimer"))


def e06_generation_report(spark, folder):
    return evaluate.generation_report(_results(spark, folder), ["query_type"])


def e08_report_views(spark, folder):
    r = _results(spark, folder).filter("keyword_coverage < 0.3").select("result_id", F.round("keyword_coverage", 6).alias("coverage"))
    return r.orderBy("coverage", "result_id").limit(10).crossJoin(F.broadcast(r.agg(F.count(F.lit(1)).alias("n_low"))))  # one row


def e08_types(spark, folder):
    report = evaluate.retrieval_report(_ranks(spark, folder), ["query_type"])
    return evaluate.type_view(report).select("query_type", "n", "place")


def e08_misses(spark, folder):
    r = _results(spark, folder)
    found = evaluate.first_rows(r, ~F.coalesce("hit", F.lit(False)), "result_id", 20)
    return found.select("result_id", "query", F.array_join(F.slice("retrieved_drugs", 1, 3), ",").alias("found"), "n_all")


def e08_issues(spark, folder):
    found = evaluate.first_rows(_results(spark, folder), F.coalesce("has_consistency_issues", F.lit(False)), "result_id", 5)
    return found.select("result_id", F.substring("query", 1, 40).alias("query"), "n_all")


def x01_audit_missing(spark, folder):
    asked = read_table(spark, folder, "query_results").select(F.explode("retrieved_drugs").alias("name")).distinct()
    some = read_table(spark, folder, "drug_entries").filter("is_yinpian = false")
    return diagnose.missing_names(asked, some, "drug_name")


def x02_membership(spark, folder):
    asked = read_table(spark, folder, "query_results").select(F.explode("retrieved_drugs").alias("name")).distinct()
    return diagnose.membership(asked, read_table(spark, folder, "drug_entries"), "drug_name")


def x03_prefix(spark, folder):
    return diagnose.with_prefix(_chunks(spark, folder), "drug_name", ["白", "黄", "金"])


def x04_residual_list(spark, folder):
    """Names that still hold a misread part."""
    names = _chunks(spark, folder).select("drug_name").filter("drug_name IS NOT NULL").distinct()
    terms = spark.createDataFrame([("-饮",), ("Plus",), ("口服",)], "term string")
    return diagnose.term_scan(names, "drug_name", "drug_name", terms).select("drug_name", "term")


def x05_neighbours(spark, folder):
    return diagnose.neighbours(block_stream(spark, folder), F.coalesce(F.length("text").between(1, 6), F.lit(False)))


def x05_style_histogram(spark, folder):
    return block_stream(spark, folder).groupBy("style", "kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"))


def x06_term_scan(spark, folder):
    terms = read_table(spark, folder, "section_catalog").select(F.col("section_name").alias("term"))
    return diagnose.term_scan(_chunks(spark, folder), "chunk_seq", "content", terms)


def x07_top_groups(spark, folder):
    return diagnose.top_groups(_chunks(spark, folder).filter("drug_name IS NOT NULL"), "drug_name")


def x07_top_customers(spark, folder):
    return diagnose.top_groups(read_table(spark, folder, "orders"), "o_custkey", 20)


def x08_failure_classes(spark, folder):
    """Misses by cause; the names of the question are expected."""
    names = q01_entities(spark, folder).groupBy(F.col("qid").alias("key")).agg(F.collect_set("name").alias("expected"))
    cases = _results(spark, folder).select(F.col("result_id").alias("key"), F.coalesce("hit", F.lit(False)).alias("hit"), F.col("retrieved_drugs").alias("retrieved"))
    return diagnose.failure_classes(cases.join(names, "key", "left"), read_table(spark, folder, "drug_entries"), "drug_name")


def _metrics(rows):
    return rows.groupBy(F.col("query_type").alias("metric")).agg(F.round(F.avg("keyword_coverage"), 6).alias("value"))


def x09_delta(spark, folder):
    r = _results(spark, folder)
    return evaluate.delta(_metrics(r.filter("run_id < 'run_010'")), _metrics(r.filter("run_id >= 'run_010'")))


def x10_case_join(spark, folder):
    replies = latest(read_table(spark, folder, "gen_responses"), "response_id").select("query", "response_id")
    return _results(spark, folder).select("result_id", "query", "hit").join(replies, "query").select("result_id", "response_id", "hit")


def x11_view_aggregates(spark, folder):
    r = _results(spark, folder).filter("retrieval_latency IS NOT NULL")
    return r.select("result_id", diagnose.latency_tier(F.col("retrieval_latency") * 1000).alias("tier"), diagnose.score_bar(F.col("keyword_coverage")).alias("bar"))


def x12_misses(spark, folder):
    return _results(spark, folder).filter("hit = false").select("result_id", "query", F.size("retrieved_drugs").alias("n"), any_of(F.col("query"), ("性状", "鉴别")).alias("identity"))


QUERIES = {f.__name__: f for f in (m01_point_lookup, m02_multi_lookup, m03_dynamic_filter, m04_distinct_names, m05_count, m06_stats, s08_append, s09_upsert, s11_eval_cases, s12_report_json, a01_post_topk_filter, a02_catalog, a03_stats, e01_hit, e02_first_rank, e03_hit_mrr, e04_percentile, e05_by_type, e06_coverage, e06_generation_report, e08_report_views, e08_types, e08_misses, e08_issues, x01_audit_missing, x02_membership, x03_prefix, x04_residual_list, x05_neighbours, x05_style_histogram, x06_term_scan, x07_top_groups, x07_top_customers, x08_failure_classes, x09_delta, x10_case_join, x11_view_aggregates, x12_misses)}

_K = ", ".join(KEY)
_R = "(SELECT * FROM query_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1)"
_HITS = f"""SELECT r.qid, r.name, r.rank, x.expected FROM (SELECT result_id AS qid, unnest(retrieved_drugs) AS name, unnest(generate_series(1, len(retrieved_drugs))) AS rank FROM {_R}) AS r
LEFT JOIN (SELECT qid, list(name) AS expected FROM ({_LONGEST}) GROUP BY 1) AS x ON x.qid = r.qid"""
_HIT = "(coalesce(len(expected), 0) = 0 OR coalesce(len(list_filter(expected, lambda e: e <> '' AND name <> '' AND (contains(name, e) OR contains(e, name)))) > 0, false))"
_PCT = "round(list_sort(list(latency))[least(floor(count(latency) * {p} / 100) + 1, count(latency))::INT], 6) AS p{p}"
_RANKS = f"(SELECT query_type, coalesce(first_hit_rank, 0) AS f, retrieval_latency AS latency FROM {_R})"
_HITS_AT = ", ".join(f"round(avg(CASE WHEN f BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}" for k in (1, 3, 5)) + ", round(avg(CASE WHEN f > 0 THEN 1.0::DOUBLE / f ELSE 0.0 END), 6) AS mrr"
_ASKED_NAMES = "(SELECT DISTINCT unnest(retrieved_drugs) AS name FROM query_results)"
_RELATED = "(contains(c.name, a.name) OR contains(a.name, c.name))"

SQL = {
    "m01_point_lookup": f"SELECT {_K} FROM chunks WHERE chunk_id = 'chunk_000042'",
    "m02_multi_lookup": f"SELECT {_K} FROM chunks WHERE chunk_seq IN (SELECT result_id FROM query_results WHERE hit)",
    "m03_dynamic_filter": f"SELECT {_K} FROM chunks WHERE category = '药材和饮片' AND chunk_type IN ('detailed', 'clinical') AND is_yinpian = false",
    "m04_distinct_names": "SELECT DISTINCT drug_name FROM chunks WHERE drug_name IS NOT NULL",
    "m05_count": "SELECT count(*) AS n FROM chunks",
    "m06_stats": "SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(chunk_type) = 0 THEN 'chunk_type' ELSE 'total' END AS dimension, coalesce(category, chunk_type) AS value, count(*) AS n, count(DISTINCT drug_name) AS n_names FROM chunks GROUP BY GROUPING SETS ((category), (chunk_type), ())",
    "s08_append": "SELECT chunk_seq, loaded_at FROM chunks UNION ALL SELECT chunk_seq, loaded_at FROM chunks WHERE loaded_at > created_at + INTERVAL 1 DAY",
    "s09_upsert": "WITH n AS (SELECT chunk_seq, loaded_at, -1 AS char_count FROM chunks WHERE loaded_at >= TIMESTAMPTZ '2024-07-01 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY chunk_seq ORDER BY loaded_at DESC) = 1) SELECT chunk_seq, loaded_at, char_count FROM chunks WHERE loaded_at < TIMESTAMPTZ '2024-07-01 00:00:00+00' AND chunk_seq NOT IN (SELECT chunk_seq FROM n) UNION ALL SELECT * FROM n",
    "s11_eval_cases": "SELECT result_id, query, query_type FROM query_results WHERE query_type = '多轮对话' ORDER BY result_id, loaded_at LIMIT 50",
    "s12_report_json": f"SELECT query_type, '{{\"n\":' || count(*) || ',\"hit_at_1\":' || CASE WHEN h = floor(h) THEN h::BIGINT || '.0' ELSE h::VARCHAR END || '}}' AS json FROM (SELECT query_type, round(avg(CASE WHEN f BETWEEN 1 AND 1 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY query_type), 6) AS h FROM {_RANKS}) GROUP BY query_type, h",
    "a01_post_topk_filter": f"WITH {_BM25_CTES} SELECT qid, id, rank, substr(content, 1, 500) AS content FROM bm JOIN {_DOCS} AS d ON d.chunk_seq = bm.id WHERE rank <= 5 AND section = '性状'",
    "a02_catalog": "WITH n AS (SELECT DISTINCT drug_name FROM chunks WHERE contains(drug_name, '白') AND drug_name IN (SELECT drug_name FROM chunks WHERE category = '药材和饮片')) SELECT drug_name, (SELECT count(*) FROM n) AS total FROM n ORDER BY drug_name LIMIT 20",
    "a03_stats": "SELECT (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(DISTINCT drug_name) FROM chunks) AS n_names, (SELECT count(*) FROM embeddings) AS n_vectors",
    "e01_hit": f"SELECT qid, rank::INT AS rank, {_HIT} AS hit FROM ({_HITS})",
    "e02_first_rank": f"SELECT qid, coalesce(min(CASE WHEN {_HIT} THEN rank END), 0)::INT AS first_hit_rank FROM ({_HITS}) GROUP BY qid",
    "e03_hit_mrr": f"SELECT {_HITS_AT} FROM {_RANKS}",
    "e04_percentile": f"SELECT {', '.join(_PCT.format(p=p) for p in (50, 95, 99))} FROM {_RANKS} WHERE latency IS NOT NULL",
    "e05_by_type": f"SELECT query_type, count(*) AS n, {_HITS_AT}, {', '.join(_PCT.format(p=p).replace('list(latency)', 'list(latency) FILTER (latency IS NOT NULL)') for p in (50, 95))} FROM {_RANKS} GROUP BY 1",
    "e06_coverage": f"SELECT result_id, round(CASE WHEN len(retrieved_sections) > 0 THEN len(list_filter(retrieved_sections, lambda k: contains(lower(answer), lower(k)))) / len(retrieved_sections) ELSE 1.0 END, 6) AS coverage, contains(answer, '遵医嘱') OR contains(answer, '具体用药') AS disclaimer FROM {_R}",
    "e06_generation_report": f"SELECT query_type, count(*) AS n, round(avg(keyword_coverage), 6) AS coverage, round(avg(has_citations::INT), 6) AS citation_rate, round(avg(has_consistency_issues::INT), 6) AS issue_rate, round(avg(has_medical_disclaimer::INT), 6) AS disclaimer_rate, round(avg(generation_latency), 6) AS generation_latency, round(avg(CASE WHEN retrieval_latency > 0 THEN retrieval_latency END), 6) AS retrieval_latency FROM {_R} GROUP BY 1",
    "e08_report_views": f"SELECT result_id, round(keyword_coverage, 6) AS coverage, count(*) OVER () AS n_low FROM {_R} WHERE keyword_coverage < 0.3 ORDER BY coverage, result_id LIMIT 10",
    "e08_types": f"SELECT query_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, query_type)::INT AS place FROM {_R} GROUP BY 1",
    "e08_misses": f"SELECT result_id, query, array_to_string(retrieved_drugs[1:3], ',') AS found, count(*) OVER () AS n_all FROM {_R} WHERE NOT coalesce(hit, false) ORDER BY result_id LIMIT 20",
    "e08_issues": f"SELECT result_id, substr(query, 1, 40) AS query, count(*) OVER () AS n_all FROM {_R} WHERE has_consistency_issues ORDER BY result_id LIMIT 5",
    "x01_audit_missing": f"WITH c AS (SELECT DISTINCT drug_name AS name FROM drug_entries WHERE is_yinpian = false), m AS (SELECT name FROM {_ASKED_NAMES} WHERE name NOT IN (SELECT name FROM c WHERE name IS NOT NULL) AND regexp_replace(name, '-饮片$', '') NOT IN (SELECT name FROM c WHERE name IS NOT NULL)) SELECT a.name, (SELECT c.name FROM c WHERE length(c.name) >= 2 AND length(a.name) >= 2 AND {_RELATED} ORDER BY length(c.name), c.name LIMIT 1) AS suggestion FROM m AS a",
    "x02_membership": f"WITH c AS (SELECT DISTINCT drug_name AS name FROM drug_entries WHERE drug_name IS NOT NULL) SELECT name, CASE WHEN name IN (SELECT name FROM c) THEN 'exact' WHEN EXISTS (SELECT 1 FROM c WHERE contains(c.name, a.name) AND c.name <> a.name) THEN 'contained' ELSE 'absent' END AS found FROM {_ASKED_NAMES} AS a",
    "x03_prefix": "SELECT DISTINCT drug_name FROM chunks WHERE starts_with(drug_name, '白') OR starts_with(drug_name, '黄') OR starts_with(drug_name, '金')",
    "x04_residual_list": "SELECT DISTINCT drug_name, term FROM chunks, (SELECT unnest(['-饮', 'Plus', '口服']) AS term) WHERE contains(drug_name, term)",
    "x05_neighbours": f"SELECT doc_id, block_idx, text, before_1, after_1 FROM (SELECT *, lag(text) OVER w AS before_1, lead(text) OVER w AS after_1 FROM ({BLOCKS_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)) WHERE length(text) BETWEEN 1 AND 6",
    "x05_style_histogram": f"SELECT style, kind, count(*) AS n, max(length(text))::INT AS longest FROM ({BLOCKS_SQL}) GROUP BY 1, 2",
    "x06_term_scan": "SELECT DISTINCT chunk_seq, section_name AS term, ((length(content) - length(replace(content, section_name, ''))) / length(section_name))::BIGINT AS n FROM chunks, section_catalog WHERE contains(content, section_name)",
    "x07_top_groups": "SELECT drug_name, count(*) AS n FROM chunks WHERE drug_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, drug_name LIMIT 10",
    "x07_top_customers": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20",
    "x08_failure_classes": f"WITH m AS (SELECT result_id, x.name, retrieved_drugs AS r FROM {_R} LEFT JOIN ({_LONGEST}) AS x ON x.qid = result_id WHERE NOT coalesce(hit, false)), c AS (SELECT result_id, bool_or(name IN (SELECT drug_name FROM drug_entries WHERE drug_name IS NOT NULL) AND name IS NOT NULL) AS known, bool_or(coalesce(list_contains(r, name), false)) AS got FROM m GROUP BY 1), g AS (SELECT CASE WHEN NOT coalesce(known, false) THEN 'missing_from_data' WHEN NOT got THEN 'not_retrieved' ELSE 'section_mismatch' END AS failure, count(*) AS n FROM c GROUP BY 1) SELECT failure, n, round(n * 100.0 / sum(n) OVER (), 6) AS percent FROM g",
    "x09_delta": f"WITH a AS (SELECT query_type AS metric, round(avg(keyword_coverage), 6) AS before FROM {_R} WHERE run_id < 'run_010' GROUP BY 1), b AS (SELECT query_type AS metric, round(avg(keyword_coverage), 6) AS after FROM {_R} WHERE run_id >= 'run_010' GROUP BY 1) SELECT metric, before, after, round(after - before, 6) AS change FROM a FULL JOIN b USING (metric)",
    "x10_case_join": f"SELECT result_id, response_id, hit FROM {_R} AS r JOIN (SELECT * FROM gen_responses QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY loaded_at DESC) = 1) AS g ON r.query = g.query",
    "x11_view_aggregates": f"SELECT result_id, CASE WHEN retrieval_latency * 1000 < 1000 THEN 'fast' WHEN retrieval_latency * 1000 < 3000 THEN 'usual' ELSE 'slow' END AS tier, least(greatest(round(keyword_coverage * 100), 5), 100)::INT AS bar FROM {_R} WHERE retrieval_latency IS NOT NULL",
    "x12_misses": f"SELECT result_id, query, len(retrieved_drugs)::INT AS n, {any_sql('query', ('性状', '鉴别'))} AS identity FROM {_R} WHERE hit = false",
}
