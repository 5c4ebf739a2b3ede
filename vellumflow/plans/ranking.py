"""Tokens, BM25, vectors, fusion, question reading, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumflow.operators import bm25, fusion, models, queryparse, retrieve, tokens, vector
from vellumflow.operators.matching import contained_names, longest_names, related_names
from vellumflow.session import latest, read_table

from .common import any_sql, list_sql, quoted, strip_sql

#: Every twentieth row asks, against all rows.
EVERY = 20


def _docs(spark, folder):
    return latest(read_table(spark, folder, "chunks").select("chunk_seq", "loaded_at", "content", "drug_name", "section", "category"), "chunk_seq")


def _asked(spark, folder):
    rows = read_table(spark, folder, "query_results").filter(F.col("result_id") % EVERY == 0)
    return rows.select(F.col("result_id").alias("qid"), "query").distinct()


def _names(spark, folder):
    return read_table(spark, folder, "drug_entries").select("drug_name").filter("drug_name IS NOT NULL").distinct()


def b01_tokens(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", F.array_join(tokens.mixed_tokens(F.col("text")), " ").alias("tokens"))


def b02_lexicon_tokens(spark, folder):
    """Longest match against all entry names."""
    found = tokens.lexicon_tokens(read_table(spark, folder, "gen_responses"), "response_id", "query", _names(spark, folder), "drug_name")
    return found.select("response_id", F.array_join("tokens", " ").alias("tokens"))


def b03_bm25_build(spark, folder):
    return bm25.build_mixed(_docs(spark, folder), "content", "chunk_seq").terms.select("term", "df", F.round("idf", 6).alias("idf"))


def b05_count(spark, folder):
    return bm25.build_mixed(_docs(spark, folder), "content", "chunk_seq").counts()


def _bm25(spark, folder):
    index = bm25.build_mixed(_docs(spark, folder), "content", "chunk_seq")
    terms = _asked(spark, folder).select("qid", F.explode(tokens.mixed_tokens(F.col("query"))).alias("term"))
    return bm25.search(index, terms, 60)


def b04_bm25_topk(spark, folder):
    return _bm25(spark, folder).select("qid", "id", F.round("score", 6).alias("score"), "rank")


#: Fixed value: the instruction that the embedding model takes before a query.
QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："


def _printed(embedding):
    """A vector as thousandths in one string."""
    return F.array_join(F.transform(embedding, lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string")), " ").alias("embedding")


def v01_embed(spark, folder):
    return read_table(spark, folder, "chunks").select("chunk_seq", _printed(models.embed(F.col("content"))))


def v02_embed_query(spark, folder):
    return _asked(spark, folder).select("qid", _printed(models.embed(F.col("query"), prefix=QUERY_PREFIX)))


def v03_normalise(spark, folder):
    v = vector.normalise(F.transform("embedding", lambda x: x * 3))
    return read_table(spark, folder, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(v[0], 4).alias("first"))


def _vectors(spark, folder):
    return read_table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")


def _vector_queries(spark, folder):
    return _vectors(spark, folder).filter(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "embedding")


def _rounded(df):
    return df.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def v04_ip_topk(spark, folder):
    return _rounded(vector.top_k(_vectors(spark, folder), _vector_queries(spark, folder), 15))


def v05_filtered_topk(spark, folder):
    return _rounded(vector.top_k(_vectors(spark, folder), _vector_queries(spark, folder), 15, where=F.col("label") == 3))


def v05_in_filter_topk(spark, folder):
    return _rounded(vector.top_k(_vectors(spark, folder), _vector_queries(spark, folder), 15, where=F.col("label").isin(1, 4, 7)))


def v06_lookup(spark, folder):
    return _vectors(spark, folder).filter("id = 42").select("id", "label", F.size("embedding").alias("dim"))


def r04_vector_recall(spark, folder):
    """Vectors ranked below the queries' filters: every third query allows two labels as names,
    every fifth a category, some both, the others everything."""
    stored = _vectors(spark, folder).select("id", "embedding", F.concat(F.lit("n"), F.col("label")).alias("name"), F.concat(F.lit("分类"), F.col("label") % 3, F.lit("部")).alias("category"))
    asked = stored.filter(F.col("id") % EVERY == 0).withColumnRenamed("id", "qid")
    named, own = F.col("qid") % 3 == 0, F.substring("name", 2, 1).cast("int")
    parsed = asked.select("qid", F.when(named, F.array("name")).alias("name_filter"), F.when(F.col("qid") % 100 == 0, F.concat(F.lit("分类"), (own + 1) % 3)).alias("category"))
    allowed = asked.filter(named).select("qid", F.explode(F.array("name", F.concat(F.lit("n"), (own + 1) % 10))).alias("name"))
    return _rounded(retrieve.filtered_vector_recall(stored, asked.select("qid", "embedding"), parsed, allowed))


def _by_label(spark, folder):
    """A second ranking: the nearest ids of the same label."""
    v = _vectors(spark, folder).select("id", "label")
    near = v.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "label").join(v, "label")
    order = Window.partitionBy("qid").orderBy(F.abs(F.col("id") - F.col("qid")), "id")
    return near.withColumn("rank", F.row_number().over(order)).filter("rank <= 15").select("qid", "id", "rank")


def f01_rrf(spark, folder):
    near = vector.top_k(_vectors(spark, folder), _vector_queries(spark, folder), 15)
    fused = fusion.fuse({"vector": near, "label": _by_label(spark, folder)})
    return fused.select("qid", "id", F.round("rrf_score", 9).alias("rrf_score"), "rank", F.array_join("sources", ",").alias("sources"))


def q01_entities(spark, folder):
    asked = read_table(spark, folder, "query_results").select(F.col("result_id").alias("qid"), F.lower("query").alias("query")).distinct()
    return longest_names(contained_names(asked, _names(spark, folder), "qid", "query", "drug_name"), "qid")


def _queries(spark, folder):
    return read_table(spark, folder, "query_results").select("result_id", "query")


def q02_sections(spark, folder):
    return _queries(spark, folder).select("result_id", F.array_join(queryparse.sections(F.col("query")), ",").alias("sections"))


def q03_intent(spark, folder):
    return _queries(spark, folder).select("result_id", queryparse.intent(F.col("query")).alias("intent"))


def q04_keywords(spark, folder):
    none = F.array().cast("array<string>")
    return _queries(spark, folder).select("result_id", F.array_join(queryparse.keywords(F.col("query"), none), " ").alias("keywords"))


def q05_name_filter(spark, folder):
    return read_table(spark, folder, "query_results").select("result_id", F.array_join(queryparse.name_filter(F.col("retrieved_drugs")), ",").alias("allowed"))


def q06_listing(spark, folder):
    q = F.concat(F.col("query"), F.when(F.col("query_type") == "多轮对话", "哪些药材").otherwise(""))
    return read_table(spark, folder, "query_results").select("result_id", queryparse.is_listing(q, F.lit(False)).alias("listing"))


def q07_category(spark, folder):
    return _queries(spark, folder).select("result_id", queryparse.category(F.col("query")).alias("category"))


def q08_parse(spark, folder):
    asked = latest(read_table(spark, folder, "query_results").select("result_id", "query", "loaded_at"), "result_id").select(F.col("result_id").alias("qid"), "query")
    parsed = queryparse.parse(asked, _names(spark, folder), "drug_name")
    return parsed.select("qid", "query", F.array_join("names", ",").alias("names"), F.array_join("sections", ",").alias("sections"), "intent", "is_listing")


def r01_override(spark, folder):
    """The first retrieved name in place of the names of the question."""
    rows = latest(read_table(spark, folder, "query_results").select("result_id", "query", "retrieved_drugs", "loaded_at"), "result_id")
    parsed = queryparse.parse(rows.select(F.col("result_id").alias("qid"), "query"), _names(spark, folder), "drug_name")
    given = rows.select(F.col("result_id").alias("qid"), F.try_element_at("retrieved_drugs", F.lit(1)).alias("name"))
    return queryparse.override(parsed, given).select("qid", F.array_join("names", ",").alias("names"), "is_listing")


def r02_expand_filter(spark, folder):
    asked = read_table(spark, folder, "query_results").select("result_id", F.explode("retrieved_drugs").alias("asked")).distinct()
    return related_names(asked, _names(spark, folder), "result_id", "asked", "drug_name")


def r05_overfetch(spark, folder):
    """Lengths of the word lists: four times as long where the question has a name."""
    index = bm25.build_mixed(_docs(spark, folder), "content", "chunk_seq")
    parsed = queryparse.parse(_asked(spark, folder), _names(spark, folder), "drug_name")
    return retrieve.word_recall(index, parsed).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))


def r07_category_filter(spark, folder):
    """Word lists filtered above the limit by a category word."""
    parsed = _asked(spark, folder).select("qid", F.lit(None).cast("array<string>").alias("name_filter"), F.lit("成方制剂").alias("category"))
    none = parsed.select("qid", F.lit("").alias("name")).filter("false")
    return retrieve.post_filter(_bm25(spark, folder), parsed, _docs(spark, folder), none, "chunk_seq", "drug_name", "category").select("qid", "id", "rank")


def r06_postfilter(spark, folder):
    """BM25 lists filtered above the limit by the names of the question."""
    asked, names, docs = _asked(spark, folder), _names(spark, folder), _docs(spark, folder)
    parsed = queryparse.parse(asked, names, "drug_name").withColumn("category", F.lit(None).cast("string"))
    allowed = retrieve.allowed_names(parsed, names, "drug_name")
    return retrieve.post_filter(_bm25(spark, folder), parsed, docs, allowed, "chunk_seq", "drug_name", "category").select("qid", "id", "rank")


def r09_enrich(spark, folder):
    meta = _docs(spark, folder).select(F.col("chunk_seq").alias("id"), "drug_name", "section")
    return _bm25(spark, folder).filter("rank <= 5").select("qid", "id", "rank").join(meta, "id", "left")


def r10_rerank(spark, folder):
    meta = _docs(spark, folder).select(F.col("chunk_seq").alias("id"), "content")
    found = _bm25(spark, folder).filter("rank <= 15").join(meta, "id").join(_asked(spark, folder), "qid")
    return retrieve.rerank(found).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _items(spark, folder, most=None):
    """Chunks of each name in order; only the first ``most``, which Spark then picks before it shuffles."""
    docs = _docs(spark, folder).filter("drug_name IS NOT NULL AND content IS NOT NULL")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("drug_name").orderBy("chunk_seq")))
    ranked = ranked.filter(F.col("rank") <= most) if most else ranked
    return ranked.withColumn("item", retrieve.format_item(F.col("rank"), F.col("drug_name"), F.col("section"), F.col("category"), F.col("content")))


def r13_context_budget(spark, folder):
    return retrieve.assemble_context(_items(spark, folder, retrieve.TOTAL_CAP).select(F.col("drug_name").alias("qid"), "rank", "item")).select("qid", F.md5("context").alias("context"), "n_items")


def r14_format(spark, folder):
    return _items(spark, folder).select("chunk_seq", "item")


def r11_no_reranker(spark, folder):
    """The search without reranking: the fused order decides."""
    found = retrieve.hybrid_search(_asked(spark, folder), _docs(spark, folder), enable_reranker=False)
    return found.select("qid", "rank", "id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"), "name")


def r15_contexts(spark, folder):
    """The assembled context of every question."""
    found = retrieve.contexts(retrieve.hybrid_search(_asked(spark, folder), _docs(spark, folder)))
    return found.select("qid", F.md5("context").alias("context"), "n_items")


def r16_hybrid_search(spark, folder):
    """End to end over all chunks: names, filters, both recalls, fusion, rerank."""
    found = retrieve.hybrid_search(_asked(spark, folder), _docs(spark, folder))
    return found.select("qid", "rank", "id", F.round("score", 6).alias("score"), F.round("rrf_score", 9).alias("rrf_score"), F.array_join("sources", ",").alias("sources"), "name", "section", "category")


QUERIES = {f.__name__: f for f in (b01_tokens, b02_lexicon_tokens, b03_bm25_build, b04_bm25_topk, b05_count, v01_embed, v02_embed_query, v03_normalise, v04_ip_topk, v05_filtered_topk, v05_in_filter_topk, v06_lookup, r04_vector_recall, f01_rrf, q01_entities, q02_sections, q03_intent, q04_keywords, q05_name_filter, q06_listing, q07_category, q08_parse, r01_override, r02_expand_filter, r05_overfetch, r06_postfilter, r07_category_filter, r09_enrich, r10_rerank, r13_context_budget, r14_format, r11_no_reranker, r15_contexts, r16_hybrid_search)}


def _tokens(x: str) -> str:
    return f"(regexp_extract_all({x}, '[A-Za-z0-9]+') || flatten(list_transform(regexp_extract_all({x}, '[一-鿿]+'), lambda r: [substr(r, i, 2) for i in range(1, greatest(length(r), 2))])))"


_DOCS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_seq ORDER BY loaded_at DESC) = 1)"
_ASKED = f"(SELECT DISTINCT result_id AS qid, query FROM query_results WHERE result_id % {EVERY} = 0)"
_BM25 = f"""
t AS (SELECT chunk_seq AS id, {_tokens('content')} AS tok FROM {_DOCS} WHERE content IS NOT NULL UNION ALL SELECT chunk_seq, [] FROM {_DOCS} WHERE content IS NULL),
st AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM t),
po AS (SELECT id, term, len_tok AS dl, count(*) AS tf FROM (SELECT id, len(tok) AS len_tok, unnest(tok) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po, st GROUP BY term),
di AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM df) ELSE raw END AS idf FROM df),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_tokens('query')}) AS term FROM @asked) GROUP BY ALL),
sc AS (SELECT qid, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN di USING (term) JOIN po USING (term), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= 60 AND score > 0)"""
_BM25_CTES = _BM25.replace("@asked", _ASKED)
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def _top(where: str) -> str:
    return f"SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0 AND {where})) WHERE rank <= 15"


def _names_sql() -> str:
    return "(SELECT DISTINCT drug_name AS name FROM drug_entries WHERE drug_name <> '')"


_FOUND = f"SELECT DISTINCT result_id AS qid, name FROM query_results, {_names_sql()} WHERE contains(lower(query), name)"
_LONGEST = f"SELECT * FROM ({_FOUND}) AS f WHERE NOT EXISTS (SELECT 1 FROM ({_FOUND}) AS g WHERE g.qid = f.qid AND length(g.name) > length(f.name) AND contains(g.name, f.name))"
_SECTIONS_Q = f"array_to_string(list_sort(list_distinct(list_transform(list_filter({[{'w': w, 's': s} for w, s in queryparse.SYNONYMS.items()]}, lambda p: contains(query, p.w)), lambda p: p.s))), ',')"
_INTENT = "CASE " + " ".join(f"WHEN {any_sql('query', w)} THEN {quoted(n)}" for n, w in queryparse.INTENTS) + f" ELSE {quoted(queryparse.OTHER_INTENT)} END"
_CATEGORY = "CASE " + " ".join(f"WHEN {any_sql('query', w)} THEN {quoted(n)}" for n, w in queryparse.CATEGORIES) + " END"


def _listing(x: str) -> str:
    return f"({any_sql(x, queryparse.LISTING)} OR regexp_matches({x}, '{queryparse.LISTING_PROPERTY}') OR (regexp_matches({x}, '{queryparse.LISTING_USE}') AND regexp_matches({x}, '{queryparse.LISTING_KIND}')))"


_ONE = "(SELECT * FROM query_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1)"
_ITEM = "'【检索结果 ' || rank || '】' || CASE WHEN coalesce(drug_name, '') <> '' THEN ' | 药品：' || drug_name ELSE '' END || CASE WHEN coalesce(section, '') <> '' THEN ' | 章节：' || section ELSE '' END || CASE WHEN coalesce(category, '') <> '' AND coalesce(category, '') <> coalesce(drug_name, '') THEN ' | 分类：' || category ELSE '' END || chr(10) || replace({c}, chr(10) || chr(10), chr(10))"
_ITEMS = f"SELECT chunk_seq, drug_name, rank, {_ITEM.replace('{c}', strip_sql('content'))} AS item FROM (SELECT *, row_number() OVER (PARTITION BY drug_name ORDER BY chunk_seq) AS rank FROM {_DOCS} WHERE drug_name IS NOT NULL AND content IS NOT NULL)"
_ALLOWED = f"SELECT DISTINCT f.qid, n.name FROM ({_LONGEST}) AS f, {_names_sql()} AS n WHERE f.name <> '' AND (contains(n.name, f.name) OR contains(f.name, n.name))"

def _embedded(source: str) -> str:
    """``id, slot, x``: the slots other than 0 of the stand-in embedding of ``id, text`` rows."""
    return f"""SELECT id, slot, (v::FLOAT / sqrt(sum(v * v) OVER (PARTITION BY id))::FLOAT)::FLOAT AS x FROM (
SELECT id, ((m // 1048576) % 64)::INT AS slot, sum((m // 9223372036854775808) * 2 - 1)::BIGINT AS v FROM (
SELECT id, ((unicode(substr(t, i, 1))::HUGEINT * 1000003 + unicode(substr(t, i + 1, 1))) * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT AS m FROM (
SELECT id, t, unnest(range(1, length(t)))::INT AS i FROM (SELECT id, CASE WHEN length(coalesce(text, '')) < 2 THEN rpad(coalesce(text, ''), 2, ' ') ELSE text END AS t FROM ({source})))) GROUP BY id, slot)"""


def _printed_sql(source: str, key: str) -> str:
    return f"""WITH e AS ({_embedded(source)}), a AS (SELECT id, s::INT AS slot FROM (SELECT DISTINCT id FROM e), range(64) AS r(s))
SELECT {key}, string_agg(round(coalesce(x, 0)::DOUBLE * 1000)::BIGINT::VARCHAR, ' ' ORDER BY slot) AS embedding FROM a LEFT JOIN e USING (id, slot) GROUP BY id"""


_OVERLAP = "len(list_filter(list_distinct(string_split(query, '')), lambda c: contains(substr(content, 1, 1024), c)))::DOUBLE / len(list_distinct(string_split(query, '')))"
_CHUNK_NAMES = f"(SELECT DISTINCT drug_name AS name FROM {_DOCS} WHERE drug_name <> '')"
HYBRID_CTES = f"""{_BM25},
q AS (SELECT * FROM @asked), nm AS {_CHUNK_NAMES}, fo AS (SELECT qid, name FROM q, nm WHERE contains(lower(query), name)),
lo AS (SELECT * FROM fo WHERE NOT EXISTS (SELECT 1 FROM fo AS g WHERE g.qid = fo.qid AND length(g.name) > length(fo.name) AND contains(g.name, fo.name))),
al AS (SELECT DISTINCT lo.qid, nm.name FROM lo, nm WHERE contains(nm.name, lo.name) OR contains(lo.name, nm.name)),
pa AS (SELECT qid, query, qid IN (SELECT qid FROM lo) AS named, CASE WHEN qid NOT IN (SELECT qid FROM lo) AND {_listing('query')} THEN {_CATEGORY} END AS wanted FROM q),
d AS {_DOCS},
ok AS (SELECT pa.qid, d.chunk_seq AS id FROM pa, d WHERE (NOT named OR EXISTS (SELECT 1 FROM al WHERE al.qid = pa.qid AND al.name = d.drug_name)) AND (wanted IS NULL OR contains(coalesce(category, ''), wanted))),
wo AS (SELECT bm.qid, bm.id, row_number() OVER (PARTITION BY bm.qid ORDER BY bm.rank, bm.id) AS rank FROM bm JOIN pa USING (qid) JOIN ok USING (qid, id) WHERE bm.rank <= CASE WHEN named THEN 60 ELSE 15 END),
de AS ({_embedded('SELECT chunk_seq AS id, content AS text FROM d')}), qe AS ({_embedded('SELECT qid AS id, query AS text FROM q')}),
dt AS (SELECT qe.id AS qid, de.id, sum(qe.x::DOUBLE * de.x::DOUBLE) AS score FROM qe JOIN de USING (slot) GROUP BY ALL),
ve AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(score, 0), 9) DESC, id) AS rank FROM ok LEFT JOIN dt USING (qid, id) QUALIFY rank <= 15),
u AS (SELECT qid, id, rank, 0 AS no, 'vector' AS source FROM ve UNION ALL SELECT qid, id, rank, 1, 'bm25' FROM wo),
g AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, min(no * 1000 + rank) AS seen, string_agg(source, ',' ORDER BY no) AS sources FROM u GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf_score, 12) DESC, seen, id) AS before FROM g QUALIFY before <= 30),
r AS (SELECT f.*, query, drug_name AS name, section, category, content, {_OVERLAP.replace('content', "coalesce(content, '')")} AS score FROM f JOIN d ON d.chunk_seq = f.id JOIN q ON q.qid = f.qid),
found AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before, id) AS rank, id, round(score, 6) AS score, round(rrf_score, 9) AS rrf_score, sources, name, section, category, content FROM r QUALIFY rank <= 5)"""
_HYBRID = f"WITH {HYBRID_CTES.replace('@asked', _ASKED)} SELECT * EXCLUDE (content) FROM found"
_RECALL = f"""WITH v AS (SELECT vec_id AS id, embedding, label, 'n' || label AS name, '分类' || (label % 3) || '部' AS category FROM embeddings),
s AS (SELECT a.id AS qid, b.id, {_DOT} AS score FROM v AS a, v AS b WHERE a.id % {EVERY} = 0 AND (a.id % 3 <> 0 OR b.label IN (a.label, (a.label + 1) % 10)) AND (a.id % 100 <> 0 OR contains(b.category, '分类' || ((a.label + 1) % 3))))
SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 15"""
_WORDS = "(SELECT DISTINCT drug_name AS w FROM drug_entries WHERE length(drug_name) >= 2)"
_LEXICON = f"""WITH RECURSIVE t AS (SELECT DISTINCT response_id AS id, coalesce(query, '') AS text FROM gen_responses),
w AS (SELECT id, text, p::INT AS p, max(length(w)) AS n FROM t, range(1, 2000) AS r(p), {_WORDS} WHERE p <= length(text) AND contains(text, w) AND substr(text, p, length(w)) = w GROUP BY ALL),
c AS (SELECT id, text, 1 AS p, []::VARCHAR[] AS tokens FROM t
UNION ALL SELECT id, text, p + k, CASE WHEN latin OR k > 1 OR regexp_matches(substr(text, p, 1), '[一-鿿]') THEN list_append(tokens, substr(text, p, k)) ELSE tokens END FROM (
SELECT c.id, c.text, c.p, tokens, regexp_matches(substr(c.text, c.p, 1), '[A-Za-z0-9]') AS latin, CASE WHEN regexp_matches(substr(c.text, c.p, 1), '[A-Za-z0-9]') THEN length(regexp_extract(substr(c.text, c.p), '^[A-Za-z0-9]+')) ELSE coalesce(n, 1) END::INT AS k FROM c LEFT JOIN w ON w.id = c.id AND w.p = c.p WHERE c.p <= length(c.text)))
SELECT id AS response_id, array_to_string(tokens, ' ') AS tokens FROM c WHERE p > length(text)"""

SQL = {
    "b02_lexicon_tokens": _LEXICON,
    "v01_embed": f"SELECT chunk_seq, embedding FROM (SELECT chunk_seq, row_number() OVER (ORDER BY chunk_seq, loaded_at, content) AS id FROM chunks) JOIN ({_printed_sql('SELECT row_number() OVER (ORDER BY chunk_seq, loaded_at, content) AS id, content AS text FROM chunks', 'id')}) USING (id)",
    "v02_embed_query": _printed_sql(f"SELECT qid AS id, {quoted(QUERY_PREFIX)} || query AS text FROM {_ASKED}", "id AS qid"),
    "r04_vector_recall": _RECALL,
    "r10_rerank": f"WITH {_BM25_CTES}, r AS (SELECT bm.qid, bm.id, bm.rank AS before, {_OVERLAP.replace('content', chr(99) + 'oalesce(d.content, ' + chr(39) * 2 + ')')} AS score FROM bm JOIN {_DOCS} AS d ON d.chunk_seq = bm.id JOIN {_ASKED} AS q ON q.qid = bm.qid WHERE rank <= 15) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before, id) AS rank, round(score, 6) AS score FROM r QUALIFY rank <= 5",
    "r16_hybrid_search": _HYBRID,
    "b05_count": f"WITH {_BM25_CTES} SELECT (SELECT n FROM st) AS n_docs, (SELECT count(*) FROM di) AS n_terms, (SELECT count(*) FROM po) AS n_postings",
    "r11_no_reranker": f"WITH {HYBRID_CTES.replace('@asked', _ASKED)} SELECT qid, before AS rank, id, round(rrf_score, 9) AS score, sources, name FROM r WHERE before <= 5",
    "r15_contexts": f"""WITH {HYBRID_CTES.replace('@asked', _ASKED)}, i AS (SELECT qid, rank, substr({_ITEM.replace('{c}', strip_sql("coalesce(content, '')")).replace('drug_name', 'name')}, 1, 800) AS item FROM found), b4 AS (SELECT *, coalesce(sum(length(item)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
o AS (SELECT *, before + length(item) > 4000 AS over, sum((before + length(item) > 4000)::INT) OVER (PARTITION BY qid ORDER BY rank) AS overs FROM b4 WHERE before <= 4000)
SELECT qid, md5(string_agg(CASE WHEN over THEN substr(item, 1, (4000 - before)::INT) ELSE item END, chr(10) || '---' || chr(10) ORDER BY rank)) AS context, count(*) AS n_items FROM o WHERE overs = 0 OR (over AND overs = 1 AND 4000 - before > 50) GROUP BY qid""",
    "b01_tokens": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string({_tokens('text')}, ' ') END AS tokens FROM documents",
    "b03_bm25_build": f"WITH {_BM25_CTES} SELECT term, df, round(idf, 6) AS idf FROM di",
    "b04_bm25_topk": f"WITH {_BM25_CTES} SELECT qid, id, round(score, 6) AS score, rank FROM bm",
    "v03_normalise": "SELECT vec_id, round(CASE WHEN n > 0 THEN n / n ELSE 0 END, 6)::DOUBLE AS norm, round((embedding[1] * 3)::DOUBLE / sqrt(n), 4) AS first FROM (SELECT *, list_sum(list_transform(embedding, lambda x: (x * 3)::DOUBLE * (x * 3)::DOUBLE)) AS n FROM embeddings)",
    "v04_ip_topk": f"SELECT qid, id, round(score, 6) AS score, rank FROM ({_top('true')})",
    "v05_filtered_topk": f"SELECT qid, id, round(score, 6) AS score, rank FROM ({_top('b.label = 3')})",
    "v05_in_filter_topk": f"SELECT qid, id, round(score, 6) AS score, rank FROM ({_top('b.label IN (1, 4, 7)')})",
    "v06_lookup": "SELECT vec_id AS id, label, len(embedding)::INT AS dim FROM embeddings WHERE vec_id = 42",
    "f01_rrf": f"""WITH v AS ({_top('true')}), l AS (SELECT qid, id, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(b.vec_id - a.vec_id), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % {EVERY} = 0) WHERE rank <= 15),
u AS (SELECT qid, id, rank, 0 AS no, 'vector' AS source FROM v UNION ALL SELECT qid, id, rank, 1, 'label' FROM l),
g AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(no * 1000 + rank) AS seen, string_agg(source, ',' ORDER BY no) AS sources FROM u GROUP BY ALL)
SELECT qid, id, round(s, 9) AS rrf_score, rank, sources FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, seen, id) AS rank FROM g) WHERE rank <= 30""",
    "q01_entities": f"SELECT * FROM ({_LONGEST})",
    "q02_sections": f"SELECT result_id, {_SECTIONS_Q} AS sections FROM query_results",
    "q03_intent": f"SELECT result_id, {_INTENT} AS intent FROM query_results",
    "q04_keywords": f"SELECT result_id, array_to_string(list_filter({_tokens('query')}, lambda t: length(t) >= 2 AND NOT list_contains({list_sql(queryparse.STOP)}, t)), ' ') AS keywords FROM query_results",
    "q05_name_filter": "SELECT result_id, CASE WHEN len(retrieved_drugs) > 0 THEN array_to_string(retrieved_drugs, ',') END AS allowed FROM query_results",
    "q06_listing": "SELECT result_id, " + _listing("(query || CASE WHEN query_type = '多轮对话' THEN '哪些药材' ELSE '' END)") + " AS listing FROM query_results",
    "q07_category": f"SELECT result_id, {_CATEGORY} AS category FROM query_results",
    "q08_parse": f"SELECT q.result_id AS qid, query, coalesce((SELECT string_agg(name, ',' ORDER BY length(name) DESC, name) FROM ({_LONGEST}) AS f WHERE f.qid = q.result_id), '') AS names, {_SECTIONS_Q} AS sections, {_INTENT} AS intent, NOT EXISTS (SELECT 1 FROM ({_LONGEST}) AS f WHERE f.qid = q.result_id) AND {_listing('query')} AS is_listing FROM {_ONE} AS q",
    "r02_expand_filter": "SELECT DISTINCT a.result_id, n.name FROM (SELECT DISTINCT result_id, unnest(retrieved_drugs) AS asked FROM query_results) AS a, (SELECT DISTINCT drug_name AS name FROM drug_entries WHERE drug_name <> '') AS n WHERE asked <> '' AND (contains(n.name, asked) OR contains(asked, n.name))",
    "r06_postfilter": f"""WITH {_BM25_CTES}, al AS ({_ALLOWED}), fl AS (SELECT DISTINCT qid FROM ({_LONGEST})),
k AS (SELECT bm.qid, bm.id, bm.rank FROM bm JOIN {_DOCS} AS d ON d.chunk_seq = bm.id WHERE bm.qid NOT IN (SELECT qid FROM fl) OR EXISTS (SELECT 1 FROM al WHERE al.qid = bm.qid AND al.name = d.drug_name))
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS rank FROM k""",
    "r01_override": f"SELECT q.result_id AS qid, coalesce(nullif(q.retrieved_drugs[1], ''), (SELECT string_agg(name, ',' ORDER BY length(name) DESC, name) FROM ({_LONGEST}) AS f WHERE f.qid = q.result_id), '') AS names, NOT EXISTS (SELECT 1 FROM ({_LONGEST}) AS f WHERE f.qid = q.result_id) AND {_listing('query')} AS is_listing FROM {_ONE} AS q",
    "r05_overfetch": f"WITH {_BM25_CTES}, fl AS (SELECT DISTINCT qid FROM ({_LONGEST})) SELECT qid, count(*) AS n, max(rank)::INT AS last FROM bm WHERE rank <= CASE WHEN qid IN (SELECT qid FROM fl) THEN 60 ELSE 15 END GROUP BY qid",
    "r07_category_filter": f"WITH {_BM25_CTES} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS rank FROM bm JOIN {_DOCS} AS d ON d.chunk_seq = bm.id WHERE contains(coalesce(category, ''), '成方制剂')",
    "r09_enrich": f"WITH {_BM25_CTES} SELECT bm.id, qid, rank, drug_name, section FROM bm LEFT JOIN {_DOCS} AS d ON d.chunk_seq = bm.id WHERE rank <= 5",
    "r13_context_budget": f"""WITH i AS (SELECT drug_name AS qid, rank, substr(item, 1, 800) AS item FROM ({_ITEMS})), b AS (SELECT *, coalesce(sum(length(item)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
o AS (SELECT *, before + length(item) > 4000 AS over, sum((before + length(item) > 4000)::INT) OVER (PARTITION BY qid ORDER BY rank) AS overs FROM b WHERE before <= 4000)
SELECT qid, md5(string_agg(CASE WHEN over THEN substr(item, 1, (4000 - before)::INT) ELSE item END, chr(10) || '---' || chr(10) ORDER BY rank)) AS context, count(*) AS n_items FROM o WHERE overs = 0 OR (over AND overs = 1 AND 4000 - before > 50) GROUP BY qid""",
    "r14_format": f"SELECT chunk_seq, item FROM ({_ITEMS})",
}
