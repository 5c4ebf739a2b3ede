"""Chunking, over entries, sections and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.operators import chunk as k
from vellumflow.session import read_table

from .common import SECTIONS_SQL, SPACE, sections_of, strip_sql

HEADING = "^(?:取|照)"


def _entries(spark, folder):
    return read_table(spark, folder, "drug_entries")


def k01_router(spark, folder):
    return _entries(spark, folder).select("entry_id", k.entry_length(F.col("intro_text"), F.col("sections")).alias("length"), k.is_whole(F.col("intro_text"), F.col("sections")).alias("whole"))


def k02_whole_entry(spark, folder):
    return _entries(spark, folder).select("entry_id", k.whole_entry(F.col("intro_text"), F.col("sections")).alias("content"))


def k03_summary(spark, folder):
    return _entries(spark, folder).select("entry_id", k.summary(*[F.col(c) for c in ("drug_name", "pinyin_name", "latin_name", "category_hint", "intro_text", "parent_drug")]).alias("content"))


def k04_section_router(spark, folder):
    return sections_of(spark, folder).select("section_id", k.route(F.col("section_name"), F.col("content"), F.col("table_markdown")).alias("way"))


def k05_greedy_pack(spark, folder):
    parts = F.filter(F.split("text", "\n", -1), lambda p: p != "")
    return read_table(spark, folder, "documents").select("doc_id", F.posexplode(k.greedy_pack(parts)).alias("pos", "content"))


def k06_detailed_passthrough(spark, folder):
    chunks = k.detailed_chunks(F.coalesce("section_name", F.lit("")), F.col("content"), F.col("table_markdown"))
    rows = sections_of(spark, folder).select("section_id", chunks.alias("c"))
    return rows.filter("size(c) = 1 AND c[0].chunk_type = 'detailed'").select("section_id", F.col("c")[0]["content"].alias("content"))


def k07_component_split(spark, folder):
    return sections_of(spark, folder).filter("content IS NOT NULL").select("section_id", F.posexplode(k.split_components(F.col("content"), HEADING)).alias("pos", "piece"))


def k08_item_split(spark, folder):
    return sections_of(spark, folder).filter("content IS NOT NULL").select("section_id", F.posexplode(k.split_items(F.col("content"))).alias("pos", "piece"))


def k09_sentences(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", F.posexplode(k.sentences(F.col("text"))).alias("pos", "sentence"))


def k10_sliding_window(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", F.posexplode(k.sliding_windows(k.sentences(F.col("text")))).alias("pos", "content"))


def k11_fixed_slices(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", F.posexplode(k.fixed_slices(F.col("text"))).alias("pos", "slice"))


def k12_sequential_ids(spark, folder):
    rows = k09_sentences(spark, folder).select("doc_id", "pos")
    return k.sequential_ids(rows, "doc_id", "pos", 100).select("doc_id", "pos", "chunk_id")


def k12_chunk_entries(spark, folder):
    """The whole chunker with global ids."""
    rows = k.sequential_ids(k.chunk_entries(_entries(spark, folder).dropDuplicates(["entry_id"])))
    return rows.select("chunk_seq", "chunk_id", "entry_id", "section", "chunk_type", "content", "char_count")


def k13_chunk_stats(spark, folder):
    return k.statistics(read_table(spark, folder, "chunks").filter("char_count IS NOT NULL"))


QUERIES = {f.__name__: f for f in (k01_router, k02_whole_entry, k03_summary, k04_section_router, k05_greedy_pack, k06_detailed_passthrough, k07_component_split, k08_item_split, k09_sentences, k10_sliding_window, k11_fixed_slices, k12_sequential_ids, k12_chunk_entries, k13_chunk_stats)}

_LEN = "(length(coalesce(intro_text, '')) + coalesce(list_sum(list_transform(sections, lambda s: length(coalesce(s.content, '')))), 0))"
_PARTS = f"flatten(list_transform(sections, lambda s: list_filter([CASE WHEN {strip_sql(chr(99) + 'oalesce(s.content, ' + chr(39) * 2 + ')')} <> '' THEN '【' || coalesce(s.section_name, '') || '】' || {strip_sql('coalesce(s.content, ' + chr(39) * 2 + ')')} END, CASE WHEN coalesce(s.table_markdown, '') <> '' THEN '【' || coalesce(s.section_name, '') || '-表格】' || chr(10) || s.table_markdown END], lambda x: x IS NOT NULL)))"
_INTRO = strip_sql("coalesce(intro_text, '')")
_SENTENCES = f"list_filter(regexp_extract_all(text, '[^。；！？\\n]*[。；！？\\n]|[^。；！？\\n]+'), lambda s: {strip_sql('s')} <> '')"


def _fold(items: str, keep: str, limit: int = 1500) -> str:
    """A fold over strings that closes its open text when the next does not fit."""
    zero = "{'d': []::VARCHAR[], 'o': ''}"
    return f"list_reduce([{zero}] || list_transform({items}, lambda x: {{'d': []::VARCHAR[], 'o': x}}), lambda a, x: CASE WHEN length(a.o) + length(x.o) > {limit} AND a.o <> '' THEN {{'d': list_append(a.d, a.o), 'o': {keep} || x.o}} ELSE {{'d': a.d, 'o': a.o || x.o}} END)"


_PACK_ZERO = "{'d': []::VARCHAR[], 'o': []::VARCHAR[], 'n': 0::BIGINT}"
_PACK = f"list_reduce([{_PACK_ZERO}] || list_transform(list_filter(string_split(text, chr(10)), lambda p: p <> ''), lambda x: {{'d': []::VARCHAR[], 'o': [x], 'n': length(x)}}), lambda a, x: CASE WHEN a.n + x.n > 1500 AND len(a.o) > 0 THEN {{'d': list_append(a.d, array_to_string(a.o, chr(10))), 'o': x.o, 'n': x.n}} ELSE {{'d': a.d, 'o': a.o || x.o, 'n': a.n + x.n}} END)"
_NAME, _C, _TAB = "coalesce(section_name, '')", "coalesce(content, '')", "coalesce(table_markdown, '')"
_ROUTE = f"CASE WHEN {_C} = '' AND {_TAB} = '' THEN 'skip' WHEN {_NAME} IN {tuple(k.CLINICAL)} AND length({_C}) < 300 THEN 'clinical' WHEN {_NAME} IN {tuple(k.DETAILED)} THEN CASE WHEN length({_C}) + length({_TAB}) < 50 AND {_NAME} NOT IN {tuple(k.UNMERGED)} THEN 'clinical' ELSE 'detailed' END WHEN {_NAME} NOT IN {tuple(k.CLINICAL)} THEN 'detailed' ELSE 'clinical' END"
_STRIPPED = strip_sql("coalesce(content, '')")
_FULL = f"CASE WHEN {_TAB} = '' THEN {_STRIPPED} WHEN {_STRIPPED} = '' THEN {_TAB} ELSE {_STRIPPED} || chr(10) || chr(10) || {_TAB} END"
_MARK = "string_split(regexp_replace(content, '(?m)^(取|照)', chr(1) || '\\1', 'g'), chr(1))"
_ITEM = "|".join(k.ITEMS)
_LINES = f"(SELECT section_id, loaded_at, entry_id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS line FROM (SELECT *, string_split(content, chr(10)) AS l FROM ({SECTIONS_SQL}) WHERE content IS NOT NULL))"


def _spread(source: str, key: str, lst: str, value: str) -> str:
    return f"SELECT {key}, (i - 1)::INT AS pos, v AS {value} FROM (SELECT {key}, unnest(generate_series(1, len(x))) AS i, unnest(x) AS v FROM (SELECT {key}, {lst} AS x FROM {source}))"


_TEXT = strip_sql("coalesce(content, '')")
_COMPONENT = k.COMPONENT.removeprefix("^").replace("\\s", SPACE)
_HEADS = f"string_split(regexp_replace(t, '(?m)^({_COMPONENT})', chr(1) || '\\1', 'g'), chr(1))"
_PARTED = f"CASE WHEN len(p) >= 3 THEN CASE WHEN {strip_sql('p[1]')} <> '' THEN [{strip_sql('p[1]')} || chr(10) || {strip_sql('p[2]')}] || list_transform(p[3:], lambda x: {strip_sql('x')}) ELSE list_transform(p[2:], lambda x: {strip_sql('x')}) END ELSE [t] END"
_ITEMISED = f"""SELECT entry_id, nth, list(piece ORDER BY no) FILTER (length({strip_sql('piece')}) > {k.LEAST_ITEM}) AS kept, count(*) AS n FROM (
SELECT entry_id, nth, no, string_agg(line, chr(10) ORDER BY i) AS piece FROM (
SELECT *, sum(CASE WHEN i > 1 AND regexp_matches({strip_sql('line')}, '^(?:{_ITEM})') THEN 1 ELSE 0 END) OVER (PARTITION BY entry_id, nth ORDER BY i) AS no FROM (
SELECT entry_id, nth, unnest(generate_series(1, len(l))) AS i, unnest(l) AS line FROM (SELECT entry_id, nth, string_split(t, chr(10)) AS l FROM de WHERE name = '检查' AND length(full_text) > 1500))) GROUP BY ALL) GROUP BY ALL"""
_OF_T = _SENTENCES.replace("regexp_extract_all(text,", "regexp_extract_all(t,")
_SECTION_ROWS = f"""SELECT entry_id, i - 1 AS nth, coalesce(x.section_name, '') AS name, x.content AS content, x.table_markdown AS tab0, {_ROUTE.replace("coalesce(section_name, '')", "coalesce(x.section_name, '')").replace("coalesce(content, '')", "coalesce(x.content, '')").replace("coalesce(table_markdown, '')", "coalesce(x.table_markdown, '')")} AS way FROM (SELECT entry_id, unnest(generate_series(1, len(sections))) AS i, unnest(sections) AS x FROM e WHERE NOT whole)"""
_CHUNKS = f"""WITH e AS (SELECT *, {_LEN} <= 1500 AND coalesce(len(sections), 0) <= 8 AS whole FROM drug_entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at) = 1),
s AS ({_SECTION_ROWS}),
de AS (SELECT entry_id, nth, name, {_TEXT} AS t, coalesce(tab0, '') AS tab, CASE WHEN coalesce(tab0, '') = '' THEN {_TEXT} WHEN {_TEXT} = '' THEN tab0 ELSE {_TEXT} || chr(10) || chr(10) || tab0 END AS full_text FROM s WHERE way = 'detailed'),
it AS ({_ITEMISED}),
dw AS (SELECT de.*, CASE WHEN length(full_text) <= 1500 THEN 'detailed' WHEN name = '含量测定' AND len({_PARTED.replace('len(p)', f'len({_HEADS})').replace('p[', f'{_HEADS}[')}) >= 2 THEN 'assay_component' WHEN name = '检查' AND n >= 2 AND len(kept) >= 2 THEN 'check_item' ELSE 'window' END AS kind,
CASE WHEN length(full_text) <= 1500 THEN [full_text] WHEN name = '含量测定' AND len({_PARTED.replace('len(p)', f'len({_HEADS})').replace('p[', f'{_HEADS}[')}) >= 2 THEN {_PARTED.replace('len(p)', f'len({_HEADS})').replace('p[', f'{_HEADS}[')} WHEN name = '检查' AND n >= 2 AND len(kept) >= 2 THEN kept
WHEN len({_OF_T}) <= 1 THEN [substr(t, i + 1, 1500) for i in range(0, length(t), 1500)] ELSE list_transform([{_fold(_OF_T, 'right(a.o, 100)')}], lambda r: CASE WHEN r.o = '' THEN r.d ELSE list_append(r.d, r.o) END)[1] END AS pieces, len({_OF_T}) <= 1 AS sliced FROM de LEFT JOIN it USING (entry_id, nth)),
cl AS (SELECT entry_id, list('【' || name || '】' || {_TEXT} ORDER BY nth) AS items FROM s WHERE way = 'clinical' AND {_TEXT} <> '' GROUP BY entry_id),
cp AS (SELECT entry_id, list_transform([{_PACK.replace("list_filter(string_split(text, chr(10)), lambda p: p <> '')", "items")}], lambda r: CASE WHEN len(r.o) > 0 THEN list_append(r.d, array_to_string(r.o, chr(10))) ELSE r.d END)[1] AS packed FROM cl),
a AS (SELECT entry_id, 0 AS part, 0 AS nth, 0 AS piece, '完整条目' AS section, 'whole_entry' AS chunk_type, (@whole) AS content FROM e WHERE whole
UNION ALL SELECT entry_id, 0, 0, 0, '药品概要', 'summary', content FROM (@summary) WHERE content IS NOT NULL AND entry_id IN (SELECT entry_id FROM e WHERE NOT whole)
UNION ALL SELECT entry_id, 1, nth, unnest(generate_series(1, len(pieces))), CASE WHEN kind = 'window' AND sliced THEN name || '-段' || unnest(generate_series(1, len(pieces))) ELSE name END, kind, unnest(pieces) FROM dw
UNION ALL SELECT entry_id, 2, 0, unnest(generate_series(1, len(packed))), '临床应用', 'clinical', unnest(packed) FROM cp),
b AS (SELECT * EXCLUDE (content), {strip_sql('content')} AS content FROM a)
SELECT chunk_seq, 'chunk_' || lpad(chunk_seq::VARCHAR, 6, '0') AS chunk_id, entry_id, section, chunk_type, content, length(content)::INT AS char_count FROM (SELECT *, row_number() OVER (ORDER BY entry_id, part, nth, piece) - 1 AS chunk_seq FROM b WHERE content <> '')"""

SQL = {
    "k01_router": f"SELECT entry_id, {_LEN}::INT AS length, {_LEN} <= 1500 AND coalesce(len(sections), 0) <= 8 AS whole FROM drug_entries",
    "k02_whole_entry": f"SELECT entry_id, array_to_string(CASE WHEN {_INTRO} <> '' THEN [{_INTRO}] ELSE []::VARCHAR[] END || {_PARTS}, chr(10)) AS content FROM drug_entries",
    "k03_summary": f"SELECT entry_id, CASE WHEN length(t) > 10 THEN t END AS content FROM (SELECT entry_id, concat_ws(chr(10), CASE WHEN coalesce(parent_drug, '') <> '' THEN '药品名称：' || coalesce(drug_name, '') || '（' || parent_drug || '的子剂型）' ELSE '药品名称：' || coalesce(drug_name, '') END, CASE WHEN coalesce(pinyin_name, '') <> '' THEN '拼音：' || pinyin_name END, CASE WHEN coalesce(latin_name, '') <> '' THEN '拉丁名：' || latin_name END, CASE WHEN coalesce(category_hint, '') <> '' THEN '分类：' || category_hint END, CASE WHEN {_INTRO} <> '' THEN '概述：' || {_INTRO} END) AS t FROM drug_entries)",
    "k04_section_router": f"SELECT section_id, {_ROUTE} AS way FROM ({SECTIONS_SQL})",
    "k05_greedy_pack": _spread("documents WHERE text IS NOT NULL", "doc_id", f"list_transform([{_PACK}], lambda r: CASE WHEN len(r.o) > 0 THEN list_append(r.d, array_to_string(r.o, chr(10))) ELSE r.d END)[1]", "content"),
    "k06_detailed_passthrough": f"SELECT section_id, {_FULL} AS content FROM ({SECTIONS_SQL}) WHERE length({_FULL}) <= 1500",
    "k07_component_split": _spread(f"({SECTIONS_SQL}) WHERE content IS NOT NULL", "section_id", f"CASE WHEN len({_MARK}) >= 3 THEN CASE WHEN {strip_sql(_MARK + '[1]')} <> '' THEN [{strip_sql(_MARK + '[1]')} || chr(10) || {strip_sql(_MARK + '[2]')}] || list_transform({_MARK}[3:], lambda p: {strip_sql('p')}) ELSE list_transform({_MARK}[2:], lambda p: {strip_sql('p')}) END ELSE [content] END", "piece"),
    "k08_item_split": f"""WITH l AS {_LINES}, g AS (SELECT *, sum(CASE WHEN i > 1 AND regexp_matches({strip_sql('line')}, '^(?:{_ITEM})') THEN 1 ELSE 0 END) OVER (PARTITION BY section_id, loaded_at ORDER BY i) AS no FROM l),
p AS (SELECT section_id, loaded_at, no, string_agg(line, chr(10) ORDER BY i) AS piece FROM g GROUP BY ALL),
c AS (SELECT *, count(*) OVER (PARTITION BY section_id, loaded_at) AS n, count(*) FILTER (length({strip_sql('piece')}) > 20) OVER (PARTITION BY section_id, loaded_at) AS kept FROM p)
SELECT section_id, (row_number() OVER (PARTITION BY section_id, loaded_at ORDER BY no) - 1)::INT AS pos, piece FROM c WHERE n >= 2 AND kept >= 2 AND length({strip_sql('piece')}) > 20
UNION ALL SELECT section_id, 0, content FROM ({SECTIONS_SQL}) AS s WHERE content IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.section_id = s.section_id AND c.loaded_at = s.loaded_at AND n >= 2 AND kept >= 2)""",
    "k09_sentences": _spread("documents WHERE text IS NOT NULL", "doc_id", _SENTENCES, "sentence"),
    "k10_sliding_window": _spread("documents WHERE text IS NOT NULL", "doc_id", f"list_transform([{_fold(_SENTENCES, 'right(a.o, 100)')}], lambda r: CASE WHEN r.o = '' THEN r.d ELSE list_append(r.d, r.o) END)[1]", "content"),
    "k11_fixed_slices": _spread("documents WHERE text <> ''", "doc_id", "[substr(text, i + 1, 1500) for i in range(0, length(text), 1500)]", "slice"),
    "k12_sequential_ids": f"SELECT doc_id, pos, 'chunk_' || lpad((row_number() OVER (ORDER BY doc_id, pos) - 1)::VARCHAR, 6, '0') AS chunk_id FROM ({_spread('documents WHERE text IS NOT NULL', 'doc_id', _SENTENCES, 's')})",
    "k13_chunk_stats": "SELECT chunk_type, count(*) AS n, min(char_count) AS shortest, max(char_count) AS longest, round(avg(char_count), 6) AS mean, quantile_cont(char_count, 0.5)::DOUBLE AS median, count(*) FILTER (char_count >= 0 AND char_count < 100) AS below_100, count(*) FILTER (char_count >= 100 AND char_count < 300) AS below_300, count(*) FILTER (char_count >= 300 AND char_count < 600) AS below_600, count(*) FILTER (char_count >= 600 AND char_count < 1000) AS below_1000, count(*) FILTER (char_count >= 1000 AND char_count <= 1500) AS up_to_1500 FROM chunks WHERE char_count IS NOT NULL GROUP BY 1",
}
SQL["k12_chunk_entries"] = _CHUNKS.replace("@whole", SQL["k02_whole_entry"].removeprefix("SELECT entry_id, ").removesuffix(" AS content FROM drug_entries")).replace("@summary", SQL["k03_summary"].replace("FROM drug_entries", "FROM e"))
