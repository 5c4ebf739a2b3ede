"""Block stream and structural parse, over the lines of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.functions.tables import to_markdown
from vellumflow.functions.text import contains_cjk, is_latin_name
from vellumflow.operators import segment
from vellumflow.session import read_table

from .common import SPACE, strip_sql


def block_stream(spark, folder):
    """Lines of each document as blocks: rows of Markdown tables as tables, headings by style."""
    lines = read_table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_idx", "line"))
    style = F.when(F.startswith("line", F.lit("# ")), "Heading #3").when(F.col("line").rlike("质量标准$"), "Heading #4").otherwise("Body text|7")
    text = F.when(F.startswith("line", F.lit("# ")), F.substring("line", 3, 1_000_000)).otherwise(F.col("line"))
    return lines.select("doc_id", F.col("block_idx").cast("bigint").alias("block_idx"), F.when(F.startswith("line", F.lit("|")), "table").otherwise("para").alias("kind"), style.alias("style"), text.alias("text"))


BLOCKS_SQL = """
SELECT doc_id, (i - 1)::BIGINT AS block_idx, CASE WHEN starts_with(line, '|') THEN 'table' ELSE 'para' END AS kind,
       CASE WHEN starts_with(line, '# ') THEN 'Heading #3' WHEN regexp_matches(line, '质量标准$') THEN 'Heading #4' ELSE 'Body text|7' END AS style,
       CASE WHEN starts_with(line, '# ') THEN substr(line, 3) ELSE line END AS text
FROM (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
"""


def s01_block_scan(spark, folder):
    return block_stream(spark, folder)


def s02_block_index(spark, folder):
    return segment.number_blocks(block_stream(spark, folder)).select("doc_id", "block_idx", "para_idx", "table_idx")


def s03_table_markdown(spark, folder):
    row = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"])
    grouped = read_table(spark, folder, "nation").groupBy("n_regionkey").agg(rows.alias("rows"))
    header = F.array(F.array(F.lit("key"), F.lit("name"), F.lit("note")))
    return grouped.select("n_regionkey", to_markdown(F.concat(header, "rows")).alias("markdown"))


def parse01_predicates(spark, folder):
    blocks = block_stream(spark, folder)
    return blocks.select("doc_id", "block_idx", contains_cjk(F.col("text")).alias("cjk"), is_latin_name(F.col("text")).alias("latin"), segment.is_likely_name(F.col("text")).alias("name"))


def parse04_lookahead(spark, folder):
    return block_stream(spark, folder).select("doc_id", "block_idx", segment.next_is_latin().alias("latin_follows"))


def parse05_boundary(spark, folder):
    marked = segment.mark_entries(block_stream(spark, folder)).filter("bound <> ''")
    return marked.select("doc_id", "block_idx", "bound")


def parse06_segments(spark, folder):
    return segment.mark_entries(block_stream(spark, folder)).groupBy("doc_id", "entry_no").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("block_idx").alias("first"), F.max("block_idx").alias("last"))


def parse07_parent_propagation(spark, folder):
    return segment.mark_entries(block_stream(spark, folder)).groupBy("doc_id", "entry_no").agg(F.max("entry_name").alias("name"), F.max("parent").alias("parent"), F.max("entry_kind").alias("entry_kind"))


def _marked(spark, folder):
    documents = read_table(spark, folder, "drug_entries").filter("sections IS NOT NULL")
    lines = documents.select(F.col("entry_id").alias("doc_id"), "loaded_at", F.posexplode(F.flatten(F.transform("sections", lambda s: F.coalesce(s["raw_paragraphs"], F.array(F.concat(F.lit("【"), F.coalesce(s["section_name"], F.lit("")), F.lit("】"), F.coalesce(s["content"], F.lit(""))))))).alias("lines")).alias("block_idx", "text"))
    return lines.select(F.concat_ws("@", F.col("doc_id").cast("string"), F.date_format("loaded_at", "yyyyMMddHHmmssSSSSSS")).alias("doc_id"), F.col("block_idx").cast("bigint").alias("block_idx"), F.lit("para").alias("kind"), F.lit("x").alias("style"), "text", F.lit("").alias("bound"), F.lit(1).alias("entry_no"))


def parse08_sections(spark, folder):
    """Sections found again in the raw paragraphs of the entries."""
    return segment.build_sections(segment.mark_sections(_marked(spark, folder))).select("doc_id", "section_no", "section_name", "content")


def _slots(spark, folder):
    """Names and introduction of the entries as blocks before their first section."""
    e = read_table(spark, folder, "drug_entries")
    lines = F.array(*[F.struct(F.lit(style).alias("style"), F.coalesce(c, F.lit("")).alias("text")) for style, c in (("Body text|3", "pinyin_name"), ("Body text|3", "latin_name"), ("Normal", "intro_text"))])
    rows = e.select(F.concat_ws("@", F.col("entry_id").cast("string"), F.date_format("loaded_at", "yyyyMMddHHmmssSSSSSS")).alias("doc_id"), F.posexplode(lines).alias("block_idx", "l"))
    return rows.select("doc_id", F.lit(1).alias("entry_no"), F.col("block_idx").cast("bigint").alias("block_idx"), F.lit("para").alias("kind"), "l.style", "l.text", F.lit("").alias("bound"), F.lit(0).alias("section_no"), F.regexp_replace("l.text", "(?U)^\\s+|\\s+$", "").alias("line"))


def parse09_name_slots(spark, folder):
    return segment.name_slots(_slots(spark, folder)).select("doc_id", "pinyin_name", "latin_name", "intro_text")


def parse11_tables(spark, folder):
    """Tables attached to the section that is open; those before any section are dropped."""
    e = read_table(spark, folder, "drug_entries").select("loaded_at", "entry_id", F.posexplode("sections").alias("no", "s"))
    blocks = F.array(F.struct(F.lit("para").alias("kind"), F.concat(F.lit("【"), F.col("s.section_id").cast("string"), F.lit("】")).alias("text")), F.struct(F.lit("table").alias("kind"), F.coalesce("s.table_markdown", F.lit("")).alias("text")))
    rows = e.select(F.concat_ws("@", F.col("entry_id").cast("string"), F.date_format("loaded_at", "yyyyMMddHHmmssSSSSSS")).alias("doc_id"), "no", F.posexplode(blocks).alias("i", "b"))
    stream = rows.select("doc_id", (F.col("no") * 2 + F.col("i")).cast("bigint").alias("block_idx"), "b.kind", F.lit("x").alias("style"), "b.text", F.lit("").alias("bound"), F.lit(1).alias("entry_no"))
    return segment.build_sections(segment.mark_sections(stream)).select("doc_id", "section_no", "section_name", "table_markdown")


def parse12_category(spark, folder):
    names = F.transform("sections", lambda s: s["section_name"])
    e = read_table(spark, folder, "drug_entries")
    return e.select("entry_id", segment.infer_category(F.col("drug_name"), F.col("is_yinpian"), F.col("is_sub_formulation"), names).alias("category"))


def parse13_stats(spark, folder):
    names = read_table(spark, folder, "drug_entries").select(F.explode("sections").alias("s")).groupBy(F.col("s.section_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("s.table_markdown"), F.lit("")) != "").alias("n_tables"))
    return names.filter("name IS NOT NULL").orderBy(F.col("n").desc(), "name").limit(15)


def parse14_entries(spark, folder):
    """The whole parse of the documents."""
    found = segment.parse_entries(block_stream(spark, folder))
    held = F.transform("sections", lambda x: F.concat_ws("|", x["section_name"], x["content"], F.coalesce(x["table_markdown"], F.lit(""))))
    return found.select("doc_id", "entry_no", "drug_name", "parent_drug", "pinyin_name", "latin_name", "intro_text", "category_hint", "para_start", "para_end", F.size("sections").alias("n_sections"), F.md5(F.array_join(held, "#")).alias("sections"))


QUERIES = {f.__name__: f for f in (s01_block_scan, s02_block_index, s03_table_markdown, parse01_predicates, parse04_lookahead, parse05_boundary, parse06_segments, parse07_parent_propagation, parse08_sections, parse09_name_slots, parse11_tables, parse12_category, parse13_stats, parse14_entries)}

_T = strip_sql("text")
_LATIN_CLASS = "[A-Za-z\\-" + SPACE[1:]


def _latin(x: str) -> str:
    return f"regexp_matches({x}, '^{_LATIN_CLASS}+$')"


def _cjk(x: str) -> str:
    return f"regexp_matches({x}, '[一-鿿]')"


_TITLES = ", ".join(f"'{x}'" for x in (*segment.TITLES, *segment.SLICES))
_NAME = f"({_cjk('text')} AND length(translate({_T}, ' 　', '')) BETWEEN 2 AND 15 AND NOT regexp_matches({_T}, '^[【〔](.+?)[】〕]') AND {_T} NOT IN ({_TITLES}) AND NOT contains(text, '质量标准') AND NOT regexp_matches(text, '[0-9]'))"
_AHEAD = f"""
SELECT *, coalesce(k1 = 'para' AND CASE WHEN t1 <> '' THEN {_latin('t1')} ELSE k2 = 'para' AND {_latin('t2')} END, false) AS latin_follows
FROM (SELECT *, lead(kind, 1) OVER w AS k1, lead(kind, 2) OVER w AS k2, {strip_sql('lead(text, 1) OVER w')} AS t1, {strip_sql('lead(text, 2) OVER w')} AS t2
      FROM ({BLOCKS_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx))
"""
_STYLED = "(" + " OR ".join(f"contains(style, '{s}')" for s in segment.NAME_STYLES) + ")"
_SLICED = "(" + " OR ".join(f"contains(style, '{s}')" for s in segment.SLICE_STYLES) + ")"
_ENTRIES = f"""
WITH a AS ({_AHEAD}), b AS (
  SELECT *, CASE WHEN kind <> 'para' OR {_T} = '' THEN '' WHEN {_T} IN ('饮片', '饮 片') AND {_SLICED} THEN 'slice'
    WHEN contains(style, 'Heading #3') THEN CASE WHEN NOT {_latin(_T)} AND {_cjk(_T)} THEN 'main' ELSE '' END
    WHEN contains(style, 'Heading #4') THEN CASE WHEN NOT {_cjk(_T)} THEN '' WHEN latin_follows THEN 'main' ELSE 'sub' END
    WHEN {_STYLED} AND {_NAME} AND latin_follows THEN 'main' ELSE '' END AS bound FROM a),
n AS (SELECT *, sum(CASE WHEN bound <> '' THEN 1 ELSE 0 END) OVER w AS entry_no,
        last_value(CASE WHEN bound = 'main' THEN {_T} END IGNORE NULLS) OVER w AS main_name,
        last_value(CASE WHEN bound <> '' THEN bound END IGNORE NULLS) OVER w AS entry_kind,
        last_value(CASE WHEN bound <> '' THEN {_T} END IGNORE NULLS) OVER w AS title
      FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT *, CASE WHEN entry_kind <> 'slice' THEN title WHEN main_name IS NULL THEN '饮片' ELSE main_name || '-饮片' END AS entry_name,
       CASE WHEN entry_kind = 'main' THEN '' ELSE coalesce(main_name, '') END AS parent
FROM n WHERE entry_no > 0
"""
_MARKED = f"""
WITH l AS (SELECT entry_id::VARCHAR || '@' || strftime(loaded_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S%f') AS doc_id, flatten(list_transform(sections, lambda s: coalesce(s.raw_paragraphs, ['【' || coalesce(s.section_name, '') || '】' || coalesce(s.content, '')]))) AS p FROM drug_entries),
b AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS text FROM l),
m AS (SELECT *, coalesce(regexp_matches({_T}, '^[【〔](.+?)[】〕]'), false) AS mark, {_T} AS t FROM b),
n AS (SELECT *, sum(mark::INT) OVER w AS section_no, last_value(CASE WHEN mark THEN regexp_extract(t, '^[【〔](.+?)[】〕]', 1) END IGNORE NULLS) OVER w AS section_name,
        CASE WHEN mark THEN {strip_sql("regexp_replace(t, '^[【〔](.+?)[】〕]', '')")} ELSE t END AS line
      FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, section_no::BIGINT AS section_no, max(section_name) AS section_name, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), '') AS content FROM n WHERE section_no > 0 GROUP BY ALL
"""
SQL = {
    "s01_block_scan": BLOCKS_SQL,
    "s02_block_index": f"SELECT doc_id, block_idx, CASE WHEN kind = 'para' THEN sum((kind = 'para')::INT) OVER w - 1 END::BIGINT AS para_idx, CASE WHEN kind = 'table' THEN sum((kind = 'table')::INT) OVER w - 1 END::BIGINT AS table_idx FROM ({BLOCKS_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "s03_table_markdown": "SELECT n_regionkey, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1",
    "parse01_predicates": f"SELECT doc_id, block_idx, {_cjk('text')} AS cjk, {_latin(_T)} AS latin, {_NAME} AS name FROM ({BLOCKS_SQL})",
    "parse04_lookahead": f"SELECT doc_id, block_idx, latin_follows FROM ({_AHEAD})",
    "parse05_boundary": f"SELECT doc_id, block_idx, bound FROM ({_ENTRIES}) WHERE bound <> ''",
    "parse06_segments": f"SELECT doc_id, entry_no::BIGINT AS entry_no, count(*) AS n_blocks, min(block_idx) AS first, max(block_idx) AS last FROM ({_ENTRIES}) GROUP BY ALL",
    "parse07_parent_propagation": f"SELECT doc_id, entry_no::BIGINT AS entry_no, max(entry_name) AS name, max(parent) AS parent, max(entry_kind) AS entry_kind FROM ({_ENTRIES}) GROUP BY 1, 2",
    "parse08_sections": _MARKED,
    "parse09_name_slots": f"""WITH e AS (SELECT entry_id::VARCHAR || '@' || strftime(loaded_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S%f') AS doc_id, list_filter([{strip_sql("coalesce(pinyin_name, '')")}, {strip_sql("coalesce(latin_name, '')")}], lambda x: x <> '') AS n, {strip_sql("coalesce(intro_text, '')")} AS i FROM drug_entries)
SELECT doc_id, coalesce(n[1], '') AS pinyin_name, coalesce(n[2], '') AS latin_name, i AS intro_text FROM e WHERE len(n) > 0 OR i <> ''""",
    "parse11_tables": f"SELECT entry_id::VARCHAR || '@' || strftime(loaded_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S%f') AS doc_id, no AS section_no, s.section_id::VARCHAR AS section_name, nullif({strip_sql("coalesce(s.table_markdown, '')")}, '') AS table_markdown FROM (SELECT entry_id, loaded_at, unnest(generate_series(1, len(sections))) AS no, unnest(sections) AS s FROM drug_entries WHERE sections IS NOT NULL)",
    "parse12_category": "SELECT entry_id, CASE WHEN is_yinpian THEN '药材和饮片' WHEN list_has_any(n, ['处方', '规格']) THEN '成方制剂和单味制剂' WHEN list_has_any(n, ['来源', '性味与归经']) THEN '药材和饮片' WHEN regexp_matches(drug_name, '流浸膏|浸膏|提取物') THEN '植物油脂和提取物' WHEN is_sub_formulation THEN '成方制剂和单味制剂' ELSE '药材和饮片' END AS category FROM (SELECT *, list_transform(sections, lambda s: s.section_name) AS n FROM drug_entries)",
    "parse13_stats": "SELECT s.section_name AS name, count(*) AS n, count(*) FILTER (coalesce(s.table_markdown, '') <> '') AS n_tables FROM (SELECT unnest(sections) AS s FROM drug_entries) WHERE s.section_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 15",
}
_MARK_PATTERN = "'^[【〔](.+?)[】〕]'"
SQL["parse14_entries"] = f"""WITH e0 AS ({_ENTRIES}), m AS (SELECT *, coalesce(kind = 'para' AND bound = '' AND regexp_matches({_T}, {_MARK_PATTERN}), false) AS mark, {_T} AS t FROM e0),
n AS (SELECT doc_id, entry_no, block_idx, kind, bound, entry_name, parent, entry_kind, sum(mark::INT) OVER w AS section_no, last_value(CASE WHEN mark THEN regexp_extract(t, {_MARK_PATTERN}, 1) END IGNORE NULLS) OVER w AS section_name, CASE WHEN mark THEN {strip_sql(f"regexp_replace(t, {_MARK_PATTERN}, '')")} ELSE t END AS line
FROM m WINDOW w AS (PARTITION BY doc_id, entry_no ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
se AS (SELECT doc_id, entry_no, section_no, max(section_name) AS name, coalesce(string_agg(line, chr(10) ORDER BY block_idx) FILTER (kind = 'para' AND line <> ''), '') AS content, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY block_idx) FILTER (kind = 'table'), '') AS tab FROM n WHERE section_no > 0 GROUP BY ALL),
ss AS (SELECT doc_id, entry_no, count(*) AS c, list(name) AS names, string_agg(name || '|' || content || '|' || tab, '#' ORDER BY section_no) AS held FROM se GROUP BY ALL),
io AS (SELECT doc_id, entry_no, string_agg(line, chr(10) ORDER BY block_idx) AS intro FROM n WHERE section_no = 0 AND bound = '' AND kind = 'para' AND line <> '' GROUP BY ALL),
he AS (SELECT doc_id, entry_no, max(entry_name) AS drug_name, max(parent) AS parent_drug, max(entry_kind) AS k, min(block_idx) AS para_start, max(block_idx) AS para_end FROM n GROUP BY ALL)
SELECT he.doc_id, he.entry_no::BIGINT AS entry_no, drug_name, parent_drug, '' AS pinyin_name, '' AS latin_name, coalesce(intro, '') AS intro_text, CASE WHEN k = 'slice' THEN '药材和饮片' WHEN list_has_any(coalesce(names, []), ['处方', '规格']) THEN '成方制剂和单味制剂' WHEN list_has_any(coalesce(names, []), ['来源', '性味与归经']) THEN '药材和饮片' WHEN regexp_matches(drug_name, '流浸膏|浸膏|提取物') THEN '植物油脂和提取物' WHEN k = 'sub' THEN '成方制剂和单味制剂' ELSE '药材和饮片' END AS category_hint,
para_start, para_end, coalesce(c, 0)::INT AS n_sections, md5(coalesce(held, '')) AS sections FROM he LEFT JOIN ss USING (doc_id, entry_no) LEFT JOIN io USING (doc_id, entry_no)"""
