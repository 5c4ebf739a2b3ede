"""Registered queries of the problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumflow.session import broadcast_checked, latest, read_table

from . import canonmap, encode, packing, pairs, scan, spam, splitter, visual

CAPACITY = 8_192


def sections(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """``section_id`` and the named fields of every section of every delivered entry."""
    entries = read_table(spark, folder, "drug_entries").select(F.explode("sections").alias("s"))
    return entries.select("s.section_id", *[F.col(f"s.{f}").alias(f) for f in fields])


def _kind(df: DataFrame, kind: str, id_col: str) -> DataFrame:
    return df.select(F.lit(kind).alias("item_kind"), F.col(id_col).alias("item_id"), *[c for c in df.columns if c != id_col])


# --- 1


def section_forms(spark: SparkSession, folder: str) -> DataFrame:
    """All forms of the catalog: names first, then aliases, then translation and transcription."""
    catalog = read_table(spark, folder, "section_catalog")
    names = catalog.select("canon_id", F.lit(0).alias("tier"), F.col("section_name").alias("form"))
    aliases = catalog.select("canon_id", F.lit(1).alias("tier"), F.explode("aliases").alias("form"))
    foreign = catalog.select("canon_id", F.lit(2).alias("tier"), F.explode(F.array("name_en", "pinyin")).alias("form"))
    return names.unionByName(aliases).unionByName(foreign).filter(F.col("form").isNotNull())


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    """``item_kind, item_id, value`` of all section values."""
    typed = _kind(sections(spark, folder, "section_name").withColumnRenamed("section_name", "value"), "section_name", "section_id")
    return typed.unionByName(_kind(read_table(spark, folder, "chunks").select("chunk_seq", F.col("section").alias("value")), "chunk_section", "chunk_seq"))


def p1_map(spark: SparkSession, folder: str) -> DataFrame:
    """Every section value with its entry, -1 if unmatched, NULL if there is no value."""
    typed = _typed(spark, folder).select(F.struct("item_kind", "item_id").alias("item"), "value")
    mapped = canonmap.map_values(typed, "item", "value", section_forms(spark, folder))
    return mapped.select("item.item_kind", "item.item_id", "value", "canon_id", "distance").distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    names = read_table(spark, folder, "section_catalog").select(F.col("section_name").alias("value")).distinct()
    cases = _typed(spark, folder).filter("value <> ''").join(broadcast_checked(names), "value", "left_anti")
    mapped = canonmap.map_values(cases.select(F.struct("item_kind", "item_id").alias("item"), "value"), "item", "value", section_forms(spark, folder))
    return mapped.select("item.item_kind", "item.item_id", "canon_id").distinct()


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The report of unmatched values with the number of items that hold them."""
    return p1_map(spark, folder).filter(F.col("canon_id") == canonmap.UNMATCHED).groupBy("item_kind", "value").agg(F.count(F.lit(1)).alias("n_items"))


# --- 2


def p2_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with its defect, NULL if it has none."""
    results = pairs.flag_pairs(read_table(spark, folder, "query_results"), "result_id", "query", "answer")
    replies = pairs.flag_pairs(read_table(spark, folder, "gen_responses"), "response_id", "query", "raw_answer")
    named = [d.select(F.lit(kind).alias("record_kind"), F.col(d.columns[0]).alias("record_id"), "defect") for kind, d in (("query_result", results), ("gen_response", replies))]
    return named[0].unionByName(named[1]).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_flags(spark, folder).filter("defect IS NOT NULL")


# --- 3


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry name and chunk text in its one form."""
    names = latest(read_table(spark, folder, "drug_entries").select("entry_id", "loaded_at", "drug_name"), "entry_id")
    texts = latest(read_table(spark, folder, "chunks").select("chunk_seq", "loaded_at", "content"), "chunk_seq")
    parts = [_kind(visual.canonical_forms(names, "entry_id", "drug_name"), "drug_name", "entry_id"), _kind(visual.canonical_forms(texts, "chunk_seq", "content"), "chunk_content", "chunk_seq")]
    return parts[0].unionByName(parts[1]).select("item_kind", "item_id", "canonical", (F.col("text") != F.col("canonical")).alias("changed"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    names = visual.look_alike_pairs(read_table(spark, folder, "drug_entries"), "entry_id", "drug_name")
    texts = visual.look_alike_pairs(read_table(spark, folder, "chunks"), "chunk_seq", "content")
    return names.select(F.lit("drug_name").alias("item_kind"), "id_a", "id_b").unionByName(texts.select(F.lit("chunk_content").alias("item_kind"), "id_a", "id_b"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every name and text that looks like a different one."""
    names = visual.look_alike_classes(read_table(spark, folder, "drug_entries"), "entry_id", "drug_name")
    texts = visual.look_alike_classes(read_table(spark, folder, "chunks"), "chunk_seq", "content")
    return _kind(names, "drug_name", "entry_id").unionByName(_kind(texts, "chunk_content", "chunk_seq"))


# --- 4


def _oversized(spark: SparkSession, folder: str, once: bool) -> DataFrame:
    entries, chunks = read_table(spark, folder, "drug_entries"), read_table(spark, folder, "chunks")
    if once:
        entries = latest(entries.select("entry_id", "loaded_at", "sections"), "entry_id")
        chunks = latest(chunks.select("chunk_seq", "loaded_at", "content"), "chunk_seq")
    parts = entries.select(F.explode("sections").alias("s")).select("s.section_id", "s.content")
    return _kind(splitter.split_oversized(parts, "section_id", "content"), "section", "section_id").unionByName(_kind(splitter.split_oversized(chunks, "chunk_seq", "content"), "chunk", "chunk_seq"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _oversized(spark, folder, once=False).filter("n_pieces > 1").select("item_kind", "item_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All items: one row each, or one per piece, with the right ``char_count``."""
    return _oversized(spark, folder, once=True)


def p4_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Every item by its pieces: how far they reach without a gap, and whether all fit."""
    order = Window.partitionBy("item_kind", "item_id").orderBy("piece_no")
    end = F.col("start") + F.col("char_count")
    pieces = p4_pieces(spark, folder).select("item_kind", "item_id", "start", "char_count", (F.col("start") > F.coalesce(F.lag(end).over(order), F.lit(0))).alias("gap"))
    return pieces.groupBy("item_kind", "item_id").agg(F.max(end).alias("n_chars"), (F.max("char_count") <= splitter.LIMIT).alias("fits"), (~F.bool_or("gap")).alias("gapless"))


P4_LENGTHS_SQL = """
SELECT 'chunk' AS item_kind, chunk_seq AS item_id, coalesce(length(content), 0)::INT AS n_chars, true AS fits, true AS gapless FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_seq ORDER BY loaded_at DESC) = 1)
UNION ALL
SELECT 'section', s.section_id, coalesce(length(s.content), 0)::INT, true, true FROM (SELECT unnest(sections) AS s FROM (SELECT * FROM drug_entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC) = 1))
"""
P4_FOUND_SQL = """
SELECT DISTINCT 'chunk' AS item_kind, chunk_seq AS item_id FROM chunks WHERE length(content) > 1500
UNION ALL
SELECT DISTINCT 'section', s.section_id FROM (SELECT unnest(sections) AS s FROM drug_entries) WHERE length(s.content) > 1500
"""

# --- 5


def _scanned(spark: SparkSession, folder: str, once: bool) -> list[tuple[str, str, str, DataFrame]]:
    """Kind, id, text column and rows of everything that was scanned."""
    chunks = read_table(spark, folder, "chunks").select("chunk_seq", "loaded_at", "content")
    entries = read_table(spark, folder, "drug_entries").select("entry_id", "loaded_at", "drug_name", F.col("sections.section_id").alias("section_ids"), F.col("sections.section_name").alias("section_names"))
    if once:
        chunks, entries = latest(chunks, "chunk_seq"), latest(entries, "entry_id")
    headings = entries.select(F.explode(F.arrays_zip("section_ids", "section_names")).alias("s")).select(F.col("s.section_ids").alias("section_id"), F.col("s.section_names").alias("section_name"))
    return [("chunk_content", "chunk_seq", "content", chunks), ("drug_name", "entry_id", "drug_name", entries), ("section_name", "section_id", "section_name", headings)]


def _repaired(spark: SparkSession, folder: str, once: bool) -> DataFrame:
    sources = _scanned(spark, folder, once)
    texts = reduce(DataFrame.unionByName, [df.select(F.col(text).alias("text")) for _, _, text, df in sources])
    lexicon = scan.build_lexicon(texts, "text")
    parts = [_kind(scan.repair_texts(df, key, text, lexicon, names=kind != "chunk_content"), kind, key) for kind, key, text, df in sources]
    return reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder, once=False).select("item_kind", "item_id", F.explode("noise").alias("noise_kind")).distinct()


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every scanned text in its readable form."""
    return _repaired(spark, folder, once=True)


# --- 6, 7


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_corpus(read_table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the text that the ids of every document decode to."""
    ids = encode.encode_corpus(read_table(spark, folder, "documents"))
    return ids.select("doc_id", F.md5(encode.decode_ids(F.col("ids"))).alias("digest"))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return packing.pack(encode.token_counts(documents), CAPACITY, n_rows=documents.count())


def p7_pack_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Number of packed documents, of containers over their capacity, of documents not whole."""
    packed = p7_pack(spark, folder)
    over = packed.groupBy("container_id").agg(F.sum("size").alias("held")).agg(F.count_if(F.col("held") > CAPACITY).alias("n_over"))
    docs = packed.groupBy("doc_id").agg((F.sum("size") == F.max("item_end")).alias("whole")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~F.col("whole")).alias("n_broken"))
    return docs.crossJoin(over)  # one row each


# --- 8


def p8_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its features and the verdict."""
    return spam.find_spam(read_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_pages(spark, folder).filter("spam").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_map": p1_map,
    "p1_unmatched": p1_unmatched,
    "p2_found": p2_found,
    "p2_flags": p2_flags,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_lengths": p4_lengths,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_pack": p7_pack,
    "p7_pack_totals": p7_pack_totals,
    "p8_found": p8_found,
    "p8_pages": p8_pages,
}

SQL: dict[str, str] = {
    "p4_found": P4_FOUND_SQL,
    "p4_lengths": P4_LENGTHS_SQL,
    "p6_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_pack_totals": "SELECT count(DISTINCT doc_id) AS n_docs, 0 AS n_broken, 0 AS n_over FROM documents",
}
