"""Cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.functions import text as t
from vellumflow.session import read_table

from .common import BLANK, SECTIONS_SQL, quoted, replace_sql, sections_of, strip_sql

LITERALS = (("，", ","), ("；", ";"), (",;", ";"))
PATTERNS = (("([0-9]+)\\s*℃", "$1 °C"), ("不得过([0-9.]+)%", "≤$1%"))
SUSPECTS = ("■", "昔", "？", "…", "〇")


def _chunks(spark, folder, *columns):
    return read_table(spark, folder, "chunks").select("chunk_seq", *columns)


def c01_literal_fix(spark, folder):
    return _chunks(spark, folder, t.replace_literals(F.col("content"), LITERALS).alias("text"))


def c02_regex_fix(spark, folder):
    return _chunks(spark, folder, t.replace_patterns(F.col("content"), PATTERNS).alias("text"))


def c03_half_width(spark, folder):
    return _chunks(spark, folder, t.half_width(F.col("content")).alias("text"))


def c04_collapse_blanks(spark, folder):
    return _chunks(spark, folder, t.collapse_blanks(F.col("content")).alias("text"))


def c05_repair_references(spark, folder):
    return _chunks(spark, folder, t.repair_references(F.replace(F.col("content"), F.lit("方法"), F.lit("通则0"))).alias("text"))


def c06_clean_text(spark, folder):
    return _chunks(spark, folder, t.clean_text(F.col("content")).alias("text"))


def c07_clean_name(spark, folder):
    return read_table(spark, folder, "drug_entries").select("entry_id", t.clean_name(F.col("drug_name")).alias("name"), t.clean_name(F.col("parent_drug")).alias("parent"))


def c08_lookup_normalise(spark, folder):
    return sections_of(spark, folder).select("section_id", t.lookup(F.col("section_name"), t.SECTION_NAMES | {"鉴 别": "鉴别", "檢查": "检查"}).alias("name"))


def _kept(s):
    return (F.coalesce(s["content"], F.lit("")) != "") | (F.coalesce(s["table_markdown"], F.lit("")) != "")


def c09_drop_empty_nested(spark, folder):
    kept = F.filter("sections", _kept)
    return read_table(spark, folder, "drug_entries").select("entry_id", F.size("sections").alias("n_before"), F.size(kept).alias("n_kept"), F.array_join(F.transform(kept, lambda s: s["section_id"].cast("string")), ",").alias("kept"))


def c10_drop_empty(spark, folder):
    kept = (F.size(F.filter("sections", _kept)) > 0) | (F.coalesce("intro_text", F.lit("")) != "")
    return read_table(spark, folder, "drug_entries").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def c11_residual_audit(spark, folder):
    text = F.coalesce("content", F.lit(""))
    counts = [F.sum(t.count_of(text, s)).cast("bigint").alias(f"n_{i}") for i, s in enumerate(SUSPECTS)]
    return read_table(spark, folder, "chunks").agg(*counts)


QUERIES = {f.__name__: f for f in (c01_literal_fix, c02_regex_fix, c03_half_width, c04_collapse_blanks, c05_repair_references, c06_clean_text, c07_clean_name, c08_lookup_normalise, c09_drop_empty_nested, c10_drop_empty, c11_residual_audit)}


def _half(x):
    return f"translate({x}, '{t._WIDE}', '{t._NARROW}')"


def _collapse(x):
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?m)^{BLANK}+', '', 'g')"
    x = f"regexp_replace({x}, '(?m){BLANK}+$', '', 'g')"
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _references(x):
    return f"regexp_replace(replace({x}, '■', '。'), '通则0?\\.?([0-9]{{4}})', '通则\\1', 'g')"


def _rules(x, rules):
    for pattern, by, *_ in rules:
        pattern = pattern.replace("(?U)(\\w+苷)\\s*昔", "([\\p{L}\\p{N}_]+苷)\\s*昔")
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(by.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def _clean(x):
    return strip_sql(_references(_collapse(_half(_rules(replace_sql(x, t.MARKER_FIXES), t.CONTEXT_FIXES)))))


def _name(x):
    return _clean(replace_sql(f"translate({x}, ' 　', '')", t.NAME_FIXES))


_KEPT = "len(list_filter(sections, lambda s: coalesce(s.content, '') <> '' OR coalesce(s.table_markdown, '') <> ''))"
_CASES = " ".join(f"WHEN section_name = {quoted(a)} THEN {quoted(b)}" for a, b in (t.SECTION_NAMES | {"鉴 别": "鉴别", "檢查": "检查"}).items())

SQL = {
    "c01_literal_fix": f"SELECT chunk_seq, {replace_sql('content', LITERALS)} AS text FROM chunks",
    "c02_regex_fix": f"SELECT chunk_seq, {_rules('content', PATTERNS)} AS text FROM chunks",
    "c03_half_width": f"SELECT chunk_seq, {_half('content')} AS text FROM chunks",
    "c04_collapse_blanks": f"SELECT chunk_seq, {_collapse('content')} AS text FROM chunks",
    "c05_repair_references": f"SELECT chunk_seq, {_references(chr(39).join(['replace(content, ', '方法', ', ', '通则0', ')']))} AS text FROM chunks",
    "c06_clean_text": f"SELECT chunk_seq, {_clean('content')} AS text FROM chunks",
    "c07_clean_name": f"SELECT entry_id, {_name('drug_name')} AS name, {_name('parent_drug')} AS parent FROM drug_entries",
    "c08_lookup_normalise": f"SELECT section_id, CASE {_CASES} ELSE section_name END AS name FROM ({SECTIONS_SQL})",
    "c09_drop_empty_nested": f"SELECT entry_id, len(sections)::INT AS n_before, {_KEPT}::INT AS n_kept, array_to_string(list_transform(list_filter(sections, lambda s: coalesce(s.content, '') <> '' OR coalesce(s.table_markdown, '') <> ''), lambda s: s.section_id), ',') AS kept FROM drug_entries",
    "c10_drop_empty": f"SELECT count(*) FILTER ({_KEPT} > 0 OR coalesce(intro_text, '') <> '') AS kept, count(*) FILTER (NOT ({_KEPT} > 0 OR coalesce(intro_text, '') <> '')) AS dropped FROM drug_entries",
    "c11_residual_audit": "SELECT " + ", ".join(f"sum(length(coalesce(content, '')) - length(replace(coalesce(content, ''), '{s}', '')))::BIGINT AS n_{i}" for i, s in enumerate(SUSPECTS)) + " FROM chunks",
}
