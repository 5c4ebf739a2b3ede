"""Structural parse of a block stream into entries and sections.

The stream is a table with an explicit order column: ``doc_id, block_idx, kind ('para' or
'table'), style, text``. What a sequential parser keeps as state is here a running sum or a
last non-null value over a window per document, so one shuffle by document serves all steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vellumflow.functions.text import contains_cjk, is_latin_name, strip

#: Styles that may carry a name, titles that are no names, and slices' heading.
NAME_STYLES = ("Body text|4", "Body text|5", "Body text|6", "Heading #1|1", "Heading #2", "Heading #5", "Normal")
TITLES = ("药材和饮片", "成方制剂和单味制剂", "植物油脂和提取物", "一部", "二部", "三部", "附录", "索引")
SLICES = ("饮片", "饮 片")
SLICE_STYLES = ("Heading #3", "Heading #4", "Body text|4", "Body text|5")
MARKER = "^[【〔](.+?)[】〕]"


def _ordered() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("block_idx")


def _so_far() -> WindowSpec:
    return _ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Separate counters of paragraphs and tables, from 0, NULL for the other kind."""

    def counter(kind: str) -> Column:
        own = F.col("kind") == kind
        return F.when(own, F.sum(F.when(own, 1).otherwise(0)).over(_so_far()) - 1)

    return blocks.withColumn("para_idx", counter("para")).withColumn("table_idx", counter("table"))


def is_likely_name(text: Column) -> Column:
    compact = F.translate(strip(text), " 　", "")
    plain = ~strip(text).rlike(MARKER) & ~strip(text).isin(*SLICES, *TITLES) & ~F.contains(text, F.lit("质量标准")) & ~text.rlike("[0-9]")
    return contains_cjk(text) & F.length(compact).between(2, 15) & plain


def next_is_latin(kind: str = "kind", text: str = "text") -> Column:
    """Whether the next paragraph that is not empty, at most two blocks on, is a Latin name."""

    def at(k: int, column: str) -> Column:
        return F.lead(column, k).over(_ordered())

    first, second = strip(at(1, text)), strip(at(2, text))
    second_fits = (at(2, kind) == "para") & is_latin_name(second)
    return F.coalesce((at(1, kind) == "para") & F.when(first != "", is_latin_name(first)).otherwise(second_fits), F.lit(False))


def boundary(style: Column, text: Column, latin_follows: Column, name_styles: Sequence[str] = NAME_STYLES) -> Column:
    """``main``, ``sub``, ``slice`` or '' for a paragraph; the first rule that fits wins."""

    def styled(*names: str) -> Column:
        return style.rlike("|".join("\\Q" + n + "\\E" for n in names))

    text = strip(text)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "")
        .when(text.isin(*SLICES) & styled(*SLICE_STYLES), "slice")
        .when(styled("Heading #3"), F.when(~is_latin_name(text) & contains_cjk(text), "main").otherwise(""))
        .when(styled("Heading #4"), F.when(~contains_cjk(text), "").when(latin_follows, "main").otherwise("sub"))
        .when(styled(*name_styles) & is_likely_name(text) & latin_follows, "main")
        .otherwise("")
    )


def mark_entries(blocks: DataFrame) -> DataFrame:
    """``bound, entry_no, entry_name, parent`` of every block; blocks before the first
    boundary are dropped. A slice is named after the last main entry."""
    follows = blocks.withColumn("latin_follows", next_is_latin())
    bound = F.when(F.col("kind") == "para", boundary(F.col("style"), F.col("text"), F.col("latin_follows"))).otherwise("")
    marked = follows.withColumn("bound", bound)
    numbered = marked.withColumn("entry_no", F.sum(F.when(F.col("bound") != "", 1).otherwise(0)).over(_so_far()))
    main = F.last(F.when(F.col("bound") == "main", strip(F.col("text"))), ignorenulls=True).over(_so_far())
    named = numbered.filter("entry_no > 0").withColumn("main_name", main)
    kind = F.last(F.when(F.col("bound") != "", F.col("bound")), ignorenulls=True).over(_so_far())
    title = F.last(F.when(F.col("bound") != "", strip(F.col("text"))), ignorenulls=True).over(_so_far())
    sliced = F.when(F.col("main_name").isNull(), "饮片").otherwise(F.concat("main_name", F.lit("-饮片")))
    named = named.withColumn("entry_kind", kind).withColumn("entry_name", F.when(F.col("entry_kind") == "slice", sliced).otherwise(title))
    return named.withColumn("parent", F.when(F.col("entry_kind") == "main", "").otherwise(F.coalesce("main_name", F.lit("")))).drop("latin_follows", "main_name")


def mark_sections(entries: DataFrame) -> DataFrame:
    """``section_no`` (0 before the first), ``section_name`` and ``line``, the text without marker."""
    within = Window.partitionBy("doc_id", "entry_no").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marker = (F.col("kind") == "para") & F.coalesce(strip(F.col("text")).rlike(MARKER), F.lit(False)) & (F.col("bound") == "")
    marked = entries.withColumn("is_marker", marker).withColumn("section_no", F.sum(F.when(F.col("is_marker"), 1).otherwise(0)).over(within))
    name = F.last(F.when(F.col("is_marker"), F.regexp_extract(strip(F.col("text")), MARKER, 1)), ignorenulls=True).over(within)
    line = F.when(F.col("is_marker"), strip(F.regexp_replace(strip(F.col("text")), MARKER, ""))).otherwise(strip(F.col("text")))
    return marked.withColumn("section_name", name).withColumn("line", line)


def _lines(kept: Column, sep: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.when(kept, F.struct("block_idx", "line"))))
    return F.array_join(F.transform(ordered, lambda x: x["line"]), sep)


def build_sections(marked: DataFrame) -> DataFrame:
    """One row per section: content lines joined by line ends, tables by empty lines."""
    para = (F.col("kind") == "para") & (F.col("line") != "")
    table = F.col("kind") == "table"
    grouped = marked.filter("section_no > 0").groupBy("doc_id", "entry_no", "section_no")
    return grouped.agg(F.max("section_name").alias("section_name"), _lines(para, "\n").alias("content"), F.nullif(_lines(table, "\n\n"), F.lit("")).alias("table_markdown"))


def name_slots(marked: DataFrame) -> DataFrame:
    """``pinyin_name, latin_name, intro_text`` per entry, from the paragraphs before the first
    section, filled in order by a fold: a style decides which slot takes a line, and a line no
    slot takes is introduction."""
    head = marked.filter("section_no = 0 AND bound = '' AND kind = 'para' AND line <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("block_idx", F.coalesce("style", F.lit("")).alias("style"), "line")))
    grouped = head.groupBy("doc_id", "entry_no").agg(ordered.alias("lines"))
    start = F.struct(F.lit("").alias("pinyin"), F.lit("").alias("latin"), F.array().cast("array<string>").alias("intro"))

    def step(acc: Column, x: Column) -> Column:
        style, line, latin = x["style"], x["line"], is_latin_name(x["line"])
        body3, head5 = F.contains(style, F.lit("Body text|3")), F.contains(style, F.lit("Heading #5"))
        body4, head4 = F.contains(style, F.lit("Body text|4")) & latin, F.contains(style, F.lit("Heading #4")) & latin
        free_p, free_l = acc["pinyin"] == "", acc["latin"] == ""
        to_pinyin = (body3 | head5 | body4) & free_p | ~body3 & ~head5 & ~body4 & head4 & ~free_l & free_p
        to_latin = (body3 | ~head5 & body4) & ~free_p & free_l | ~body3 & ~head5 & ~body4 & head4 & free_l
        taken = body3 | head5 | body4 | head4
        return F.struct(
            F.when(to_pinyin, line).otherwise(acc["pinyin"]).alias("pinyin"),
            F.when(to_latin, line).otherwise(acc["latin"]).alias("latin"),
            F.when(taken, acc["intro"]).otherwise(F.concat(acc["intro"], F.array(line))).alias("intro"),
        )

    folded = grouped.withColumn("slots", F.aggregate("lines", start, step))
    return folded.select("doc_id", "entry_no", F.col("slots.pinyin").alias("pinyin_name"), F.col("slots.latin").alias("latin_name"), F.array_join("slots.intro", "\n").alias("intro_text"))


def infer_category(name: Column, is_slice: Column, is_sub: Column, section_names: Column) -> Column:
    """Six ordered rules over an entry's kind, name and section names."""

    def has(*names: str) -> Column:
        return F.coalesce(F.arrays_overlap(section_names, F.array(*map(F.lit, names))), F.lit(False))

    return (
        F.when(is_slice, TITLES[0])
        .when(has("处方", "规格"), TITLES[1])
        .when(has("来源", "性味与归经"), TITLES[0])
        .when(name.rlike("流浸膏|浸膏|提取物"), TITLES[2])
        .when(is_sub, TITLES[1])
        .otherwise(TITLES[0])
    )


def parse_entries(blocks: DataFrame) -> DataFrame:
    """The whole parse: one row per entry with its sections as an array of structs."""
    marked = mark_sections(mark_entries(blocks))
    heads = marked.groupBy("doc_id", "entry_no").agg(F.max("entry_name").alias("drug_name"), F.max("parent").alias("parent_drug"), F.max("entry_kind").alias("entry_kind"), F.min("block_idx").alias("para_start"), F.max("block_idx").alias("para_end"))
    section = F.struct("section_no", "section_name", "content", "table_markdown")
    sections = build_sections(marked).groupBy("doc_id", "entry_no").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    joined = heads.join(name_slots(marked), ["doc_id", "entry_no"], "left").join(sections, ["doc_id", "entry_no"], "left")
    filled = joined.withColumn("sections", F.coalesce("sections", F.array().cast("array<struct<section_no:bigint,section_name:string,content:string,table_markdown:string>>")))
    for c in ("pinyin_name", "latin_name", "intro_text"):
        filled = filled.withColumn(c, F.coalesce(c, F.lit("")))
    names = F.transform("sections", lambda s: s["section_name"])
    return filled.withColumn("category_hint", infer_category(F.col("drug_name"), F.col("entry_kind") == "slice", F.col("entry_kind") == "sub", names))
