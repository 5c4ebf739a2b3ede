"""Chunking of entries and texts as folds over arrays: narrow, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions.text import strip

LIMIT, OVERLAP, SHORT, LEAST = 1_500, 100, 300, 50
WHOLE_SECTIONS = 8
DELIMITERS = "。；！？\\n"
#: The sections merged into one chunk, and those kept apart.
CLINICAL = ("性味与归经", "性味", "归经", "功能与主治", "功能主治", "主治", "用法与用量", "用法", "注意", "注意事项", "禁忌", "贮藏", "规格")
DETAILED = ("来源", "制法", "处方", "炮制", "提取", "性状", "鉴别", "检查", "浸出物", "含量测定", "特征图谱", "指纹图谱", "酸溶性浸出物", "醇浸出物", "正丁醇浸出物", "正丁醇提取物", "乙酸乙酯浸出物", "挥发性醯浸出物", "挥发油", "总固体", "相对密度", "效价测定", "酸碱度")
UNMERGED = ("含量测定", "鉴别")
#: How a component's assay and an item of a test section begin.
COMPONENT = "^[一-龥]{1,6}\\s*照\\s*(?:高效液相色谱法|薄层色谱法|气相色谱法|紫外)"
ITEMS = ("水分", "总灰分", "酸不溶性灰分", "重金属及有害元素", "砷盐", "农药残留", "二氧化硫残留", "黄曲霉毒素", "干燥失重", "炽灼残渣", "膨胀度", "pH值", "相对密度", "折光率", "乙醇量", "甲醇量", "可见异物", "不溶性微粒", "装量差异", "重量差异", "崩解时限", "溶散时限", "发泡量", "硬度", "脆碎度", "溶出度", "释放度", "含量均匀度", "有关物质", "残留溶剂", "山银花", "其他")
LEAST_ITEM = 20

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def sentences(text: Column, delimiters: str = DELIMITERS) -> Column:
    """Sentences with their delimiter; blank ones are dropped. NULL gives NULL."""
    return F.filter(F.split(text, f"(?<=[{delimiters}])", -1), lambda s: strip(s) != "")


def sliding_windows(parts: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Windows over sentences: a window is closed when the next sentence does not fit and
    the next one begins with its last ``overlap`` characters; a sentence is never cut."""
    start = F.struct(_none().alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        full = (F.length(acc["open"]) + F.length(part) > limit) & (acc["open"] != "")
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.concat(F.when(full, F.right(acc["open"], F.lit(overlap))).otherwise(acc["open"]), part).alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def fixed_slices(text: Column, width: int = LIMIT) -> Column:
    """Slices of fixed width; an empty text has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(width)))).otherwise(_none())


def windows(text: Column, limit: int = LIMIT, overlap: int = OVERLAP, delimiters: str = DELIMITERS) -> Column:
    """Sliding windows, or fixed slices of a text of one sentence at most."""
    parts = sentences(text, delimiters)
    return F.when(F.size(parts) <= 1, fixed_slices(text, limit)).otherwise(sliding_windows(parts, limit, overlap))


def greedy_pack(parts: Column, limit: int = LIMIT) -> Column:
    """Consecutive parts joined by line ends while their lengths, without the line ends, fit."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), _none().alias("open"), F.lit(0).alias("held"))

    def step(acc: Column, part: Column) -> Column:
        full = (acc["held"] + F.length(part) > limit) & (F.size(acc["open"]) > 0)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, F.array(part)).otherwise(F.concat(acc["open"], F.array(part))).alias("open"), (F.when(full, 0).otherwise(acc["held"]) + F.length(part)).alias("held"))

    packed = F.aggregate(parts, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.transform(packed, lambda p: F.array_join(p, "\n"))


def split_components(text: Column, pattern: str = COMPONENT) -> Column:
    """Pieces from one component heading to the next; what stands before goes to the first.
    Fewer than two headings give the whole text."""
    pieces = F.split(text, f"(?Um)(?={pattern})", -1)
    headed = F.filter(pieces, lambda p: F.regexp_like(p, F.lit("(?U)" + pattern)))
    head = F.when(~F.regexp_like(F.element_at(pieces, 1), F.lit("(?U)" + pattern)), strip(F.element_at(pieces, 1))).otherwise("")
    stripped = F.transform(headed, strip)
    joined = F.when(head != "", F.concat(F.array(F.concat(head, F.lit("\n"), F.element_at(stripped, 1))), F.slice(stripped, F.lit(2), F.size(stripped)))).otherwise(stripped)
    return F.when(F.size(headed) >= 2, joined).otherwise(F.array(text))


def split_items(text: Column, items: tuple[str, ...] = ITEMS, least: int = LEAST_ITEM) -> Column:
    """A new piece at each line that begins with an item; pieces of at most ``least``
    characters are dropped; fewer than two remaining pieces give the whole text."""
    begins = "^(?:" + "|".join("\\Q" + i + "\\E" for i in items) + ")"
    start = F.struct(_none().alias("done"), _none().alias("open"))

    def step(acc: Column, line: Column) -> Column:
        new = strip(line).rlike(begins) & (F.size(acc["open"]) > 0)
        return F.struct(F.when(new, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n")))).otherwise(acc["done"]).alias("done"), F.when(new, F.array(line)).otherwise(F.concat(acc["open"], F.array(line))).alias("open"))

    pieces = F.aggregate(F.split(text, "\n", -1), start, step, lambda acc: F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n"))))
    kept = F.filter(pieces, lambda p: F.length(strip(p)) > least)
    return F.when((F.size(pieces) >= 2) & (F.size(kept) >= 2), kept).otherwise(F.array(text))


def entry_length(entry_intro: Column, sections: Column) -> Column:
    """Length of introduction and section contents; tables do not count."""
    contents = F.aggregate(sections, F.lit(0), lambda n, s: n + F.length(F.coalesce(s["content"], F.lit(""))))
    return F.length(F.coalesce(entry_intro, F.lit(""))) + F.coalesce(contents, F.lit(0))


def is_whole(intro: Column, sections: Column, limit: int = LIMIT, most: int = WHOLE_SECTIONS) -> Column:
    """Whether an entry is short enough for one chunk."""
    return (entry_length(intro, sections) <= limit) & (F.coalesce(F.size(sections), F.lit(0)) <= most)


def section_parts(sections: Column) -> Column:
    """``【name】content`` and ``【name-表格】`` with the table, for what is there."""

    def parts(s: Column) -> Column:
        content, table = strip(F.coalesce(s["content"], F.lit(""))), F.coalesce(s["table_markdown"], F.lit(""))
        name = F.coalesce(s["section_name"], F.lit(""))
        return F.concat(F.when(content != "", F.array(F.concat(F.lit("【"), name, F.lit("】"), content))).otherwise(_none()), F.when(table != "", F.array(F.concat(F.lit("【"), name, F.lit("-表格】\n"), table))).otherwise(_none()))

    return F.flatten(F.transform(sections, parts))


def whole_entry(intro: Column, sections: Column) -> Column:
    head = strip(F.coalesce(intro, F.lit("")))
    return F.array_join(F.concat(F.when(head != "", F.array(head)).otherwise(_none()), section_parts(sections)), "\n")


def summary(name: Column, pinyin: Column, latin: Column, category: Column, intro: Column, parent: Column) -> Column:
    """Labelled lines of what is known of an entry; NULL if they come to ten characters or less."""

    def labelled(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    name = F.coalesce(name, F.lit(""))
    first = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(F.lit("药品名称："), name, F.lit("（"), parent, F.lit("的子剂型）"))).otherwise(F.concat(F.lit("药品名称："), name))
    text = F.concat_ws("\n", first, labelled("拼音：", pinyin), labelled("拉丁名：", latin), labelled("分类：", category), labelled("概述：", strip(F.coalesce(intro, F.lit("")))))
    return F.when(F.length(text) > 10, text)


def route(name: Column, content: Column, table: Column) -> Column:
    """``skip``, ``clinical`` or ``detailed`` for a section; the first rule that fits wins."""
    content, table, name = F.coalesce(content, F.lit("")), F.coalesce(table, F.lit("")), F.coalesce(name, F.lit(""))
    merged = name.isin(*CLINICAL)
    return (
        F.when((content == "") & (table == ""), "skip")
        .when(merged & (F.length(content) < SHORT), "clinical")
        .when(name.isin(*DETAILED), F.when((F.length(content) + F.length(table) < LEAST) & ~name.isin(*UNMERGED), "clinical").otherwise("detailed"))
        .when(~merged, "detailed")
        .otherwise("clinical")
    )


_KIND = "array<struct<section:string,content:string,chunk_type:string,table_markdown:string>>"


def _chunk(kind: str, section: Column, content: Column, table: Column | None = None) -> Column:
    return F.struct(section.alias("section"), content.alias("content"), F.lit(kind).alias("chunk_type"), (F.lit(None).cast("string") if table is None else table).alias("table_markdown"))


def detailed_chunks(name: Column, content: Column, table: Column, limit: int = LIMIT) -> Column:
    """``array<struct<section, content, chunk_type, table_markdown>>`` of one detailed section.

    Each way of splitting is a fold that runs only where its case is reached.
    """
    text, tab = strip(F.coalesce(content, F.lit(""))), F.coalesce(table, F.lit(""))
    full = F.when(tab == "", text).when(text == "", tab).otherwise(F.concat(text, F.lit("\n\n"), tab))

    def windowed() -> Column:
        parts = sentences(text)
        label = lambda i: F.concat(name, F.lit("-段"), (i + 1).cast("string"))
        slices = F.transform(fixed_slices(text, limit), lambda p, i: _chunk("window", label(i), p))
        return F.when(F.size(parts) <= 1, slices).otherwise(F.transform(sliding_windows(parts, limit), lambda p: _chunk("window", name, p)))

    def split(kind: str, pieces: Column) -> Column:
        """Chunks of the pieces, NULL if there is only one."""
        chunks = F.transform(pieces, lambda p: _chunk(kind, name, p))
        return F.filter(F.array(chunks), lambda c: F.size(c) >= 2)

    items = F.try_element_at(F.when(name == "含量测定", split("assay_component", split_components(text))).when(name == "检查", split("check_item", split_items(text))), F.lit(1))
    return F.when(F.length(full) <= limit, F.array(_chunk("detailed", name, full, F.when(tab != "", tab)))).otherwise(F.coalesce(items, windowed()))


def chunk_entries(entries: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """All chunks of all entries: ``id_col, pos, section, content, chunk_type, table_markdown,
    char_count`` in emission order (summary, detailed sections, clinical chunks last).

    Three narrow branches, by kind of chunk, share the scan's columns; an entry meets its
    own chunks again only in their order, so nothing is shuffled here.
    """
    whole = is_whole(F.col("intro_text"), F.col("sections"))
    short = entries.filter(whole).select(F.col(id_col), F.lit(0).alias("part"), F.lit(0).alias("at"), F.array(_chunk("whole_entry", F.lit("完整条目"), whole_entry(F.col("intro_text"), F.col("sections")))).cast(_KIND).alias("chunks"))
    long = entries.filter(~whole)
    text = summary(F.col("drug_name"), F.col("pinyin_name"), F.col("latin_name"), F.col("category_hint"), F.col("intro_text"), F.col("parent_drug"))
    heads = long.withColumn("text", text).filter("text IS NOT NULL").select(F.col(id_col), F.lit(0).alias("part"), F.lit(0).alias("at"), F.array(_chunk("summary", F.lit("药品概要"), F.col("text"))).cast(_KIND).alias("chunks"))
    exploded = long.select(F.col(id_col), F.posexplode("sections").alias("at", "s")).select(id_col, "at", F.coalesce("s.section_name", F.lit("")).alias("name"), "s.content", "s.table_markdown")
    routed = exploded.withColumn("way", route(F.col("name"), F.col("content"), F.col("table_markdown"))).filter("way = 'detailed'")
    detailed = routed.select(F.col(id_col), F.lit(1).alias("part"), "at", detailed_chunks(F.col("name"), F.col("content"), F.col("table_markdown")).cast(_KIND).alias("chunks"))
    clinical = F.filter("sections", lambda s: (route(s["section_name"], s["content"], s["table_markdown"]) == "clinical") & (strip(F.coalesce(s["content"], F.lit(""))) != ""))
    parts = F.transform(clinical, lambda s: F.concat(F.lit("【"), F.coalesce(s["section_name"], F.lit("")), F.lit("】"), strip(s["content"])))
    merged = long.withColumn("packed", greedy_pack(parts)).select(F.col(id_col), F.lit(2).alias("part"), F.lit(0).alias("at"), F.transform("packed", lambda p: _chunk("clinical", F.lit("临床应用"), p)).cast(_KIND).alias("chunks"))
    every = short.unionByName(heads).unionByName(detailed).unionByName(merged)
    rows = every.select(id_col, "part", "at", F.posexplode("chunks").alias("piece", "c"))
    content = strip(F.col("c.content"))
    rows = rows.select(id_col, F.struct("part", "at", "piece").alias("pos"), "c.section", content.alias("content"), "c.chunk_type", "c.table_markdown")
    return rows.filter("content <> ''").withColumn("char_count", F.length("content"))


def sequential_ids(chunks: DataFrame, order: str = "entry_id", pos: str = "pos", bucket: int = 10_000) -> DataFrame:
    """Global ids ``chunk_000000…`` in (``order``, ``pos``) order without one global sort.

    Rows are counted per bucket of ``order``; the running sum over the few buckets gives each
    bucket its offset, and rows are numbered within their bucket.
    """
    bucketed = chunks.withColumn("_b", F.floor(F.col(order) / bucket))
    counts = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("_b").orderBy(order, pos))
    numbered = bucketed.withColumn("_r", within).join(offsets, "_b")
    return numbered.withColumn("chunk_seq", F.col("_before") + F.col("_r") - 1).withColumn("chunk_id", F.concat(F.lit("chunk_"), F.lpad(F.col("chunk_seq").cast("string"), 6, "0"))).drop("_b", "_r", "_before")


def statistics(chunks: DataFrame) -> DataFrame:
    """Counts per type with length statistics and five length classes."""
    n = F.col("char_count")

    def between(lo: int, hi: int, last: bool = False) -> Column:
        return F.sum(F.when((n >= lo) & ((n <= hi) if last else (n < hi)), 1).otherwise(0))

    return chunks.groupBy("chunk_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, 0.5).alias("median"),
        between(0, 100).alias("below_100"), between(100, 300).alias("below_300"), between(300, 600).alias("below_600"), between(600, 1000).alias("below_1000"), between(1000, 1500, True).alias("up_to_1500"),
    )
