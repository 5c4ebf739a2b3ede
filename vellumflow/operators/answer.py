"""Prompts and post-checks of answers, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumflow.functions.text import any_of, strip

#: Quantities compared with the sources, and words that ask for a disclaimer.
QUANTITY = "(?i)[0-9]+\\.?[0-9]*\\s*(?:mg|g|ml|μg|ug|片|粒|丸|次|日|%)"
USUAL = ("100%", "100 %")
MEDICAL = ("用法", "用量", "服用", "用药", "剂量", "口服", "外用", "注射", "慎用", "禁用", "注意事项", "不良反应")
DISCLAIMER = "具体用药请遵医嘱。"
NO_CONTEXT = "（未检索到相关内容）"


def beautify(answer: Column) -> Column:
    """Stripped, at most one empty line in a row, no blanks at line ends."""
    return F.regexp_replace(F.regexp_replace(strip(answer), "\\n{3,}", "\n\n"), "(?md)[ \\t　]+$", "")


def citations(names: Column, sections: Column, work: str = "药典") -> Column:
    """``work-name[-section]`` per source in order, each once; sources without a name give none."""
    pairs = F.arrays_zip(names.alias("n"), sections.alias("s"))
    named = F.filter(pairs, lambda p: F.coalesce(p["n"], F.lit("")) != "")
    return F.array_distinct(F.transform(named, lambda p: F.concat(F.lit(work + "-"), p["n"], F.when(F.coalesce(p["s"], F.lit("")) != "", F.concat(F.lit("-"), p["s"])).otherwise(""))))


def cite(answer: Column, cited: Column) -> Column:
    """The answer with a numbered list of its sources, unless it names its sources already."""
    lines = F.transform(cited, lambda c, i: F.concat(F.lit("- ["), (i + 1).cast("string"), F.lit("] "), c, F.lit("\n")))
    listed = F.concat(F.regexp_replace(answer, "(?U)\\s+$", ""), F.lit("\n\n**参考来源：**\n"), F.array_join(lines, ""))
    return F.when(F.contains(answer, F.lit("来源：")) | F.contains(answer, F.lit("出处")) | (F.size(cited) == 0), answer).otherwise(listed)


def quantities(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0)))


def unsupported(answer: Column, context: Column) -> Column:
    """Quantities of the answer that the context does not hold, compared as strings."""
    found = F.array_except(quantities(answer), quantities(context))
    return F.array_sort(F.filter(found, lambda q: ~F.lower(F.trim(q)).isin(*USUAL)))


def needs_disclaimer(answer: Column, words: Sequence[str] = MEDICAL) -> Column:
    return any_of(answer, words)


def disclaim(answer: Column, text: str = DISCLAIMER) -> Column:
    missing = needs_disclaimer(answer) & ~F.contains(answer, F.lit(text))
    return F.when(missing, F.concat(F.regexp_replace(answer, "(?U)\\s+$", ""), F.lit("\n\n" + text))).otherwise(answer)


def post_process(answer: Column, names: Column, sections: Column, contents: Column) -> Column:
    """``struct<answer, citations, issues, has_disclaimer>``: beautified, cited, checked on the
    cited text, disclaimed. Without sources the answer stays as it is."""
    cited = citations(names, sections)
    listed = cite(beautify(answer), cited)
    issues = unsupported(listed, F.array_join(contents, " "))
    final = disclaim(listed)
    none = F.size(names) == 0
    empty = F.array().cast("array<string>")
    return F.struct(F.when(none, answer).otherwise(final).alias("answer"), F.when(none, empty).otherwise(cited).alias("citations"), F.when(none, empty).otherwise(issues).alias("issues"), (~none & F.contains(final, F.lit(DISCLAIMER))).alias("has_disclaimer"))


def prompt_context(names: Column, sections: Column, contents: Column) -> Column:
    """Numbered sources with name and section; a fixed phrase if there are none."""
    rows = F.arrays_zip(names.alias("n"), sections.alias("s"), contents.alias("c"))
    parts = F.transform(rows, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] 药品："), F.coalesce(r["n"], F.lit("")), F.when(F.coalesce(r["s"], F.lit("")) != "", F.concat(F.lit("，章节："), r["s"])).otherwise(""), F.lit("\n"), strip(F.coalesce(r["c"], F.lit("")))))
    return F.when(F.size(names) > 0, F.array_join(parts, "\n\n")).otherwise(NO_CONTEXT)


def messages(system: str, history: Column, context: Column, query: Column) -> Column:
    """``array<struct<role, content>>``: system, history, then the question with its context."""
    ask = F.concat(F.lit("【参考资料】\n"), context, F.lit("\n\n【问题】\n"), query)
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), history, F.array(F.struct(F.lit("user").alias("role"), ask.alias("content"))))


def pointer_messages(history: Column, query: Column, system: str = "只输出改写后的问题。") -> Column:
    """Messages that ask a model to put names in place of words that point back; ``history`` is
    an array of ``role, content``."""
    line = lambda m: F.concat(F.when(m["role"] == "user", F.lit("用户: ")).otherwise(F.lit("助手: ")), F.coalesce(m["content"], F.lit("")))
    told = F.array_join(F.transform(history, line), "\n")
    ask = F.concat(F.lit("根据对话历史，把问题中的指代词换成所指的药名；没有指代词时原样输出。\n\n【对话历史】\n"), told, F.lit("\n\n【问题】\n"), query)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), ask.alias("content")))


def no_result_messages(system: str, query: Column) -> Column:
    """Messages of a question for which nothing was found."""
    return messages(system, F.array().cast("array<struct<role:string,content:string>>"), F.lit(NO_CONTEXT), query)
