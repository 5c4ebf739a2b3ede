"""From questions to checked answers, for a table of conversations at once.

Guard, pointers, search, prompt, model, post-processing: every step is a table operator keyed
by the question. Questions that the guard rejects are neither searched nor sent to the model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.session import cut

from . import answer, dialogue, models, queryparse, retrieve

#: What the model is told, and what a rejected question gets; both are parameters.
SYSTEM = "只依据参考资料回答，并注明出处；资料中没有的内容请说明没有。"
REJECTED = "这个问题不在本系统的范围内，请换一个与药品有关的问题。"


def answer_questions(questions: DataFrame, docs: DataFrame, chat: Callable | None = None, vectors: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, history: DataFrame | None = None, on_topic: Sequence[str] = dialogue.ON_TOPIC, off_topic: Sequence[str] = dialogue.OFF_TOPIC, system: str = SYSTEM, rejected: str = REJECTED, id_col: str = "chunk_seq", name_col: str = "drug_name", **search: object) -> DataFrame:
    """``qid, query, resolved, verdict, reason, n_sources, raw_answer, answer, citations, issues,
    has_disclaimer, error`` of every question.

    ``questions`` has ``qid, conv_id, turn, text``; a NULL conversation is one by itself.
    ``history`` (``qid, history``, an array of ``role, content``) goes between the system
    message and the question; more arguments go to the search. An empty question is rejected
    like one outside the domain.
    """
    turns = questions.select("qid", F.coalesce("conv_id", F.concat(F.lit("qid "), F.col("qid").cast("string"))).alias("conv_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    names = docs.select(name_col).filter(F.col(name_col).isNotNull()).distinct()
    found = queryparse.entities(turns.select("qid", F.col("text").alias("query")), names, name_col).select("qid", F.col("names")[0].alias("_entity"))
    judged = dialogue.guard(turns.join(found, "qid", "left"), on_topic, off_topic)
    asked = cut(dialogue.resolve_pointers(judged, F.col("_entity")).select("qid", F.col("text").alias("query"), "resolved", "verdict", "reason"))
    # questions of one text are searched once, unless names are given by question
    once = F.min("qid").over(Window.partitionBy("resolved")) if search.get("given_names") is None else F.col("qid")
    passes = F.col("verdict") == "pass"
    passed = cut(asked.filter(passes).select("qid", "resolved").withColumn("gid", once))
    results = retrieve.hybrid_search(passed.filter("qid = gid").select("qid", F.col("resolved").alias("query")), docs, vectors, embed, id_col=id_col, name_col=name_col, **search)
    rows = F.array_sort(F.collect_list(F.struct("rank", "name", "section", "content")))
    sources = results.select(F.col("qid").alias("gid"), "rank", "name", "section", "content").groupBy("gid").agg(rows.alias("sources"))
    none = F.array().cast("array<struct<rank:int,name:string,section:string,content:string>>")
    ready = asked.join(passed.select("qid", "gid"), "qid", "left").join(sources, "gid", "left").withColumn("sources", F.coalesce("sources", none))
    ready = ready.join(history, "qid", "left") if history is not None else ready.withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>"))
    field = lambda f: F.transform("sources", lambda s: s[f])
    talk = answer.messages(system, F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")), answer.prompt_context(field("name"), field("section"), field("content")), F.col("resolved"))
    prompt = F.when(passes, F.array_join(F.transform(talk, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n"))
    # the sources stay beside the prompt: neither is written nor joined again
    kept = ["qid", "query", "resolved", "verdict", "reason"]
    done = ready.select(*kept, "sources", models.said(prompt, chat or models.echo_chat).alias("said")).select(*kept, "sources", F.col("said.answer").alias("raw_answer"), "said.error")
    processed = F.when(passes, answer.post_process(F.col("raw_answer"), field("name"), field("section"), field("content")))
    out = done.select(*kept, "raw_answer", "error", F.when(passes, F.size("sources")).alias("n_sources"), processed.alias("p")).select(*kept, "raw_answer", "error", "n_sources", "p.*")
    empty = F.array().cast("array<string>")
    return out.select(
        "qid", "query", F.when(passes, F.col("resolved")).otherwise(F.col("query")).alias("resolved"), "verdict", "reason", F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.when(passes, F.col("raw_answer")).otherwise(rejected).alias("raw_answer"), F.when(passes, F.col("answer")).otherwise(rejected).alias("answer"),
        F.coalesce("citations", empty).alias("citations"), F.coalesce("issues", empty).alias("issues"), F.coalesce("has_disclaimer", F.lit(False)).alias("has_disclaimer"), "error",
    )
