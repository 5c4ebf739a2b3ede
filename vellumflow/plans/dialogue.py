"""Dialogue, answers, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.operators import answer, dialogue, models, pipeline, sessions
from vellumflow.session import latest, read_table
from vellumflow.streaming import sessions as streams

from .common import SPACE, any_sql, quoted, strip_sql
from .ranking import HYBRID_CTES, _docs


def _replies(spark, folder):
    return latest(read_table(spark, folder, "gen_responses"), "response_id")


def turns(spark, folder):
    """Question and reply of each response as two messages of its session."""
    r = _replies(spark, folder).filter("session_id IS NOT NULL")
    both = F.array(F.struct((F.col("response_id") * 2).alias("turn"), F.lit("user").alias("role"), F.col("query").alias("text")), F.struct((F.col("response_id") * 2 + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("raw_answer").alias("text")))
    return r.select(F.col("session_id").alias("conv_id"), F.explode(both).alias("m")).select("conv_id", "m.*")


def g01_guard(spark, folder):
    asked = turns(spark, folder).filter("role = 'user'")
    return dialogue.guard(asked, ("性状", "鉴别", "storage"), ("制法", "english")).select("conv_id", "turn", "verdict", "reason")


def g02_model_guard(spark, folder):
    """The model's word decides where no keyword and no trust does."""
    asked = turns(spark, folder).filter("role = 'user'")
    reply = F.when(F.contains("text", F.lit("贮藏")), "无关").otherwise("相关")
    return dialogue.guard(asked, ("性状",), ("制法",), reply).select("conv_id", "turn", "verdict", "reason")


def g04_trim_history(spark, folder):
    return dialogue.trim_history(turns(spark, folder)).select("conv_id", "turn", "role")


def g05_context_window(spark, folder):
    return dialogue.context_window(turns(spark, folder)).select("conv_id", "turn", "held")


def g06_pointer_detect(spark, folder):
    return _replies(spark, folder).select("response_id", dialogue.has_pointer(F.col("query"), ("请问", "它")).alias("points"))


def g07_pointer_resolve(spark, folder):
    t = turns(spark, folder).filter("role = 'user'")
    entity = F.nullif(F.regexp_extract("text", "([一-鿿]{3})的", 1), F.lit(""))
    return dialogue.resolve_pointers(t, entity, ("标准",)).select("conv_id", "turn", "resolved")


def g08_last_user(spark, folder):
    return dialogue.summary(turns(spark, folder)).select("conv_id", "last_query")


def g09_turns(spark, folder):
    return dialogue.summary(turns(spark, folder)).select("conv_id", "n_turns")


def _sourced(spark, folder):
    """Each result with its retrieved names and sections as sources."""
    r = latest(read_table(spark, folder, "query_results"), "result_id")
    names = F.coalesce("retrieved_drugs", F.array().cast("array<string>"))
    section = F.try_element_at("retrieved_sections", F.lit(1))
    return r.select("result_id", F.coalesce("answer", F.lit("")).alias("answer"), "query", names.alias("names"), F.transform(names, lambda n: section).alias("sections"), F.transform(names, lambda n: F.concat(n, F.lit(" 6g 3次"))).alias("contents"))


def g10_prompt(spark, folder):
    return _sourced(spark, folder).select("result_id", answer.prompt_context(F.col("names"), F.col("sections"), F.col("contents")).alias("context"))


def g10_messages(spark, folder):
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("你好").alias("content")))
    m = answer.messages("规则", history, F.lit("资料"), F.col("query"))
    return _sourced(spark, folder).select("result_id", F.size(m).alias("n"), m[2]["content"].alias("last"))


def g10_pointer_prompt(spark, folder):
    """The prompt that asks a model to resolve pointers, after the last messages of the session."""
    last = dialogue.trim_history(turns(spark, folder), 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    talk = answer.pointer_messages(F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), F.lit("它的贮藏"))
    return last.select("conv_id", talk[1]["content"].alias("prompt"))


def g10_no_result(spark, folder):
    m = answer.no_result_messages("规则", F.col("query"))
    return _sourced(spark, folder).select("result_id", F.size(m).alias("n"), m[1]["content"].alias("last"))


def g11_generate(spark, folder):
    return models.generate(_replies(spark, folder).select("response_id", "query"), "response_id", "query")


def g12_beautify(spark, folder):
    return _replies(spark, folder).select("response_id", answer.beautify(F.col("raw_answer")).alias("answer"))


def g13_citations(spark, folder):
    s = _sourced(spark, folder)
    cited = answer.citations(F.col("names"), F.col("sections"))
    return s.select("result_id", F.array_join(cited, ";").alias("citations"), answer.cite(F.col("answer"), cited).alias("answer"))


def g14_numeric_check(spark, folder):
    s = _sourced(spark, folder)
    return s.select("result_id", F.array_join(answer.unsupported(F.col("answer"), F.array_join("contents", " ")), ";").alias("issues"))


def g15_disclaimer(spark, folder):
    return _replies(spark, folder).select("response_id", answer.needs_disclaimer(F.col("raw_answer")).alias("needed"), answer.disclaim(F.col("raw_answer")).alias("answer"))


def g16_post_process(spark, folder):
    p = answer.post_process(F.col("answer"), F.col("names"), F.col("sections"), F.col("contents"))
    return _sourced(spark, folder).select("result_id", p.alias("p")).select("result_id", "p.answer", F.array_join("p.citations", ";").alias("citations"), F.size("p.issues").alias("n_issues"), "p.has_disclaimer")


def a04_sessions(spark, folder):
    e = read_table(spark, folder, "events")
    s = sessions.last_active(e, "user_id", "ts")
    return s.select("user_id", sessions.session_id(F.col("user_id")).alias("session_id"), "created_at", "last_active", "n_events")


def _sessions(spark, folder):
    s = sessions.last_active(read_table(spark, folder, "events"), "user_id", "ts")
    return s.withColumn("session_id", sessions.session_id(F.col("user_id")))


def a04_session_delete(spark, folder):
    """Sessions of users whose number ends in 7 are deleted."""
    s = _sessions(spark, folder)
    return sessions.delete(s, s.filter("user_id % 10 = 7")).select("user_id", "session_id")


def a04_session_get(spark, folder):
    s = _sessions(spark, folder)
    return sessions.get(s, s.filter("user_id IN (3, 4, 5)").select("session_id")).select("user_id", "n_events")


def a05_cleanup(spark, folder):
    return sessions.cleanup(_sessions(spark, folder), F.lit("2024-01-31 00:00:00").cast("timestamp")).select("user_id")


def a06_history(spark, folder):
    """Previews of the messages of one session."""
    t = turns(spark, folder)
    first = t.agg(F.min("conv_id").alias("conv_id"))
    return dialogue.preview(t.join(F.broadcast(first), "conv_id")).select("turn", "role", "preview")  # one row


def a05_session_expiry(spark, folder):
    s = sessions.last_active(read_table(spark, folder, "events"), "user_id", "ts")
    return sessions.expired(s, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("user_id", "is_expired")


def a05_session_windows(spark, folder):
    return streams.session_windows(read_table(spark, folder, "events"), "user_id", "ts", "6 hours")


def a06_preview(spark, folder):
    return dialogue.preview(turns(spark, folder)).select("conv_id", "turn", "preview")


def a07_validation(spark, folder):
    r = _replies(spark, folder)
    ok = sessions.valid_request(F.col("query"), F.col("latency"), F.length("raw_answer"), F.col("dialogue_turn"))
    return r.select("response_id", ok.alias("ok"))


def g01_guard_words(spark, folder):
    """All replies' questions by the full word lists."""
    asked = turns(spark, folder).filter("role = 'user'")
    return dialogue.guard(asked).select("conv_id", "turn", "verdict", "reason")


def g17_answer(spark, folder):
    """Every question of the replies from guard to checked answer, over all chunks."""
    r = _replies(spark, folder).select(F.col("response_id").alias("qid"), F.col("session_id").alias("conv_id"), F.col("response_id").alias("turn"), F.col("query").alias("text"))
    found = pipeline.answer_questions(r, _docs(spark, folder))
    return found.select("qid", "resolved", "verdict", "reason", "n_sources", "raw_answer", "answer", F.array_join("citations", ";").alias("citations"), F.array_join("issues", ";").alias("issues"), "has_disclaimer")


def g17_event_rows(spark, folder):
    rows = streams.event_rows(_replies(spark, folder).filter("raw_answer <> ''"), "response_id", "raw_answer")
    return rows.filter("kind = 'content'").select("response_id", "seq", "payload")


QUERIES = {f.__name__: f for f in (g01_guard, g01_guard_words, g02_model_guard, g04_trim_history, g05_context_window, g06_pointer_detect, g07_pointer_resolve, g08_last_user, g09_turns, g10_prompt, g10_messages, g10_pointer_prompt, g10_no_result, g11_generate, g12_beautify, g13_citations, g14_numeric_check, g15_disclaimer, g16_post_process, g17_answer, g17_event_rows, a04_sessions, a04_session_delete, a04_session_get, a05_cleanup, a06_history, a05_session_expiry, a05_session_windows, a06_preview, a07_validation)}

_REPLIES = "(SELECT * FROM gen_responses QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY loaded_at DESC) = 1)"
_TURNS = f"(SELECT session_id AS conv_id, response_id * 2 AS turn, 'user' AS role, query AS text FROM {_REPLIES} WHERE session_id IS NOT NULL UNION ALL SELECT session_id, response_id * 2 + 1, 'assistant', raw_answer FROM {_REPLIES} WHERE session_id IS NOT NULL)"
_ON, _OFF = "regexp_matches(t, '(?i)性状|鉴别|storage')", "regexp_matches(t, '(?i)制法|english')"
_SOURCED = "(SELECT result_id, coalesce(answer, '') AS answer, query, coalesce(retrieved_drugs, []) AS names, retrieved_sections[1] AS section FROM (SELECT * FROM query_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1))"
_SUFFIX = "CASE WHEN coalesce(section, '') <> '' THEN '-' || section ELSE '' END"
_CITES = f"list_transform(list_filter(names, lambda n, i: coalesce(n, '') <> '' AND list_position(names, n) = i), lambda n: '药典-' || n || {_SUFFIX})"
_QTY = "(?i)[0-9]+\\.?[0-9]*\\s*(?:mg|g|ml|μg|ug|片|粒|丸|次|日|%)"


def _issues(a: str, c: str) -> str:
    return f"list_sort(list_filter(list_distinct(regexp_extract_all({a}, '{_QTY}')), lambda q: NOT list_contains(regexp_extract_all({c}, '{_QTY}'), q) AND lower(trim(q)) NOT IN ('100%', '100 %')))"


def _rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+$', '')"


def _beauty(x: str) -> str:
    return f"regexp_replace(regexp_replace({strip_sql(x)}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \\t　]+$', '', 'g')"


def _cite(a: str) -> str:
    lines = f"array_to_string(list_transform({_CITES}, lambda c, i: '- [' || i || '] ' || c || chr(10)), '')"
    return f"CASE WHEN contains({a}, '来源：') OR contains({a}, '出处') OR len({_CITES}) = 0 THEN {a} ELSE {_rstrip(a)} || chr(10) || chr(10) || '**参考来源：**' || chr(10) || {lines} END"


_MEDICAL = lambda x: any_sql(x, answer.MEDICAL)


def _disclaim(x: str) -> str:
    return f"CASE WHEN {_MEDICAL(x)} AND NOT contains({x}, {quoted(answer.DISCLAIMER)}) THEN {_rstrip(x)} || chr(10) || chr(10) || {quoted(answer.DISCLAIMER)} ELSE {x} END"


_CONTENTS = "array_to_string(list_transform(names, lambda n: n || ' 6g 3次'), ' ')"

def _verdicts(turns: str, key: str) -> str:
    """``reason`` and ``verdict`` by the full lists of ``key, conv_id, turn, text`` rows."""
    on, off = any_sql("lower(t)", [w.lower() for w in dialogue.ON_TOPIC]), any_sql("lower(t)", dialogue.OFF_TOPIC)
    return f"""SELECT *, CASE WHEN reason IN ('empty', 'off_topic') THEN 'reject' ELSE 'pass' END AS verdict FROM (
SELECT {key}, conv_id, turn, text, CASE WHEN t = '' THEN 'empty' WHEN {on} THEN 'on_topic' WHEN {off} THEN 'off_topic' WHEN tr = 1 THEN 'trusted' ELSE 'default' END AS reason FROM (
SELECT *, coalesce(max(CASE WHEN t <> '' AND {on} THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tr FROM (SELECT *, coalesce(trim(text), '') AS t FROM ({turns}))))"""


_USER = quoted("user")
_POINTER = "|".join(sorted(dialogue.POINTERS, key=len, reverse=True))
_PER_SOURCE = "'[' || rank || '] 药品：' || coalesce(name, '') || CASE WHEN coalesce(section, '') <> '' THEN '，章节：' || section ELSE '' END || chr(10) || " + strip_sql("coalesce(content, '')")
_LISTED = _cite("raw1").replace(_CITES, "cites")
_ANSWER = f"""WITH qs AS (SELECT response_id AS qid, coalesce(session_id, 'qid ' || response_id) AS conv_id, response_id AS turn, coalesce(query, '') AS text FROM {_REPLIES}),
en AS (SELECT DISTINCT drug_name AS name FROM chunks WHERE drug_name <> ''), ef AS (SELECT qid, name FROM qs, en WHERE contains(lower(text), name)),
eo AS (SELECT qid, name FROM ef WHERE NOT EXISTS (SELECT 1 FROM ef AS g WHERE g.qid = ef.qid AND length(g.name) > length(ef.name) AND contains(g.name, ef.name)) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY length(name) DESC, name) = 1),
ju AS ({_verdicts('SELECT * FROM qs', 'qid')}),
la AS (SELECT ju.*, last_value(eo.name IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM ju LEFT JOIN eo USING (qid)),
re AS (SELECT *, CASE WHEN {any_sql('text', dialogue.POINTERS)} AND l IS NOT NULL AND length(regexp_replace(text, '{_POINTER}', l, 'g')) < 3 * length(text) THEN regexp_replace(text, '{_POINTER}', l, 'g') ELSE text END AS resolved FROM la),
pq AS (SELECT qid, resolved AS query FROM re WHERE verdict = 'pass'),
{HYBRID_CTES.replace('@asked', 'pq')},
so AS (SELECT qid, count(*) AS n, string_agg({_PER_SOURCE}, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(coalesce(content, ''), ' ' ORDER BY rank) AS contents, list('药典-' || name || CASE WHEN coalesce(section, '') <> '' THEN '-' || section ELSE '' END ORDER BY rank) FILTER (coalesce(name, '') <> '') AS c0 FROM found GROUP BY qid),
rw AS (SELECT pq.qid, coalesce(n, 0) AS n_sources, contents, list_filter(coalesce(c0, []), lambda c, i: list_position(c0, c) = i) AS cites, '根据参考资料：' || right('system: ' || {quoted(pipeline.SYSTEM)} || chr(10) || chr(10) || 'user: 【参考资料】' || chr(10) || coalesce(context, {quoted(answer.NO_CONTEXT)}) || chr(10) || chr(10) || '【问题】' || chr(10) || query, 200) AS raw_answer FROM pq LEFT JOIN so USING (qid)),
r1 AS (SELECT *, {_beauty('raw_answer')} AS raw1 FROM rw), r2 AS (SELECT *, {_LISTED} AS listed FROM r1), r3 AS (SELECT *, {_disclaim('listed')} AS final FROM r2)
SELECT re.qid, CASE WHEN verdict = 'pass' THEN resolved ELSE text END AS resolved, verdict, reason, coalesce(n_sources, 0)::INT AS n_sources, CASE WHEN verdict = 'pass' THEN raw_answer ELSE {quoted(pipeline.REJECTED)} END AS raw_answer,
CASE WHEN verdict <> 'pass' THEN {quoted(pipeline.REJECTED)} WHEN n_sources = 0 THEN raw_answer ELSE final END AS answer, CASE WHEN n_sources > 0 THEN array_to_string(cites, ';') ELSE '' END AS citations,
CASE WHEN n_sources > 0 THEN array_to_string({_issues('listed', 'contents')}, ';') ELSE '' END AS issues, coalesce(n_sources > 0 AND contains(final, {quoted(answer.DISCLAIMER)}), false) AS has_disclaimer FROM re LEFT JOIN r3 USING (qid)"""

SQL = {
    "g01_guard_words": f"SELECT conv_id, turn, verdict, reason FROM ({_verdicts(f'SELECT 0 AS k, * FROM {_TURNS} WHERE role = {_USER}', 'k')})",
    "g17_answer": _ANSWER,
    "g10_pointer_prompt": f"SELECT conv_id, '根据对话历史，把问题中的指代词换成所指的药名；没有指代词时原样输出。' || chr(10) || chr(10) || '【对话历史】' || chr(10) || string_agg(CASE WHEN role = 'user' THEN '用户: ' ELSE '助手: ' END || coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) || chr(10) || '【问题】' || chr(10) || '它的贮藏' AS prompt FROM (SELECT * FROM {_TURNS} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY 1",
    "g10_no_result": f"SELECT result_id, 2 AS n, '【参考资料】' || chr(10) || {quoted(answer.NO_CONTEXT)} || chr(10) || chr(10) || '【问题】' || chr(10) || query AS last FROM {_SOURCED}",
    "a04_session_delete": "SELECT DISTINCT user_id, 'sess_' || substr(sha256(user_id::VARCHAR), 1, 12) AS session_id FROM events WHERE user_id % 10 <> 7",
    "a04_session_get": "SELECT user_id, count(*) AS n_events FROM events WHERE user_id IN (3, 4, 5) GROUP BY 1",
    "a05_cleanup": "SELECT user_id FROM events GROUP BY 1 HAVING TIMESTAMP '2024-01-31 00:00:00' - max(ts)::TIMESTAMP <= INTERVAL 24 HOURS",
    "a06_history": f"SELECT turn, role, substr(text, 1, 200) AS preview FROM {_TURNS} WHERE conv_id = (SELECT min(conv_id) FROM {_TURNS})",
    "g01_guard": f"""WITH a AS (SELECT conv_id, turn, coalesce(trim(text), '') AS t FROM {_TURNS} WHERE role = 'user'), b AS (SELECT *, coalesce(max(CASE WHEN t <> '' AND {_ON} THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tr FROM a),
c AS (SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN {_ON} THEN 'on_topic' WHEN {_OFF} THEN 'off_topic' WHEN tr = 1 THEN 'trusted' ELSE 'default' END AS reason FROM b) SELECT *, CASE WHEN reason IN ('empty', 'off_topic') THEN 'reject' ELSE 'pass' END AS verdict FROM c""",
    "g02_model_guard": f"""WITH a AS (SELECT conv_id, turn, text, coalesce(trim(text), '') AS t FROM {_TURNS} WHERE role = 'user'), b AS (SELECT *, coalesce(max(CASE WHEN contains(t, '性状') THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tr FROM a),
c AS (SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN contains(t, '性状') THEN 'on_topic' WHEN contains(t, '制法') THEN 'off_topic' WHEN tr = 1 THEN 'trusted' WHEN contains(text, '贮藏') THEN 'model' ELSE 'default' END AS reason FROM b) SELECT *, CASE WHEN reason IN ('empty', 'off_topic', 'model') THEN 'reject' ELSE 'pass' END AS verdict FROM c""",
    "g04_trim_history": f"SELECT conv_id, turn, role FROM {_TURNS} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10",
    "g05_context_window": f"SELECT * FROM (SELECT conv_id, turn, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS held FROM {_TURNS}) WHERE held <= 4096",
    "g06_pointer_detect": f"SELECT response_id, contains(query, '请问') OR contains(query, '它') AS points FROM {_REPLIES}",
    "g07_pointer_resolve": f"SELECT conv_id, turn, CASE WHEN contains(text, '标准') AND l IS NOT NULL AND length(replace(text, '标准', l)) < 3 * length(text) THEN replace(text, '标准', l) ELSE text END AS resolved FROM (SELECT *, last_value(nullif(regexp_extract(text, '([一-鿿]{{3}})的', 1), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM {_TURNS} WHERE role = 'user')",
    "g08_last_user": f"SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_query FROM {_TURNS} GROUP BY 1",
    "g09_turns": f"SELECT conv_id, count(*) // 2 AS n_turns FROM {_TURNS} GROUP BY 1",
    "g10_prompt": f"SELECT result_id, CASE WHEN len(names) > 0 THEN array_to_string(list_transform(names, lambda n, i: '[' || i || '] 药品：' || coalesce(n, '') || CASE WHEN coalesce(section, '') <> '' THEN '，章节：' || section ELSE '' END || chr(10) || n || ' 6g 3次'), chr(10) || chr(10)) ELSE {quoted(answer.NO_CONTEXT)} END AS context FROM {_SOURCED}",
    "g10_messages": f"SELECT result_id, 3 AS n, '【参考资料】' || chr(10) || '资料' || chr(10) || chr(10) || '【问题】' || chr(10) || query AS last FROM {_SOURCED}",
    "g11_generate": f"SELECT response_id, '根据参考资料：' || right(coalesce(query, ''), 200) AS answer, NULL::VARCHAR AS error FROM {_REPLIES}",
    "g12_beautify": f"SELECT response_id, {_beauty('raw_answer')} AS answer FROM {_REPLIES}",
    "g13_citations": f"SELECT result_id, array_to_string({_CITES}, ';') AS citations, {_cite('answer')} AS answer FROM {_SOURCED}",
    "g14_numeric_check": f"SELECT result_id, array_to_string({_issues('answer', _CONTENTS)}, ';') AS issues FROM {_SOURCED}",
    "g15_disclaimer": f"SELECT response_id, {_MEDICAL('raw_answer')} AS needed, {_disclaim('raw_answer')} AS answer FROM {_REPLIES}",
    "g16_post_process": f"WITH c AS (SELECT *, {_cite(_beauty('answer'))} AS listed FROM {_SOURCED}), d AS (SELECT *, {_disclaim('listed')} AS final FROM c) SELECT result_id, CASE WHEN len(names) = 0 THEN answer ELSE final END AS answer, CASE WHEN len(names) = 0 THEN '' ELSE array_to_string({_CITES}, ';') END AS citations, CASE WHEN len(names) = 0 THEN 0 ELSE len({_issues('listed', _CONTENTS)}) END::INT AS n_issues, len(names) > 0 AND contains(final, {quoted(answer.DISCLAIMER)}) AS has_disclaimer FROM d",
    "g17_event_rows": f"SELECT response_id, (i // 50)::INT AS seq, substr(raw_answer, i + 1, 50) AS payload FROM (SELECT response_id, raw_answer, unnest(range(0, length(raw_answer), 50))::INT AS i FROM {_REPLIES} WHERE raw_answer <> '')",
    "a04_sessions": "SELECT user_id, 'sess_' || substr(sha256(user_id::VARCHAR), 1, 12) AS session_id, min(ts) AS created_at, max(ts) AS last_active, count(*) AS n_events FROM events GROUP BY 1",
    "a05_session_expiry": "SELECT user_id, TIMESTAMP '2024-01-31 00:00:00' - max(ts)::TIMESTAMP > INTERVAL 24 HOURS AS is_expired FROM events GROUP BY 1",
    "a05_session_windows": "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM o) SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 6 HOURS AS expires_at, count(*) AS n_events FROM s GROUP BY user_id, no",
    "a06_preview": f"SELECT conv_id, turn, substr(text, 1, 200) AS preview FROM {_TURNS}",
    "a07_validation": f"SELECT response_id, coalesce(length(query) BETWEEN 1 AND 500, false) AND coalesce(latency BETWEEN 0 AND 2, true) AND coalesce(length(raw_answer) BETWEEN 100 AND 8192, true) AND coalesce(dialogue_turn BETWEEN 1 AND 30, true) AS ok FROM {_REPLIES}",
}
