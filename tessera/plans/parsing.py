"""Queries that parse prompts, wire records and model outputs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import jsonx
from tessera.functions import promptx as px
from tessera.functions import text as tx
from tessera.operators import corpus, scoring
from tessera.operators.catalog import first_occurrences
from tessera.plans.registry import Registry
from tessera.tables import table

R = Registry()


@R.add("select count(*) as n, count(distinct model_id) as models from export_user_chat_analysis where status = 1 and prompt <> '' and response not in ('', '{}')")
def source_predicate(spark, folder):
    return corpus.exportable(table(spark, folder, "export_user_chat_analysis")).agg(F.count("*").alias("n"), F.count_distinct("model_id").alias("models"))


def answers(df, key: str, response: str):
    """(key, answer) of wire records, null where there is none."""

    def run(batches):
        for batch in batches:
            texts = [jsonx.answer(jsonx.record(r)) for r in batch.column(1).to_pylist()]
            texts = [x if x and x.strip() else None for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "answer"])

    return df.select(key, response).mapInArrow(run, f"{key} long, answer string")


_ANSWER = r"""
with r as (select id, case when json_valid(response) then response::json end as j from export_user_chat_analysis),
a as (select id, j,
  coalesce(json_array_length(j, '$.choices'), 0) > 0 as d1, coalesce(json_array_length(j, '$.candidates'), 0) > 0 as d2,
  json_extract_string(j, '$.choices[0].message.content') as c1, json_extract_string(j, '$.choices[0].message.reasoning') as c2, json_extract_string(j, '$.choices[0].text') as c3,
  array_to_string(json_extract_string(j, '$.candidates[0].content.parts[*].text'), '') as c4,
  array_to_string(list_transform(list_filter(case when json_type(j, '$.content') = 'ARRAY' then json_extract(j, '$.content[*]') end, lambda x: coalesce(json_extract_string(x, '$.type'), 'text') = 'text'), lambda x: json_extract_string(x, '$.text')), '') as c5
  from r where json_type(j) = 'OBJECT'),
t as (select id, case when d1 then case when regexp_matches(c1, '\S') then c1 when regexp_matches(c2, '\S') then c2 when regexp_matches(c3, '\S') then c3 end
  when d2 then c4 else c5 end as answer from a)
select r.id, case when regexp_matches(regexp_replace(answer, '[\x{a0}\x{3000}\x{2000}-\x{200a}\x{85}]', '', 'g'), '\S') then md5(answer) end as answer_md5 from r left join t on t.id = r.id
"""


@R.add(_ANSWER)
def dialect_extract(spark, folder):
    return answers(table(spark, folder, "export_user_chat_analysis"), "id", "response").select("id", F.md5("answer").alias("answer_md5"))


@R.add()
def valid_output(spark, folder):
    """First calls of each prompt and answer whose answer is a strict object with a rolling_summary."""
    calls = corpus.exportable(table(spark, folder, "export_user_chat_analysis"))
    got = answers(calls, "id", "response").where("answer is not null")

    def strict(batches):
        for batch in batches:
            found = [jsonx.record(x) for x in batch.column("answer").to_pylist()]
            yield batch.filter(pa.array([o is not None and "rolling_summary" in o for o in found], pa.bool_()))

    kept = got.mapInArrow(strict, got.schema).join(calls.select("id", "prompt"), "id")
    return first_occurrences(kept, ["prompt", "answer"], "id").select("id", "content_hash")


@R.add(r"select doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) as norm_md5 from documents where text is not null and regexp_matches(text, '^[\x00-\x{24f}\x{2000}-\x{206f}]*$')")
def normalize_texts(spark, folder):
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull() & F.regexp_like("text", F.lit(r"^[\x00-\u024f\u2000-\u206f]*\z")))
    return docs.select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("norm_md5"))


_SECTION = r"regexp_extract(prompt, '(?ms)^##[ \t]+(?:{})[ \t\r]*$\n?(.*?)(?:^##[ \t]|\z)', 1)"


@R.add(
    "select row_no, length({0}) as user_chars, length({1}) as summary_chars, length({2}) as memory_chars, length({3}) as chat_chars, md5({0}) as user_md5 from split_dataset where prompt is not null".format(
        *(_SECTION.format("|".join(t)) for t in (px.USER_TITLES, px.SUMMARY_TITLES, px.MEMORY_TITLES, px.CHAT_TITLES))
    )
)
def prompt_sections(spark, folder):
    rows = table(spark, folder, "split_dataset").where("prompt is not null")
    part = lambda t: F.coalesce(px.section(F.col("prompt"), t), F.lit(""))
    return rows.select(
        "row_no", F.length(part(px.USER_TITLES)).alias("user_chars"), F.length(part(px.SUMMARY_TITLES)).alias("summary_chars"), F.length(part(px.MEMORY_TITLES)).alias("memory_chars"), F.length(part(px.CHAT_TITLES)).alias("chat_chars"), F.md5(part(px.USER_TITLES)).alias("user_md5")
    )


_NAMES = r"""
select row_no, regexp_extract(prompt, '(?m)^- Name:[ \t]*([^\n]*?),[ \t]*Gender:', 1) as user_name,
  regexp_extract(prompt, '(?m)^会话：[ \t]*([^\n]*?) - ([^\n]*?)[ \t]*$', 1) as session_user,
  regexp_extract(prompt, '(?m)^会话：[ \t]*([^\n]*?) - ([^\n]*?)[ \t]*$', 2) as persona_name from split_dataset where prompt is not null
"""


def _names(df):
    session = r"(?md)^会话：[ \t]*([^\n]*?) - ([^\n]*?)[ \t]*$"
    return df.select(
        "row_no", "prompt", F.regexp_extract("prompt", r"(?md)^- Name:[ \t]*([^\n]*?),[ \t]*Gender:", 1).alias("user_name"), F.regexp_extract("prompt", session, 1).alias("session_user"), F.regexp_extract("prompt", session, 2).alias("persona_name")
    )


@R.add(_NAMES)
def prompt_names(spark, folder):
    return _names(table(spark, folder, "split_dataset").where("prompt is not null")).drop("prompt")


_LINE = r"(?m)^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] ([^\n:]*?): ([^\n]*)$"


@R.add(
    rf"""
with l as (select row_no, regexp_extract(prompt, '(?m)^- Name:[ \t]*([^\n]*?),[ \t]*Gender:', 1) as user_name, regexp_extract(prompt, '(?m)^会话：[ \t]*([^\n]*?) - ([^\n]*?)[ \t]*$', 2) as persona_name,
  regexp_extract_all(prompt, '{_LINE}', 2) as speakers, regexp_extract_all(prompt, '{_LINE}', 3) as texts from split_dataset where prompt is not null)
select row_no, len(speakers) as n_lines, len(list_filter(speakers, lambda x: x = user_name)) as n_user, len(list_filter(speakers, lambda x: x = persona_name and x <> user_name)) as n_persona,
  len(list_filter(speakers, lambda x: x <> persona_name and x <> user_name)) as n_unknown, coalesce(list_sum(list_transform(texts, lambda x: length(x))), 0)::bigint as chat_chars from l
"""
)
def chat_lines(spark, folder):
    java = F.lit(_LINE.replace("(?m)", "(?md)"))
    named = _names(table(spark, folder, "split_dataset").where("prompt is not null"))
    rows = named.withColumn("speakers", F.regexp_extract_all("prompt", java, 2)).withColumn("texts", F.regexp_extract_all("prompt", java, 3))
    count = lambda f: F.size(F.filter("speakers", f)).cast("long")
    user, persona = F.col("user_name"), F.col("persona_name")
    return rows.select(
        "row_no", F.size("speakers").cast("long").alias("n_lines"), count(lambda x: x == user).alias("n_user"), count(lambda x: (x == persona) & (x != user)).alias("n_persona"),
        count(lambda x: (x != persona) & (x != user)).alias("n_unknown"), F.aggregate("texts", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chat_chars"),
    )


_VERSION = "case when contains(prompt[1:60], 'conversation analysis and memory') then 'v3-en' when contains(prompt[1:60], '对话分析与记忆') then 'v3-zh' when contains(prompt[1:60], 'AI对话分析专家') then 'v1-zh' else 'unknown' end"


@R.add(f"select {_VERSION} as version, count(*) as n from split_dataset where prompt is not null group by 1")
def template_versions(spark, folder):
    head = F.substring("prompt", 1, 60)
    version = F.when(head.contains("conversation analysis and memory"), "v3-en").when(head.contains("对话分析与记忆"), "v3-zh").when(head.contains("AI对话分析专家"), "v1-zh").otherwise("unknown")
    return table(spark, folder, "split_dataset").where("prompt is not null").groupBy(version.alias("version")).agg(F.count("*").alias("n"))


_KINDS = {"analysis_summary": "OBJECT", "user_intent": "OBJECT", "paid_reaction": "OBJECT", "ai_performance": "OBJECT", "rolling_summary": "VARCHAR", "memory_snapshot": "OBJECT"}
_COMPLETE = " and ".join(f"coalesce(json_type(j, '$.{k}') = '{v}', false)" for k, v in _KINDS.items())


@R.add(
    rf"""
with r as (select row_no, output::json as j from split_dataset where output is not null and json_valid(output) and json_type(output::json) = 'OBJECT'),
c as (select row_no, ({_COMPLETE}) as fields_complete,
  coalesce(json_type(j, '$.memory_snapshot') = 'OBJECT' and list_sort(json_keys(j, '$.memory_snapshot')) = ['active_events', 'avoid_topics', 'facts', 'open_loops', 'preferences'], false) as categories_ok,
  coalesce(json_type(j, '$.rolling_summary') = 'VARCHAR' and regexp_matches(json_extract_string(j, '$.rolling_summary'), '\S') and length(json_extract_string(j, '$.rolling_summary')) <= 2000, false) as length_ok from r)
select fields_complete, categories_ok, length_ok, count(*) as n from c group by all
"""
)
def rule_checks(spark, folder):
    rows = table(spark, folder, "split_dataset").where("output is not null")
    got = scoring.parsed(rows, "row_no", "output").where("checks.parseable")
    return got.groupBy(F.col("checks.fields_complete").alias("fields_complete"), F.col("checks.memory_categories_valid").alias("categories_ok"), F.col("checks.rolling_summary_length_ok").alias("length_ok")).agg(F.count("*").alias("n"))


@R.add()
def rule_tiers(spark, folder):
    """Structural score of every answer of the log, noise and all."""
    got = scoring.parsed(answers(table(spark, folder, "export_user_chat_analysis"), "id", "response"), "id", "answer")
    return got.groupBy(scoring.json_valid_score(F.col("checks")).alias("json_valid"), F.col("error").alias("error")).agg(F.count("*").alias("n"))


_LISTS = ("facts", "preferences", "avoid_topics", "active_events", "open_loops")


@R.add(
    "with r as (select row_no, output::json as j from split_dataset where output is not null and json_valid(output) and json_type(output::json) = 'OBJECT'), i as ("
    + " union all ".join(f"select row_no, '{k}' as category, unnest(json_extract(j, '$.memory_snapshot.{k}[*]')) as x from r where json_type(j, '$.memory_snapshot.{k}') = 'ARRAY'" for k in _LISTS)
    + "), t as (select row_no, category, case json_type(x) when 'VARCHAR' then x ->> '$' when 'OBJECT' then case when json_type(x, '$.content') = 'VARCHAR' then x ->> '$.content' end end as text from i) select category, count(*) as n, count(distinct text) as n_texts, sum(length(text))::bigint as chars from t where text is not null group by category"
)
def memory_items(spark, folder):
    got = scoring.parsed(table(spark, folder, "split_dataset").where("output is not null"), "row_no", "output")
    items = got.where("json is not null and error is null").select("row_no", F.explode("items").alias("i")).select("row_no", "i.*")
    return items.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"), F.sum(F.length("text")).alias("chars"))


def _memory(spark, folder):
    """(row_no, category, side, idx, text): memory in the prompt's old snapshot (student) and in the output (teacher)."""
    rows = table(spark, folder, "split_dataset").where("output is not null and prompt is not null")
    old = rows.select("row_no", F.concat(F.lit('{"memory_snapshot":'), px.section(F.col("prompt"), px.MEMORY_TITLES), F.lit("}")).alias("text"))
    place = lambda df, c: scoring.parsed(df, "row_no", c).select("row_no", F.posexplode("items").alias("idx", "i")).select("row_no", "i.category", "idx", "i.text")
    return place(rows, "output"), place(old, "text")


@R.add()
def memory_exact_matches(spark, folder):
    teacher, student = _memory(spark, folder)
    return scoring.exact_matches(teacher, student, ["row_no", "category"])


@R.add()
def memory_greedy_matches(spark, folder):
    """One-to-one matches of new to old memory items by word overlap above 0.5."""
    teacher, student = _memory(spark, folder)
    words = lambda df, s: df.select("row_no", "category", F.col("idx").alias(f"{s}_idx"), tx.word_set(F.col("text")).alias(s))
    both = words(teacher, "teacher").join(words(student, "student"), ["row_no", "category"])  # the items of one sample
    pairs = both.withColumn("sim", tx.jaccard(F.col("teacher"), F.col("student"))).where("sim > 0.5")
    return scoring.greedy_matches(pairs, ["row_no", "category"])


_SETS = "list_distinct(list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(lower({0}), '[一-鿿]+'), lambda r: case when length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda k: substr(r, k, 2)) end))))"


@R.add(
    f"""
with i as (select score_no, unnest(details.memory_details) as d from sample_score), t as (select score_no, d.text as text, d.matched_teacher_text as other from i where d is not null and d.text is not null and d.matched_teacher_text is not null),
w as (select score_no, {_SETS.format('text')} as a, {_SETS.format('other')} as b from t)
select score_no, count(*) as n, round(sum(case when len(a) = 0 then 0 else len(list_intersect(a, b)) / len(a)::double end), 6) as overlap, sum(len(a))::bigint as words from w group by score_no
"""
)
def word_overlap(spark, folder):
    items = table(spark, folder, "sample_score").select("score_no", F.explode("details.memory_details").alias("d")).where("d is not null and d.text is not null and d.matched_teacher_text is not null")
    rows = items.select("score_no", tx.overlap(F.col("d.text"), F.col("d.matched_teacher_text")).alias("o"), F.size(tx.word_set(F.col("d.text"))).alias("w"))
    return rows.groupBy("score_no").agg(F.count("*").alias("n"), F.round(F.sum("o"), 6).alias("overlap"), F.sum("w").alias("words"))
