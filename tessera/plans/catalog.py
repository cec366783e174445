"""Queries over the catalog: orders stand for batches, their lines for tasks, parts for prompts, suppliers for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog as c
from tessera.operators import tasks as t
from tessera.plans.registry import Registry
from tessera.sources.sinks import chat_payload, validate
from tessera.tables import table

R = Registry()

_COUNTERS = """
with counters as (
  select l_orderkey, count(*) as total_tasks,
    count(*) filter (where l_linestatus = 'F') as succeed_tasks,
    count(*) filter (where l_linestatus = 'O' and l_returnflag = 'N') as failed_tasks
  from lineitem group by l_orderkey),
marked as (
  select *, succeed_tasks + failed_tasks as completed_tasks,
    case when succeed_tasks + failed_tasks >= total_tasks
         then case when failed_tasks = 0 then 'COMPLETED' when succeed_tasks = 0 then 'FAILED' else 'PARTIAL' end
         when succeed_tasks + failed_tasks > 0 then 'RUNNING' else 'PENDING' end as status
  from counters)
"""


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag")
    return c.batches(lines, "l_orderkey", F.col("l_linestatus") == "F", (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"))


@R.add(_COUNTERS + "select l_orderkey, o_orderpriority, total_tasks, succeed_tasks, failed_tasks, completed_tasks, status from marked join orders on o_orderkey = l_orderkey")
def batch_status_derived(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return _batches(spark, folder).join(orders, "l_orderkey").select("l_orderkey", "o_orderpriority", "total_tasks", "succeed_tasks", "failed_tasks", "completed_tasks", "status")


@R.add(_COUNTERS + "select l_orderkey, status, cast(round(succeed_tasks * 100.0 / total_tasks) as integer) as progress, (select count(*) from marked where status = 'PARTIAL') as total from marked where status = 'PARTIAL' order by l_orderkey desc limit 20 offset 20")
def batch_status_page(spark, folder):
    partial = _batches(spark, folder).where("status = 'PARTIAL'")
    rows = c.with_total(partial, [F.col("l_orderkey").desc()], 2, 20)
    return rows.select("l_orderkey", "status", c.progress(F.col("succeed_tasks"), F.col("total_tasks")).alias("progress"), "total")


@R.add("select p_partkey, p_name, p_brand, count(*) over () as total from part where p_name ilike '%1%' or p_brand ilike '%#2%' order by p_partkey desc limit 25 offset 25")
def page_search_desc(spark, folder):
    found = c.search(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand"), None, "p_name")
    found = found.where(F.col("p_name").ilike("%1%") | F.col("p_brand").ilike("%#2%"))
    return c.with_total(found, [F.col("p_partkey").desc()], 2, 25)


@R.add("select p_partkey, p_name, p_brand from part where p_name ilike '%an%' or p_brand ilike '%an%'")
def search_columns(spark, folder):
    return c.search(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand"), "an", "p_name", "p_brand")


@R.add("select distinct o_orderpriority as category from orders")
def category_distinct(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderpriority").alias("category")).distinct().orderBy("category")


@R.add("select c_custkey, c_mktsegment, coalesce(n, 0) as n_references from customer left join (select o_custkey, count(*) as n from orders group by o_custkey) on o_custkey = c_custkey")
def reference_guard(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return c.referenced(customers, "c_custkey", table(spark, folder, "orders"), "o_custkey").select("c_custkey", "c_mktsegment", "n_references")


@R.add("select c_custkey, c_nationkey from customer where not (c_nationkey = 5 and c_custkey not in (select o_custkey from orders))")
def all_or_none_delete(spark, folder):
    customers, orders = table(spark, folder, "customer").select("c_custkey", "c_nationkey"), table(spark, folder, "orders").select("o_custkey")
    ids = customers.where("c_nationkey = 5").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
    return c.delete_all_or_none(customers, "c_custkey", ids, orders, "o_custkey")


@R.add("select distinct l_partkey % 40 * 7 as s_suppkey from lineitem where l_partkey % 40 * 7 not in (select s_suppkey from supplier)")
def set_completeness(spark, folder):
    wanted = table(spark, folder, "lineitem").select((F.col("l_partkey") % 40 * 7).alias("s_suppkey"))
    return c.missing(table(spark, folder, "supplier"), "s_suppkey", wanted)


@R.add("select row_number() over (order by p_partkey, m.id) as task_no, p_partkey as prompt_id, m.id as model_id from part, model_config m")
def task_cross_product(spark, folder):
    return c.tasks_for(table(spark, folder, "model_config"), table(spark, folder, "part"), "id", "p_partkey")


@R.add("select status, count(*) as n from export_user_chat_analysis group by status")
def status_counts(spark, folder):
    return table(spark, folder, "export_user_chat_analysis").groupBy("status").agg(F.count("*").alias("n"))


@R.add("select count(*) filter (where status = 1) as succeeded, count(*) filter (where status = 0) as failed, cast(format('{:.4f}', count(*) filter (where status = 1) * 1.0::double / count(*)) as double) as rate from export_user_chat_analysis where status in (0, 1)")
def dashboard_rate(spark, folder):
    return c.success_rate(table(spark, folder, "export_user_chat_analysis"), F.col("status") == 1, F.col("status") == 0)


@R.add("select count(*) filter (where enabled) as enabled_models, count(*) as models, count(distinct provider) as providers from model_config")
def dashboard_models(spark, folder):
    return table(spark, folder, "model_config").agg(F.count_if("enabled").alias("enabled_models"), F.count("*").alias("models"), F.count_distinct("provider").alias("providers"))


@R.add("select o_orderkey, o_orderstatus from orders order by o_orderkey desc limit 10")
def recent_batches(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus").orderBy(F.desc("o_orderkey")).limit(10)


@R.add(
    """
with groups as (select distinct l_partkey from lineitem order by 1 limit 30 offset 30),
rows as (select l_partkey, p_name, l_suppkey, s_name, l_orderkey, l_linenumber, l_returnflag from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where l_partkey in (from groups))
select l_partkey, p_name, count(*) as n_results, count(distinct l_suppkey) as n_models,
  string_agg(l_suppkey || ':' || s_name || ':' || l_returnflag, ';' order by l_suppkey, l_orderkey, l_linenumber) as results
from rows group by l_partkey, p_name"""
)
def batch_detail_grouped(spark, folder):
    lines = c.page_of_groups(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag"), "l_partkey", 2, 30)
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    models = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rows = lines.join(parts, "l_partkey").join(models, "l_suppkey")
    text = F.concat_ws(":", F.col("l_suppkey").cast("string"), "s_name", "l_returnflag")
    folded = F.array_sort(F.collect_list(F.struct("l_suppkey", "l_orderkey", "l_linenumber", text.alias("text"))))
    got = rows.groupBy("l_partkey", "p_name").agg(F.count("*").alias("n_results"), F.count_distinct("l_suppkey").alias("n_models"), folded.alias("r"))
    return got.select("l_partkey", "p_name", "n_results", "n_models", F.array_join("r.text", ";").alias("results"))


@R.add("select distinct s_suppkey, s_name from supplier join lineitem on l_suppkey = s_suppkey where l_returnflag = 'R'")
def models_used(spark, folder):
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select("l_suppkey")
    return table(spark, folder, "supplier").select("s_suppkey", "s_name").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").orderBy("s_suppkey")


@R.add(
    """
select doc_id, content_hash from (
  select doc_id, sha256(text) as content_hash, row_number() over (partition by sha256(text) order by doc_id) as n from documents where text is not null)
where n = 1 and content_hash not in (select sha256(text) from documents where text is not null and doc_id % 10 = 0)"""
)
def import_dedup(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    existing = docs.where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("content_hash")).distinct()
    new = c.first_occurrences(docs.select("doc_id", "text"), ["text"], "doc_id")
    return new.join(existing, "content_hash", "left_anti").select("doc_id", "content_hash")


@R.add("select status, coalesce(response = '{}', false) as is_empty, count(*) as n from export_user_chat_analysis group by 1, 2")
def log_profile(spark, folder):
    return table(spark, folder, "export_user_chat_analysis").groupBy("status", F.coalesce(F.col("response") == "{}", F.lit(False)).alias("is_empty")).agg(F.count("*").alias("n"))


@R.add("select id, name, 'provider' as problem from model_config where provider not in ('ollama', 'openai') union all select id, name, 'base_url' from model_config where coalesce(regexp_matches(base_url, '^https?://'), false) = false union all select id, name, 'max_tokens' from model_config where coalesce(max_tokens between 1 and 8192, false) = false union all select id, name, 'temperature' from model_config where coalesce(temperature between 0 and 2, false) = false union all select id, name, 'timeout_seconds' from model_config where coalesce(timeout_seconds between 1 and 900, false) = false")
def config_problems(spark, folder):
    rules = {
        "provider": F.col("provider").isin("ollama", "openai"),
        "base_url": F.col("base_url").rlike("^https?://"),
        "max_tokens": F.col("max_tokens").between(1, 8192),
        "temperature": F.col("temperature").between(0, 2),
        "timeout_seconds": F.col("timeout_seconds").between(1, 900),
    }
    _, rejected = validate(table(spark, folder, "model_config"), rules)
    return rejected.select("id", "name", F.explode("reasons").alias("problem"))


@R.add("""select c.id, case when coalesce(trim(m.system_prompt), '') <> ''
  then to_json({model: m.model_name, messages: [{role: 'system', content: m.system_prompt}, {role: 'user', content: 'call ' || c.id}], max_tokens: m.max_tokens})
  else to_json({model: m.model_name, messages: [{role: 'user', content: 'call ' || c.id}], max_tokens: m.max_tokens}) end as payload
  from export_user_chat_analysis c join model_config m on m.id = c.model_id where m.enabled""")
def chat_payloads(spark, folder):
    models = table(spark, folder, "model_config").where("enabled").select(F.col("id").alias("model_id"), "model_name", "system_prompt", "max_tokens")
    calls = table(spark, folder, "export_user_chat_analysis").select("id", "model_id")
    rows = calls.join(models, "model_id")
    return rows.select("id", chat_payload(F.col("model_name"), F.col("system_prompt"), F.concat(F.lit("call "), F.col("id").cast("string")), F.col("max_tokens"), F.lit(None).cast("double")).alias("payload"))


_ACTION = "case event_type when 'view' then 'claim' when 'click' then 'release' when 'signup' then 'succeed' when 'error' then 'fail' else 'retry' end"


def _transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Events of users as transitions of tasks."""
    return table(spark, folder, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.expr(_ACTION).alias("action"))


_REPLAY = f"""
with recursive e as (select user_id as task, {_ACTION} as action, row_number() over (partition by user_id order by event_id) as k from events),
s as (
  select task, 0::bigint as k, 'PENDING' as state, 0::bigint as attempts, 0::bigint as ignored from (select distinct task from e)
  union all
  select e.task, e.k,
    case when e.action = 'claim' and s.state = 'PENDING' then 'RUNNING' when e.action = 'release' and s.state = 'RUNNING' then 'PENDING'
         when e.action = 'succeed' and s.state = 'RUNNING' then 'SUCCESS' when e.action = 'fail' and s.state = 'RUNNING' then 'FAILED'
         when e.action = 'retry' and s.state = 'FAILED' then 'PENDING' else s.state end,
    s.attempts + case when e.action = 'claim' and s.state = 'PENDING' then 1 else 0 end,
    s.ignored + case when (e.action = 'claim' and s.state = 'PENDING') or (e.action in ('release', 'succeed', 'fail') and s.state = 'RUNNING') or (e.action = 'retry' and s.state = 'FAILED') then 0 else 1 end
  from s join e on e.task = s.task and e.k = s.k + 1),
final as (select task, state, attempts, ignored from s qualify row_number() over (partition by task order by k desc) = 1)
"""


@R.add(_REPLAY + "select * from final")
def task_replay(spark, folder):
    return t.replay(_transitions(spark, folder), "task", "seq", "action")


@R.add(_REPLAY + "select * from final")
def stream_task_runner(spark, folder):
    """The same states from a stream of the event file."""
    from pathlib import Path

    from tessera.streaming.task_stream import run_available

    path = f"{folder}/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema)
    stream = stream.parquet(path) if Path(path).is_dir() else stream.option("pathGlobFilter", "events.parquet").parquet(folder)
    events = stream.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.expr(_ACTION).alias("action"))
    return run_available(spark, events)


@R.add("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def task_latest_event(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return t.latest(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@R.add(_REPLAY + "select case when state = 'FAILED' then 'PENDING' else state end as state, count(*) as n, sum(attempts)::bigint as attempts from final group by 1")
def retry_failed_reset(spark, folder):
    after, _ = t.retry_failed(task_replay(spark, folder), "task")
    return after.groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@R.add("select id, case when attempts is null then 'none' else 'echo' end as kind, provider || ': ' || model_name as output from (select id, provider, model_name, 1 as attempts from model_config where enabled)")
def run_models(spark, folder):
    """Every enabled model called through the injected stand-in."""
    rows = table(spark, folder, "model_config").where("enabled").select("id", F.col("provider").alias("model"), F.col("model_name").alias("prompt"))
    done = t.run_tasks(rows, t.echo_model)
    return done.select("id", F.when(F.col("attempts") > 0, "echo").otherwise("none").alias("kind"), "output")
