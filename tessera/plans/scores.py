"""Queries over score records and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import cosine, embed_texts, with_vectors
from tessera.operators import compare, scoring
from tessera.plans.registry import Registry
from tessera.tables import table

R = Registry()

# The score dimensions and the names of the structural checks.
DIMS = ["total_score", "json_valid", "intent_score", "summary_score", "memory_precision", "memory_recall", "speaker_attribution", "hallucination_penalty", "other"]
CHECKS = ["parseable", "fields_complete", "memory_categories_valid", "rolling_summary_length_ok", "memory_no_duplicates"]


def _scores(spark, folder):
    return table(spark, folder, "sample_score").withColumn("series", F.coalesce("model", F.lit("none")))


_TERMS = {k: "(1 - hallucination_penalty)" if k == "hallucination" else k for k in scoring.WEIGHTS}
_NUM = " + ".join(["0::double", *(f"coalesce({_TERMS[k]} * {w}::double, 0)" for k, w in scoring.WEIGHTS.items())])
_DEN = " + ".join(["0::double", *(f"(case when {_TERMS[k]} is null then 0::double else {w}::double end)" for k, w in scoring.WEIGHTS.items())])


def _dims():
    return {k: 1 - F.col("hallucination_penalty") if k == "hallucination" else F.col(k) for k in scoring.WEIGHTS}


@R.add(f"select score_no, coalesce(cast(format('{{:.4f}}', ({_NUM}) / nullif({_DEN}, 0)) as double), 0) as total from sample_score")
def weighted_totals(spark, folder):
    return table(spark, folder, "sample_score").select("score_no", scoring.weighted_total(_dims()).alias("total"))


_LOW = ("memory_precision", "memory_recall", "speaker_attribution", "summary_score", "other")
_WHY = (
    "list_filter([case when json_valid <> 1 then 'json_invalid' end, case when intent_score < 0.6 then 'intent_low' end, case when finish_reason = 'length' then 'truncated' end, "
    + ", ".join(f"case when {k} < 0.6 then '{k}' end" for k in _LOW)
    + ", case when hallucination_penalty > 0.2 then 'hallucination_high' end], lambda x: x is not null)"
)


def _risky(spark, folder):
    rows = table(spark, folder, "sample_score")
    return rows.withColumn("why", scoring.high_risk_reasons({k: F.col(k) for k in DIMS}, F.col("finish_reason")))


@R.add(f"select score_no, sample_id, array_to_string({_WHY}, ',') as why from sample_score where len({_WHY}) > 0")
def high_risk(spark, folder):
    return _risky(spark, folder).where(F.size("why") > 0).select("score_no", "sample_id", F.array_join("why", ",").alias("why"))


@R.add(f"select tag, count(*) as n from (select unnest({_WHY}) as tag from sample_score) group by tag")
def risk_tags(spark, folder):
    return _risky(spark, folder).select(F.explode("why").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_KEEP = "coalesce(speaker_attribution, 1) >= 1 and coalesce(json_valid >= 1, false)"


@R.add(f"select count(*) as seen, count(*) filter (where {_KEEP}) as kept, count(*) filter (where speaker_attribution < 1) as speaker_dropped, count(*) filter (where not coalesce(json_valid >= 1, false)) as structure_dropped from sample_score")
def clean_counts(spark, folder):
    keep = scoring.clean_filter(F.col("speaker_attribution"), F.col("json_valid"))
    return table(spark, folder, "sample_score").agg(F.count("*").alias("seen"), F.count_if(keep).alias("kept"), F.count_if(F.col("speaker_attribution") < 1).alias("speaker_dropped"), F.count_if(~F.coalesce(F.col("json_valid") >= 1, F.lit(False))).alias("structure_dropped"))


@R.add(f"select score_no, sample_id from sample_score where {_KEEP}")
def clean_rows(spark, folder):
    return table(spark, folder, "sample_score").where(scoring.clean_filter(F.col("speaker_attribution"), F.col("json_valid"))).select("score_no", "sample_id")


@R.add(
    """
with d as (select score_no, unnest(details.memory_details) as d from sample_score)
select score_no, round(avg(case when d.grounding >= 0.5 and d.evidence_is_user is not null then d.evidence_is_user::int end), 6) as speaker,
  round(avg(d.grounding), 6) as grounding_mean, round(avg((d.grounding = 0)::int), 6) as hallucination, count(*) as n_items from d where d is not null group by score_no"""
)
def grounding_summary(spark, folder):
    got = scoring.details_summary(table(spark, folder, "sample_score"), "score_no", "details")
    return got.select("score_no", *(F.round(c, 6).alias(c) for c in ("speaker", "grounding_mean", "hallucination")), "n_items")


_U, _P, _C = "case when d.evidence_is_user then d.grounding else 0 end", "case when not d.evidence_is_user then d.grounding else 0 end", "case when d.evidence_is_user is null then d.grounding else 0 end"


@R.add(
    f"""
with d as (select unnest(details.memory_details) as d from sample_score), g as (select d.category as category, coalesce({_U}, 0) as u, coalesce({_P}, 0) as p, coalesce({_C}, 0) as c from d where d is not null),
k as (select category, case when p >= 1 and u < 0.5 then 'TRUE_ERR' when p >= 1 and u >= 0.5 then 'ECHO' when u >= 0.5 then 'USER_OK' when c >= 0.5 then 'CARRIED' else 'NO_EVIDENCE' end as class from g)
select category, class, count(*) as n, round(count(*) / sum(count(*)) over (partition by category), 6) as share from k group by category, class"""
)
def attribution_audit(spark, folder):
    d = table(spark, folder, "sample_score").select(F.explode("details.memory_details").alias("d")).where("d is not null")
    g = d.select("d.category", *(F.coalesce(F.expr(e), F.lit(0.0)).alias(n) for n, e in (("u", _U), ("p", _P), ("c", _C))))
    counts = g.groupBy("category", scoring.attribution(F.col("u"), F.col("p"), F.col("c")).alias("class")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("category").alias("of")).agg(F.sum("n").alias("all"))
    return counts.join(totals, F.col("category").eqNullSafe(F.col("of"))).select("category", "class", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


_LONG = " union all ".join(f"select coalesce(model, 'none') as series, '{d}' as dim, {d} as x from sample_score" for d in DIMS)


@R.add(
    f"""
select series, dim, count(x) as n, round(coalesce(avg(x), 0), 10) as mean, round(median(x), 10) as median, round(stddev_samp(x), 10) as sd, round(quantile_cont(x, 0.1), 10) as p10, round(quantile_cont(x, 0.9), 10) as p90,
  round(case when count(x) < 2 then 0 else 1.96 * stddev_samp(x) / sqrt(count(x)) end, 10) as half_ci from ({_LONG}) group by series, dim"""
)
def series_summary(spark, folder):
    got = compare.summary(_scores(spark, folder), "series", DIMS)
    return got.select("series", "dim", "n", *(F.round(c, 10).alias(c) for c in ("mean", "median", "sd", "p10", "p90", "half_ci")))


@R.add(f"select coalesce(model, 'none') as series, {', '.join(f'round(count({d}) / count(*), 6) as {d}' for d in DIMS)} from sample_score group by 1")
def applicability(spark, folder):
    got = compare.applicability(_scores(spark, folder), "series", DIMS)
    return got.select("series", *(F.round(d, 6).alias(d) for d in DIMS))


@R.add(f"select coalesce(model, 'none') as series, {', '.join(f'round(avg(coalesce(details.rule.checks[{c!r}], false)::int), 6) as {c}' for c in CHECKS)} from sample_score group by 1")
def pass_rates(spark, folder):
    got = compare.pass_rates(_scores(spark, folder), "series", "details.rule.checks", CHECKS)
    return got.select("series", *(F.round(c, 6).alias(c) for c in CHECKS))


@R.add("select coalesce(model, 'none') as series, round(avg(coalesce(json_valid = 0, false)::int), 6) as l0, round(avg(coalesce(json_valid = 0.25, false)::int), 6) as l25, round(avg(coalesce(json_valid = 0.5, false)::int), 6) as l50, round(avg(coalesce(json_valid = 1, false)::int), 6) as l100, round(avg(coalesce(finish_reason = 'length', false)::int), 6) as truncated from sample_score group by 1")
def level_shares(spark, folder):
    rows = _scores(spark, folder).withColumn("cut", F.coalesce(F.col("finish_reason") == "length", F.lit(False)).cast("double"))
    levels = compare.level_shares(rows, "series", "json_valid", {"l0": 0.0, "l25": 0.25, "l50": 0.5, "l100": 1.0})
    cut = rows.groupBy("series").agg(F.avg("cut").alias("truncated"))
    return levels.join(cut, "series").select("series", *(F.round(c, 6).alias(c) for c in ("l0", "l25", "l50", "l100", "truncated")))


_VALID = ["intent_score", "summary_score", "memory_precision", "memory_recall", "speaker_attribution", "other"]


@R.add(f"select coalesce(model, 'none') as series, count(*) as n, {', '.join(f'round(avg({d}), 10) as {d}' for d in _VALID)} from sample_score where json_valid >= 0.5 group by 1")
def valid_means(spark, folder):
    return _scores(spark, folder).where("json_valid >= 0.5").groupBy("series").agg(F.count("*").alias("n"), *(F.round(F.avg(d), 10).alias(d) for d in _VALID))


_NUMBERED = "s as (select coalesce(model, 'none') as series, row_number() over (partition by coalesce(model, 'none') order by score_no) - 1 as row_no, * from sample_score)"


def _series(spark, folder, *columns):
    return compare.numbered(_scores(spark, folder).select("series", "score_no", *columns), "series", "score_no")


@R.add(f"with {_NUMBERED}, m as (select min(n) as least from (select count(*) as n from s group by series)), k as (select series, row_no, total_score as x from s, m where row_no < least) select a.series as a, b.series as b, count(*) as n, count(*) filter (where a.x > b.x) as wins, round(count(*) filter (where a.x > b.x) / count(*), 6) as rate from k a join k b on a.row_no = b.row_no and a.series <> b.series group by 1, 2")
def win_rate_matrix(spark, folder):
    got = compare.win_rates(_series(spark, folder, "total_score"), "series", "total_score")
    return got.select("a", "b", "n", "wins", F.round("rate", 6).alias("rate"))


_BASE = "(select min(coalesce(model, 'none')) from sample_score)"


def _baseline(rows):
    return rows.agg(F.min("series")).first()[0]


_DELTA = ["total_score", "intent_score", "memory_recall", "hallucination_penalty"]
_MEANS = " union all ".join(f"select series, '{d}' as dim, avg({'1 - ' if d in compare.PENALTIES else ''}{d}) as m from s group by series" for d in _DELTA)


@R.add(f"with {_NUMBERED}, l as ({_MEANS}) select a.series, a.dim, round(a.m - b.m, 6) as delta from l a join l b on a.dim = b.dim and b.series = {_BASE} where a.series <> {_BASE}")
def delta_vs_baseline(spark, folder):
    rows = _scores(spark, folder)
    return compare.deltas(rows, "series", _baseline(rows), _DELTA).select("series", "dim", F.round("delta", 6).alias("delta"))


@R.add(f"with {_NUMBERED}, d as (select a.series, round(a.total_score - b.total_score, 6) as d from s a join s b on a.row_no = b.row_no and b.series = {_BASE} where a.series <> {_BASE}) select series, least(floor(round((d + 1) * 20, 6)), 39)::int as bin, count(*) as n from d where d between -1 and 1 group by 1, 2")
def delta_histogram(spark, folder):
    rows = _series(spark, folder, "total_score")
    return compare.delta_histogram(rows, "series", _baseline(rows), "total_score")


@R.add("with c as (select coalesce(model, 'none') as series, total_score as x, count(*) as c from sample_score where total_score is not null group by 1, 2) select series, x, round(sum(c) over (partition by series order by x) / sum(c) over (partition by series), 6) as share from c")
def ecdf(spark, folder):
    return compare.ecdf(_scores(spark, folder), "series", "total_score").select("series", "x", F.round("share", 6).alias("share"))


@R.add("select q.vec_id as query, v.vec_id as found, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as sim from embeddings q join embeddings v on q.label = v.label and q.vec_id <> v.vec_id where q.vec_id % 50 = 0 and list_cosine_similarity(q.embedding::double[], v.embedding::double[]) > 0.3")
def cosine_pairs(spark, folder):
    """Threshold similarity join of the stated query set, every vector with an id divisible by 50, with all of its label; ``semantic_join`` has no such set."""
    rows = table(spark, folder, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    found = rows.select("label", F.col("vec_id").alias("found"), F.col("embedding").alias("v"))
    sim = cosine(F.col("q"), F.col("v"))
    return queries.join(found, "label").where("query <> found").withColumn("sim", sim).where("sim > 0.3").select("query", "found", F.round("sim", 6).alias("sim"))


@R.add("select a.vec_id as query, b.vec_id as found, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim from embeddings a join embeddings b on a.label = b.label where a.vec_id % 2 = 0 and b.vec_id % 2 <> 0 and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) > 0.3")
def semantic_join(spark, folder):
    """Threshold similarity join within a label of the two sides of the survey, all even ids with all odd ones."""
    rows = table(spark, folder, "embeddings")
    left = rows.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    right = rows.where("vec_id % 2 <> 0").select("label", F.col("vec_id").alias("found"), F.col("embedding").alias("v"))
    sim = cosine(F.col("q"), F.col("v"))
    return left.join(right, "label").withColumn("sim", sim).where("sim > 0.3").select("query", "found", F.round("sim", 6).alias("sim"))


@R.add()
def evidence_levels(spark, folder):
    """Evidence level of each memory item against its matched text, by embedding and word overlap."""
    from tessera.functions.text import overlap

    items = table(spark, folder, "sample_score").select("score_no", F.posexplode("details.memory_details").alias("idx", "d")).select("score_no", "idx", F.col("d.text").alias("item"), F.col("d.matched_teacher_text").alias("line")).where("item is not null and line is not null")
    both = with_vectors(items, embed_texts(items, "item", "line"), "item", "line")
    sim = cosine(F.col("item_vector"), F.col("line_vector"))
    return both.select("score_no", "idx", scoring.evidence_level(sim, overlap(F.col("item"), F.col("line"))).alias("level"))


def _dataset(spark, folder):
    return table(spark, folder, "split_dataset").where("prompt is not null and output is not null").select(F.col("row_no").alias("id"), "prompt", "output")


@R.add()
def self_evaluation(spark, folder):
    """Scores of every dataset row's output against itself, and whether it passes the clean filter."""
    from tessera.operators.evaluation import self_evaluated

    return self_evaluated(_dataset(spark, folder))


@R.add()
def evidence_audit(spark, folder):
    """What supports the memory items of every dataset row."""
    from tessera.operators.evaluation import audited

    return audited(_dataset(spark, folder))
