"""Queries that prepare a corpus: shingle clusters, splits, lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import compare, corpus
from tessera.plans.registry import Registry
from tessera.session import Scratch
from tessera.tables import table

R = Registry()

_SHINGLES = """
k as (select distinct doc_id, substr(sha1(substr(text, s::bigint + 1, 256)), 1, 16) as shingle
  from (select doc_id, text, unnest(range(0, greatest(length(text) - 256, 0) + 1, 192)) as s from documents where length(text) >= 128)),
f as (select shingle, count(*) as df from k group by shingle)
"""
_PAIRS = (
    _SHINGLES
    + """,
r as (select k.doc_id, k.shingle from k join f using (shingle) where df between 2 and 100),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from r a join r b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2 having count(*) >= 2)
"""
)
_CLUSTERS = (
    _PAIRS
    + """,
e as (select a as x, b as y from p union select b, a from p),
w(x, y) as (select x, y from e union select w.x, e.y from w join e on w.y = e.x),
c as (select d.doc_id, least(d.doc_id, coalesce(m.y, d.doc_id)) as cluster from documents d left join (select x, min(y) as y from w group by x) m on m.x = d.doc_id)
"""
)


@R.add(f"with {_SHINGLES} select df, count(*) as n_shingles from f group by df")
def shingle_df(spark, folder):
    got = corpus.shingle_frequency(corpus.shingle_table(table(spark, folder, "documents"), "doc_id", "text"))
    return got.groupBy("df").agg(F.count("*").alias("n_shingles"))


@R.add(f"with {_PAIRS} select * from p")
def near_dup_pairs(spark, folder):
    return corpus.shingle_pairs(corpus.shingle_table(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")


@R.add(f"with recursive {_CLUSTERS} select doc_id, cluster from c")
def near_dup_components(spark, folder):
    return corpus.clusters(table(spark, folder, "documents"), "doc_id", "text")


@R.add(f"with recursive {_CLUSTERS}, z as (select cluster, count(*) as size from c group by cluster) select case when size <= 1 then '1' when size <= 10 then '2-10' when size <= 100 then '11-100' when size <= 1000 then '101-1000' else '>1000' end as bucket, count(*) as n from z group by 1")
def cluster_buckets(spark, folder):
    sizes = corpus.clusters(table(spark, folder, "documents"), "doc_id", "text").groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.groupBy(corpus.size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n"))


@R.add(f"with recursive {_CLUSTERS} select cluster, count(*) as size from c group by cluster order by size desc, cluster limit 5")
def largest_clusters(spark, folder):
    sizes = corpus.clusters(table(spark, folder, "documents"), "doc_id", "text").groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "cluster").limit(5)


_LINES = "(length(text) - length(replace(text, chr(10), '')))"
_STRATUM = f"concat_ws('|', case when {_LINES} = 0 then '0' when {_LINES} <= 2 then '1-2' when {_LINES} <= 5 then '3-5' else '6+' end, case when length(text) < 1200 then 'short' when length(text) < 1800 then 'mid' else 'long' end)"
_SPLIT = (
    _CLUSTERS
    + f""",
t as (select c.doc_id, c.cluster, {_STRATUM} as stratum from c join documents d on d.doc_id = c.doc_id where d.text is not null),
n as (select cluster, stratum, count(*) as k, min(doc_id) as first from t group by 1, 2),
m as (select cluster, arg_max(stratum, (k, -first)) as stratum, sum(k) as size from n group by cluster),
b as (select *, coalesce(sum(size) over (partition by stratum order by sha1('42:' || cluster) rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over (partition by stratum) as due from m),
g as (select *, before < due * 0.1 as in_test from b),
h as (select *, coalesce(sum(size) filter (where in_test) over (partition by stratum), 0) as test_rows from g),
o as (select cluster, stratum, size::bigint as size, case when in_test then 'test' when before - test_rows < due * 0.05 then 'dev' else 'train' end as split from h)
"""
)


def _split(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    found = corpus.clusters(table(spark, folder, "documents"), "doc_id", "text")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = docs.select("doc_id", corpus.stratum(n_lines, F.length("text")).alias("stratum")).join(found, "doc_id")
    rows = Scratch(spark, "split").keep(rows, "rows")
    return rows, corpus.stratified_split(rows, "doc_id", "cluster", "stratum", 0.1, 0.05)


@R.add(f"with recursive {_SPLIT} select * from o")
def stratum_split(spark, folder):
    return _split(spark, folder)[1]


@R.add(f"with recursive {_SPLIT}, joined as (select t.doc_id, t.stratum, o.split from t join o on o.cluster = t.cluster) select stratum, count(*) as n, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'test') as test, count(*) filter (where split = 'dev') as dev, round(count(*) filter (where split = 'train') / count(*), 6) as train_share, round(count(*) filter (where split = 'test') / count(*), 6) as test_share, round(count(*) filter (where split = 'dev') / count(*), 6) as dev_share from joined group by stratum")
def split_crosstab(spark, folder):
    rows, splits = _split(spark, folder)
    joined = rows.join(splits.select("cluster", "split"), "cluster")
    got = compare.crosstab(joined, "stratum", "split", ["train", "test", "dev"])
    return got.select("stratum", "n", "train", "test", "dev", *(F.round(f"{s}_share", 6).alias(f"{s}_share") for s in ("train", "test", "dev")))


@R.add(f"with recursive {_SPLIT}, joined as (select o.split, d.text from t join o on o.cluster = t.cluster join documents d on d.doc_id = t.doc_id) select count(*) as n from (select sha256(text) from joined group by 1 having count(distinct split) > 1)")
def split_shared_texts(spark, folder):
    """Texts in more than one split; short copies without a shingle and more than 100 copies of a text may be."""
    rows, splits = _split(spark, folder)
    texts = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    joined = rows.join(splits.select("cluster", "split"), "cluster").join(texts, "doc_id")
    return corpus.overlapping(joined, "hash", "split").agg(F.count("*").alias("n"))


_SHARES = [0.5, 0.9, 0.95, 0.98, 0.99]


@R.add("with s as (select length(text) as v from documents where text is not null), a as (select list_sort(list(v)) as l, count(*) as n, avg(v) as mean, max(v) as longest from s) select n, round(mean, 6) as mean, longest, " + ", ".join(f"l[(least(floor(n * {s})::bigint, n - 1) + 1)::bigint] as p{round(s * 100)}" for s in _SHARES) + " from a")
def length_describe(spark, folder):
    lengths = table(spark, folder, "documents").select(F.length("text").cast("long").alias("v"))
    got = corpus.nearest_index_percentiles(lengths, "v", _SHARES)
    return got.withColumn("mean", F.round("mean", 6))


@R.add("select cutoff::int as cutoff, count(*) filter (where length(text) > cutoff) as n, round(count(*) filter (where length(text) > cutoff) / count(text), 6) as share from documents, (values (256), (512), (1024), (2048)) c(cutoff) group by cutoff")
def length_cutoffs(spark, folder):
    got = corpus.over_cutoffs(table(spark, folder, "documents").select(F.length("text").alias("v")), "v", [256, 512, 1024, 2048])
    return got.withColumn("share", F.round("share", 6))


@R.add("select source, count(*) as seen, count(*) filter (where length(prompt) <= 4000) as kept, sum(length(prompt)) filter (where length(prompt) <= 4000)::bigint as chars from train_lora where prompt is not null group by source")
def length_filter(spark, folder):
    rows = table(spark, folder, "train_lora").where("prompt is not null").select("source", F.length("prompt").alias("n"))
    fits = F.col("n") <= 4000  # longer ones are dropped, never cut
    return rows.groupBy("source").agg(F.count("*").alias("seen"), F.count_if(fits).alias("kept"), F.sum(F.when(fits, F.col("n"))).cast("long").alias("chars"))


@R.add()
def token_length_describe(spark, folder):
    """Lengths of prompts, outputs and whole pairs in tokens, the template's included."""
    lengths = corpus.token_lengths(table(spark, folder, "split_dataset"), "row_no", "prompt", "output")
    lengths = Scratch(spark, "lengths").keep(lengths, "lengths")
    parts = [corpus.nearest_index_percentiles(lengths, f"{p}_tokens", _SHARES).withColumn("part", F.lit(p)) for p in ("prompt", "output", "total")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add("select doc_id from documents where contains(text, 'rolling_summary') order by doc_id limit 1")
def first_match(spark, folder):
    return table(spark, folder, "documents").where(F.col("text").contains("rolling_summary")).select("doc_id").orderBy("doc_id").limit(1)


_FIELDS = ["rolling_summary", "memory_snapshot", "analysis_summary"]


@R.add("select source, count(*) as n from split_dataset where " + " and ".join(f"contains(prompt, '{f}')" for f in _FIELDS) + " group by source")
def required_fields(spark, folder):
    kept = table(spark, folder, "split_dataset")
    for f in _FIELDS:
        kept = kept.where(F.col("prompt").contains(f))
    return kept.groupBy("source").agg(F.count("*").alias("n"))
