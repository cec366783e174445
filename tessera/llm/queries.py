"""The queries pN_ of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.near_duplicates import near_duplicates

    found = near_duplicates(table(spark, folder, "split_dataset"), "row_no", "prompt")
    return found.selectExpr("key as row_no", "group_no")


def p4_packed(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.packing import packed

    return packed(table(spark, folder, "train_lora"), "row_no", "prompt", "source").select("row_no", "piece_no", "container")


def p4_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Number of containers, the least number that could do, the share of space used, and how far windows of ten containers drift from the sources' shares."""
    from tessera.llm.packing import WINDOW, drifts, packed
    from tessera.session import Scratch

    found = Scratch(spark, "packed").keep(packed(table(spark, folder, "train_lora"), "row_no", "prompt", "source"), "found")
    total = F.sum("size")
    mean, p99, most = drifts(found).agg(F.avg("drift"), F.percentile("drift", 0.99), F.max("drift")).first()
    counts = found.agg(F.count_distinct("container").alias("containers"), F.count("*").alias("pieces"), F.ceil(total / 6000).alias("least"), (total / (F.count_distinct("container") * 6000)).alias("used"))
    return counts.withColumns({"window": F.lit(WINDOW), "mean_drift": F.lit(mean).cast("double"), "p99_drift": F.lit(p99).cast("double"), "most_drift": F.lit(most).cast("double")})


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.defects import labelled

    calls = table(spark, folder, "export_user_chat_analysis").where("task = 'user_chat_analysis' and status = 1")
    return labelled(calls, "id", "prompt", "response")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).where("size(defects) > 0").select(F.col("key").alias("id"), F.expr("defects[0].defect").alias("defect"))


def p2_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every defect that holds for a call, with its probability."""
    return _labelled(spark, folder).select(F.col("key").alias("id"), F.inline("defects"))


def _overlaps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from tessera.llm.split_overlap import overlaps

    return overlaps(table(spark, folder, "split_dataset"), "row_no", "prompt", "split")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.split_overlap import pairs

    return pairs(*_overlaps(spark, folder)).select("row_a", "row_b").distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each evaluation split and source, the pairs, the evaluation records in them, and the most words covered."""
    from tessera.llm.split_overlap import pairs

    members, hits = _overlaps(spark, folder)
    sources = table(spark, folder, "split_dataset").select(F.col("row_no").alias("eval_no"), "source")
    covered = hits.select(F.col("row_no").alias("train_no"), "covered")
    found = pairs(members, hits).join(sources, "eval_no").join(covered, "train_no", "left")
    return found.groupBy("eval_split", "source").agg(F.count("*").alias("n_pairs"), F.count_distinct("eval_no").alias("n_records"), F.max("covered").alias("most_words"))


def p5_share(spark: SparkSession, folder: str) -> DataFrame:
    """For each manifest, its test records that occur in training, and their share of sizes.test."""
    from tessera.llm.split_overlap import pairs

    manifests = table(spark, folder, "split_manifest").select("manifest_id", F.col("sizes.test").alias("test_size"))
    of = table(spark, folder, "split_dataset").select(F.col("row_no").alias("eval_no"), "manifest_id")
    found = pairs(*_overlaps(spark, folder)).where("eval_split = 'test'").select("eval_no").distinct().join(of, "eval_no")
    counts = found.groupBy("manifest_id").agg(F.count("*").alias("n_test"))
    n = F.coalesce("n_test", F.lit(0))
    return manifests.join(counts, "manifest_id", "left").select("manifest_id", "test_size", n.alias("n_test"), F.try_divide(n, "test_size").alias("share"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.grouped_split import related_groups

    found = related_groups(table(spark, folder, "split_dataset"), "row_no", "prompt", "session_id")
    return found.where("size > 1").select("row_no", "group_no")


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    """(row_no, group_no, size, manifest_id) of all records; a record related to none is its own group."""
    from tessera.llm.grouped_split import related_groups

    rows = table(spark, folder, "split_dataset")
    found = related_groups(rows, "row_no", "prompt", "session_id")
    every = rows.where("row_no is not null").select(F.col("row_no").cast("long").alias("row_no"), "manifest_id").distinct()
    return every.join(found, "row_no", "left").select("row_no", "manifest_id", F.coalesce("group_no", "row_no").alias("group_no"), F.coalesce("size", F.lit(1)).alias("size"))


def p6_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """(row_no, group_no, split) of every record."""
    from tessera.llm.grouped_split import deal, split_sizes
    from tessera.session import Scratch

    rows = Scratch(spark, "assign").keep(_groups(spark, folder), "rows")
    sizes = split_sizes(table(spark, folder, "split_manifest"))
    groups = deal(rows.select("group_no", "size").distinct(), sizes)
    return rows.join(groups.select("group_no", "split"), "group_no").select("row_no", "group_no", "split")


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """For each manifest its groups, those of two or more of its records, and the noted number."""
    rows = _groups(spark, folder)
    own = rows.groupBy("manifest_id", "group_no").agg(F.count("*").alias("n"))
    counts = own.groupBy("manifest_id").agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_multi"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_in_multi"))
    noted = table(spark, folder, "split_manifest").select("manifest_id", F.col("clusters.n_clusters").alias("noted_clusters"), F.col("clusters.rows_in_multi_member_clusters").alias("noted_rows"))
    return counts.join(noted, "manifest_id", "full")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.encoding import encode_corpus

    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.leakage import leaks

    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_holdout"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each leaked item, in how many documents, and the longest passage in words."""
    found = _leaks(spark, folder)
    return found.groupBy(F.col("item").alias("item_id")).agg(F.count_distinct("doc").alias("documents"), F.max("length").alias("longest"))


def p8_removed(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, without the passages of held-out items."""
    from tessera.llm.leakage import without_spans
    from tessera.session import Scratch

    found = Scratch(spark, "leaks").keep(_leaks(spark, folder), "found")
    return without_spans(table(spark, folder, "documents"), "doc_id", "text", found)


def _cuts(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.llm.truncation import truncated

    return truncated(table(spark, folder, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cuts(spark, folder).where("cut").select(F.col("key").alias("doc_id")).distinct()


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    """For each source its texts, the cut ones, their share, and how many stop at a length limit."""
    found = _cuts(spark, folder)
    return found.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("int")).alias("share"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_at_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_GROUPS = r"""
with recursive
i as (select row_no, manifest_id, session_id, regexp_extract(prompt, '(?ms)^##[ \t]+(?:USER BASIC INFORMATION|用户基本信息)[ \t\r]*$\n?(.*?)(?:^##[ \t]|\z)', 1) as info from split_dataset),
l as (select *, regexp_extract(info, '(?im)^[ \t]*(?:-[ \t]*)?(?:account id|account|uid|member no|账号)[.]?[ \t]*[:：=]?[ \t]*([^\n]*)$', 1) as line from i),
k as (select row_no, 'a' || regexp_replace(regexp_replace(line, '[^0-9]', '', 'g'), '^0+', '') as key from l where regexp_replace(regexp_replace(line, '[^0-9]', '', 'g'), '^0+', '') <> ''
  union all select row_no, 's' || session_id from l where session_id is not null),
e as (select distinct a.key as x, b.key as y from k a join k b on a.row_no = b.row_no and a.key <> b.key),
w(x, y) as (select x, y from e union select w.x, e.y from w join e on e.x = w.y),
m as (select key, min(row_no) as first from k group by key),
g as (select m.key, least(m.first, coalesce(min(o.first), m.first)) as group_no from m left join w on w.x = m.key left join m o on o.key = w.y group by m.key, m.first),
r as (select distinct k.row_no, g.group_no from k join g on g.key = k.key),
n as (select group_no, count(*) as size from r group by group_no),
every as (select i.row_no, i.manifest_id, coalesce(r.group_no, i.row_no) as group_no from i left join r on r.row_no = i.row_no)
"""


def oracle_sql() -> dict[str, str]:
    """Of the others none is given: they can't be said in SQL, or not on whole tables. tests/llm compares them with brute force."""
    return {
        "p6_found": _GROUPS + "select r.row_no, r.group_no from r join n on n.group_no = r.group_no where size > 1",
        "p6_clusters": _GROUPS
        + """, c as (select manifest_id, group_no, count(*) as n from every group by 1, 2)
select coalesce(c.manifest_id, s.manifest_id) as manifest_id, count(c.group_no) as n_groups, count(*) filter (where c.n > 1) as n_multi, sum(case when c.n > 1 then c.n else 0 end)::bigint as rows_in_multi,
  any_value(s.clusters.n_clusters) as noted_clusters, any_value(s.clusters.rows_in_multi_member_clusters) as noted_rows
from c full join split_manifest s on s.manifest_id = c.manifest_id group by 1""",
    }
