"""Preparation of a corpus: export, shingle clusters, strata and splits, lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import chat_text, shingles, word_count
from tessera.operators.components import components
from tessera.session import Scratch


def exportable(df: DataFrame) -> DataFrame:
    """Calls with a status of success, a prompt, and a response that is neither empty nor {}; all of it reaches the scan."""
    return df.where("status = 1 and prompt <> '' and response not in ('', '{}')")


def shingle_table(df: DataFrame, key: str, text: str, window: int = 256, stride: int = 192) -> DataFrame:
    """(key, shingle), each once for a text."""
    return df.where(F.col(text).isNotNull()).select(key, F.explode(shingles(F.col(text), window, stride)).alias("shingle"))


def shingle_frequency(table: DataFrame) -> DataFrame:
    return table.groupBy("shingle").agg(F.count("*").alias("df"))


def shingle_pairs(table: DataFrame, key: str, most: int = 100, least_shared: int = 2) -> DataFrame:
    """(a, b, shared): keys that share at least so many shingles of 2 to most texts.

    A shingle of more texts is template text by definition, so a shingle gives
    most * (most - 1) / 2 pairs at the very most. So more than most copies of one text have no pair.
    """
    rare = shingle_frequency(table).where(F.col("df").between(2, most)).select("shingle")
    kept = table.join(rare, "shingle")
    a, b = kept.select("shingle", F.col(key).alias("a")), kept.select("shingle", F.col(key).alias("b"))
    return a.join(b, "shingle").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)


def clusters(df: DataFrame, key: str, text: str, most: int = 100, least_shared: int = 2, copies: bool = False) -> DataFrame:
    """(key, cluster) of every row: the least key of its cluster.

    Texts whose shingles are in more than most texts each, such as more than most copies of one, and texts
    without enough shingles are clusters of their own, as in the reference. copies links equal texts as well, however many and short.
    """
    scratch = Scratch(df.sparkSession, "clusters")
    links = shingle_pairs(shingle_table(df, key, text), key, most, least_shared).select("a", "b")
    if copies:
        hashed = df.where(F.col(text).isNotNull()).select(F.col(key).alias("b"), F.sha2(text, 256).alias("hash"))
        least = hashed.groupBy("hash").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
        links = links.union(hashed.join(least, "hash").where("a < b").select("a", "b"))
    roots = components(links, scratch).select(F.col("node").alias(key), F.col("root").alias("cluster"))
    return df.select(key).join(roots, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def size_bucket(size: Column) -> Column:
    return F.when(size <= 1, "1").when(size <= 10, "2-10").when(size <= 100, "11-100").when(size <= 1000, "101-1000").otherwise(">1000")


def stratum(n_items: Column, length: Column) -> Column:
    items = F.when(n_items == 0, "0").when(n_items <= 2, "1-2").when(n_items <= 5, "3-5").otherwise("6+")
    return F.concat_ws("|", items, F.when(length < 1200, "short").when(length < 1800, "mid").otherwise("long"))


def dominant(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value): the most frequent value of each group, of equally frequent ones the first seen."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def before(df: DataFrame, groups: list[str], order: str, amount: str) -> DataFrame:
    """df with before: the sum of amount over the group's rows that come earlier in the order, a hex hash.

    Sums over the 4096 ranges of the hash come first, so a task sees one range of one group.
    """
    marked = df.withColumn("_range", F.substring(order, 1, 3))
    sums = marked.groupBy(*groups, "_range").agg(F.sum(amount).alias("_sum"))
    offset = (F.sum("_sum").over(Window.partitionBy(*groups).orderBy("_range")) - F.col("_sum")).alias("_offset")
    within = F.sum(amount).over(Window.partitionBy(*groups, "_range").orderBy(order)) - F.col(amount)
    return marked.withColumn("_within", within).join(sums.select(*groups, "_range", offset), [*groups, "_range"]).withColumn("before", F.col("_offset") + F.col("_within")).drop("_range", "_within", "_offset")


def forced_rows(df: DataFrame, key: str, text: str, forced: DataFrame, forced_text: str, order: str) -> DataFrame:
    """(key, forced_pos): the row of each forced text, of equal texts the last; forced_pos is its least order in the file.

    Raises ValueError when a forced text is in no row, as the split would not be the one asked for.
    """
    last = df.where(F.col(text).isNotNull()).groupBy(F.sha1(text).alias("_hash")).agg(F.max(key).alias(key))
    wanted = forced.groupBy(F.sha1(forced_text).alias("_hash")).agg(F.min(order).alias("forced_pos"))
    found = Scratch(df.sparkSession, "forced").keep(wanted.join(last, "_hash", "left"), "found")
    missing = [r[0] or "null" for r in found.where(F.col(key).isNull()).orderBy("forced_pos").select("_hash").limit(3).collect()]
    if missing:
        raise ValueError("forced rows are not in the data: " + ", ".join(h[:12] for h in missing))
    return found.select(key, "forced_pos")


def stratified_split(rows: DataFrame, key: str, cluster: str, stratum_: str, test: float, dev: float, seed: int = 42, forced: DataFrame | None = None) -> DataFrame:
    """(cluster, stratum, size, split): clusters are whole; in each stratum test is filled first, then dev.

    A cluster is taken while the rows before it are fewer than the split's due, so sizes overshoot by less than a cluster.
    forced: rows by key that must be in test. Their clusters go to test whole and count for its share of
    all rows; the rest is dealt as (test rows - forced rows) / remaining rows.
    """
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("size"))
    main = dominant(rows, cluster, stratum_, key)
    each = sizes.join(main, cluster)
    taken = None
    if forced is not None:
        hit = rows.join(forced.select(key), key, "left_semi").select(cluster).distinct()
        taken, each = each.join(hit, cluster, "left_semi"), each.join(hit, cluster, "left_anti")
        n_taken, n_free = ((d.agg(F.sum("size")).first()[0] or 0) for d in (taken, each))
        n = n_taken + n_free
        test, dev = max(n * test - n_taken, 0) / max(n_free, 1), n * dev / max(n_free, 1)
    each = each.withColumn("o", F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(cluster).cast("string"))))
    due = each.groupBy(stratum_).agg(F.sum("size").alias("n"))  # a row for each stratum
    placed = before(each, [stratum_], "o", "size").join(F.broadcast(due), stratum_)
    in_test = F.col("before") < F.col("n") * test
    placed = placed.withColumn("in_test", in_test)
    test_rows = placed.where("in_test").groupBy(stratum_).agg(F.sum("size").alias("test_rows"))
    placed = placed.join(F.broadcast(test_rows), stratum_, "left")
    in_dev = (F.col("before") - F.coalesce("test_rows", F.lit(0))) < F.col("n") * dev
    out = placed.select(cluster, stratum_, "size", F.when(F.col("in_test"), "test").when(in_dev, "dev").otherwise("train").alias("split"))
    return out if taken is None else out.union(taken.select(cluster, stratum_, "size", F.lit("test")))


def in_test_order(rows: DataFrame, splits: DataFrame, key: str, cluster: str, forced: DataFrame) -> DataFrame:
    """(key, cluster, forced_pos) of the test rows: forced ones first, as in their file, the rest by cluster, whose least key is its rank."""
    test = rows.select(key, cluster).join(splits.where("split = 'test'").select(cluster), cluster, "left_semi")
    return test.join(forced, key, "left").select(key, cluster, "forced_pos").orderBy(F.asc_nulls_last("forced_pos"), cluster, key)


def token_lengths(df: DataFrame, key: str, prompt: str, output: str, count: Callable[[list[str]], list[int]] = word_count, render: Callable[[str, str], str] = chat_text) -> DataFrame:
    """(key, prompt_tokens, output_tokens, total_tokens); rows with a null text are left out.

    count gives the tokens of each text, without special ones. The total has the overhead of the chat
    template on top, measured once on a rendered pair of single letters.
    """
    whole, x, y = count([render("x", "y"), "x", "y"])
    overhead = whole - x - y

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf.key, "prompt_tokens": count(pdf.prompt.tolist()), "output_tokens": count(pdf.output.tolist())})

    texts = df.select(F.col(key).cast("long").alias("key"), F.col(prompt).alias("prompt"), F.col(output).alias("output")).where("key is not null and prompt is not null and output is not null")
    found = texts.mapInPandas(run, "key long, prompt_tokens long, output_tokens long")
    return found.select(F.col("key").alias(key), "prompt_tokens", "output_tokens", (F.col("prompt_tokens") + F.col("output_tokens") + overhead).alias("total_tokens"))


def overlapping(splits: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that are in more than one split; none in a leak-free split."""
    return splits.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def nearest_index_percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row of n, mean, longest and p<share>: the value at place min(int(n * share), n - 1) of the sorted ones.

    Works on the counts of distinct values, which are few for lengths.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    running = counts.select("v", "c", F.sum("c").over(Window.orderBy("v")).alias("upto"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    parts = [F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.max("v").alias("longest")]
    for s in shares:
        place = F.least(F.floor(F.col("n") * s), F.col("n") - 1)
        parts.append(F.min(F.when(F.col("upto") > place, F.col("v"))).alias(f"p{round(s * 100)}"))
    return running.agg(*parts)


def over_cutoffs(df: DataFrame, column: str, cutoffs: list[int]) -> DataFrame:
    """(cutoff, n, share) of values above each cutoff, in one pass."""
    got = df.agg(F.count(column).alias("total"), *(F.count_if(F.col(column) > c).alias(f"c{c}") for c in cutoffs))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"c{c}").alias("n")) for c in cutoffs)))
    return got.select("total", rows.alias("x")).select("x.cutoff", "x.n", F.try_divide("x.n", "total").alias("share"))
