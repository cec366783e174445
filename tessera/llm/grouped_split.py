"""Splits that keep related records together.

Records are related by an account number or a session id. The graph has one
vertex for each key and one edge for each pair of keys that some record joins,
so its size follows the distinct keys. Borůvka rounds contract, for every
vertex, its least edge (edges carry the distinct row numbers of their first
records, so there are no ties); the chosen edges are written as a spanning forest,
whose trees are the groups. Their roots are then stratified by size band and dealt to the splits.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.promptx import USER_TITLES, section
from tessera.operators.components import components
from tessera.session import Scratch

# The labels before an account number in the user information.
ACCOUNT_LABELS = r"account(?:\s*(?:id|no|number))?|acct|uid|user\s*(?:id|no|number)|member(?:\s*(?:id|no|number))?|账号|帐号|账户|会员号|用户\s*(?:id|编号)"
_ACCOUNT_LINE = rf"(?im)^[ \t]*(?:[-*•][ \t]*)?(?:{ACCOUNT_LABELS})(?![\p{{L}}])[.．]?[ \t]*[:：=#]?[ \t]*([^\n]*)$"
WIDE = "０１２３４５６７８９"


def account(prompt: Column) -> Column:
    """The account number named by the user information: its digits without leading zeros, else null."""
    line = F.regexp_extract(section(prompt, USER_TITLES), _ACCOUNT_LINE, 1)
    digits = F.regexp_replace(F.translate(line, WIDE, "0123456789"), r"[^0-9]", "")
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when(bare != "", bare)


def spanning_forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v, w): the edges that Borůvka's rounds over edges(u, v, w), w distinct, contract; a written table.

    An edge keeps the ends it had at first (a, b) while its ends of the round are contracted.
    """
    forest = []
    edges = scratch.keep(edges.selectExpr("u", "v", "w", "u as a", "v as b"), "round0")
    for k in itertools.count(1):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "a", "b"))
        best = scratch.keep(both.groupBy("u").agg(F.min(F.struct("w", "v", "a", "b")).alias("x")).select("u", "x.*"), f"forest{k}")
        forest.append(best.selectExpr("a as u", "b as v", "w"))
        roots = scratch.keep(components(best.select(F.col("u").alias("a"), F.col("v").alias("b")), Scratch(scratch.spark, "contract")), f"roots{k}")
        to = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"{s}{s}"))
        left = edges.hint("merge").join(to("u"), "u").hint("merge").join(to("v"), "v").where("uu <> vv")
        left = left.groupBy(F.least("uu", "vv").alias("u"), F.greatest("uu", "vv").alias("v")).agg(F.min(F.struct("w", "a", "b")).alias("x"))
        edges = scratch.keep(left.select("u", "v", "x.*"), f"round{k}")
    tree = edges.selectExpr("a as u", "b as v", "w")
    for more in forest:
        tree = tree.union(more)
    return scratch.keep(tree.distinct(), "spanning_forest")


def related_groups(df: DataFrame, key: str, prompt: str, session: str) -> DataFrame:
    """(row_no, group_no, size) of every record that names an account or a session.

    group_no is the least key of the group and size its number of records.
    Null keys are left out; a null or odd prompt names no account; records
    with neither account nor session are in no group; rows that repeat a key
    are one record.
    """
    scratch = Scratch(df.sparkSession, "related")
    rows = df.select(F.col(key).cast("long").alias("row_no"), account(F.col(prompt)).alias("account"), F.col(session).cast("string").alias("session"))
    rows = scratch.keep(rows.where("row_no is not null and (account is not null or session is not null)").distinct(), "rows")
    accounts = rows.where("account is not null").groupBy("account").agg((F.min("row_no") * 2).alias("vertex"), F.count("*").alias("own"))
    sessions = rows.where("session is not null").groupBy("session").agg((F.min("row_no") * 2 + 1).alias("vertex"), F.sum(F.expr("int(account is null)")).cast("long").alias("own"))
    keys = accounts.select(F.concat(F.lit("a"), "account").alias("k"), "vertex", "own").union(sessions.select(F.concat(F.lit("s"), "session").alias("k"), "vertex", "own"))
    keys = scratch.keep(keys, "keys")
    pairs = rows.where("account is not null and session is not null").groupBy("account", "session").agg(F.min("row_no").alias("w"))
    ends = pairs.select(F.concat(F.lit("a"), "account").alias("a"), F.concat(F.lit("s"), "session").alias("s"), "w")
    ends = ends.hint("merge").join(keys.select(F.col("k").alias("a"), F.col("vertex").alias("u")), "a").hint("merge").join(keys.select(F.col("k").alias("s"), F.col("vertex").alias("v")), "s")
    forest = spanning_forest(ends.select("u", "v", "w"), scratch)
    trees = components(forest.select(F.col("u").alias("a"), F.col("v").alias("b")), Scratch(df.sparkSession, "trees"))
    rooted = keys.hint("merge").join(trees, F.col("vertex") == F.col("node"), "left").select("k", "own", F.coalesce("root", "vertex").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    sizes = rooted.groupBy("root").agg(F.sum("own").alias("size"))
    named = rooted.hint("merge").join(sizes, "root").select("k", F.expr("root div 2").alias("group_no"), "size")
    at = rows.select("row_no", F.coalesce(F.concat(F.lit("a"), "account"), F.concat(F.lit("s"), "session")).alias("k"))
    return at.hint("merge").join(named, "k").select("row_no", "group_no", "size")


def deal(groups: DataFrame, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """(group_no, split) for groups(group_no, size): train, test and dev in the proportions of sizes.

    Groups larger than half of the test split's due go to train. The others
    are stratified by size band; within a band, in an order drawn by hash,
    every so many-th group goes to test and every so many-th of the rest to
    dev. Places come from sums over 4096 hash ranges of each band, so no task
    sees more than a range of a band. Sizes that are missing or zero put all in train.
    """
    total = sum(sizes.values()) or 1
    rows = groups.agg(F.sum("size")).first()[0] or 0
    due = {k: rows * sizes.get(k, 0) / total for k in ("test", "dev")}
    giant = max(1.0, due["test"] / 2)
    rest = groups.where(F.col("size") <= giant).agg(F.sum("size")).first()[0] or 1
    test = min(1.0, due["test"] / rest)
    dev = min(1.0, due["dev"] / max(1.0, rest - due["test"]))
    order = F.sha1(F.concat_ws(":", F.lit(str(seed)), "group_no"))
    marked = groups.select("group_no", "size", order.alias("o"), F.when(F.col("size") > giant, -1).otherwise(F.floor(F.log2(F.col("size")))).cast("int").alias("band"))
    marked = marked.withColumn("range", F.conv(F.substring("o", 1, 3), 16, 10).cast("int"))
    counts = marked.groupBy("band", "range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("band").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("band", "range").orderBy("o", "group_no")) - 1
    placed = marked.withColumn("place", place).join(before.select("band", "range", F.coalesce("before", F.lit(0)).alias("before")), ["band", "range"])
    k = F.col("before") + F.col("place")
    phase = F.pmod(F.col("band") * 0.381966, F.lit(1.0))
    taken = F.floor(k * test + phase)
    is_test = F.floor((k + 1) * test + phase) > taken
    j = k - taken
    is_dev = F.floor((j + 1) * dev + phase) > F.floor(j * dev + phase)
    split = F.when(F.col("band") < 0, "train").when(is_test, "test").when(is_dev, "dev").otherwise("train")
    return placed.select("group_no", "size", split.alias("split"))


def split_sizes(manifests: DataFrame) -> dict[str, int]:
    """The sizes of all manifests together; null counts as none."""
    row = manifests.agg(*(F.sum(f"sizes.{k}").alias(k) for k in ("train", "test", "dev"))).first()
    return {k: int(row[k] or 0) for k in ("train", "test", "dev")}
