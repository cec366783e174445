"""Comparison of score series. A series is (series, row_no, scores...); null means the score does not apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PENALTIES = ("hallucination_penalty",)


def numbered(df: DataFrame, series: str, order: str) -> DataFrame:
    """df with row_no: the place of a row in its series, from 0."""
    return df.withColumn("row_no", (F.row_number().over(Window.partitionBy(series).orderBy(order)) - 1).cast("long"))


def summary(df: DataFrame, series: str, dims: list[str]) -> DataFrame:
    """(series, dim, n, mean, median, sd, p10, p90, half_ci): the applicable values; the mean of none is 0, the interval of fewer than two 0."""
    long = df.select(series, F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("x")) for d in dims))).alias("_of")).select(series, "_of.*")
    got = long.groupBy(series, "dim").agg(
        F.count("x").alias("n"), F.coalesce(F.avg("x"), F.lit(0.0)).alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("sd"), F.percentile("x", 0.1).alias("p10"), F.percentile("x", 0.9).alias("p90")
    )
    return got.withColumn("half_ci", F.when(F.col("n") < 2, 0.0).otherwise(1.96 * F.col("sd") / F.sqrt("n")))


def applicability(df: DataFrame, series: str, dims: list[str]) -> DataFrame:
    return df.groupBy(series).agg(*((F.count(d) / F.count("*")).alias(d) for d in dims))


def pass_rates(df: DataFrame, series: str, checks: str, names: list[str]) -> DataFrame:
    """Share of rows whose check is true; a missing check or map fails."""
    return df.groupBy(series).agg(*(F.avg(F.coalesce(F.try_element_at(F.col(checks), F.lit(n)), F.lit(False)).cast("int")).alias(n) for n in names))


def level_shares(df: DataFrame, series: str, column: str, levels: dict[str, float]) -> DataFrame:
    return df.groupBy(series).agg(*(F.avg(F.coalesce(F.col(column) == v, F.lit(False)).cast("int")).alias(k) for k, v in levels.items()))


def oriented(dim: str, value: Column) -> Column:
    """Higher is better: penalties are turned round."""
    return 1 - value if dim in PENALTIES else value


def common_prefix(df: DataFrame, series: str) -> DataFrame:
    """Rows whose place every series has."""
    least = df.groupBy(series).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return df.join(F.broadcast(least), F.col("row_no") < F.col("least"), "inner").drop("least")  # one row


def win_rates(df: DataFrame, series: str, score: str) -> DataFrame:
    """(a, b, n, wins, rate): share of common rows where a's score is above b's. Series are few; rows meet by place."""
    kept = common_prefix(df.select(series, "row_no", F.col(score).alias("x")), series)
    a, b = (kept.select("row_no", F.col(series).alias(s), F.col("x").alias(f"x{s}")) for s in "ab")
    both = a.join(b, "row_no").where("a <> b")
    got = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("xa") > F.col("xb")).alias("wins"))
    return got.withColumn("rate", F.col("wins") / F.col("n"))


def deltas(df: DataFrame, series: str, baseline: str, dims: list[str]) -> DataFrame:
    """(series, dim, delta): oriented means less those of the baseline."""
    means = df.groupBy(series).agg(*(F.avg(oriented(d, F.col(d))).alias(d) for d in dims))
    long = means.select(series, F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("m")) for d in dims))).alias("_of")).select(series, "_of.*")
    base = long.where(F.col(series) == baseline).select("dim", F.col("m").alias("base"))
    return long.where(F.col(series) != baseline).join(F.broadcast(base), "dim").select(series, "dim", (F.col("m") - F.col("base")).alias("delta"))


def delta_histogram(df: DataFrame, series: str, baseline: str, score: str, bins: int = 40) -> DataFrame:
    """(series, bin, n) of score differences to the baseline at the same place, in equal bins of -1 to 1, the last closed."""
    kept = df.select(series, "row_no", F.col(score).alias("x"))
    base = kept.where(F.col(series) == baseline).select("row_no", F.col("x").alias("y"))
    d = kept.where(F.col(series) != baseline).join(base, "row_no").select(series, F.round(F.col("x") - F.col("y"), 6).alias("d")).where("d between -1 and 1")
    place = F.least(F.floor(F.round((F.col("d") + 1) * (bins / 2), 6)), F.lit(bins - 1))
    return d.groupBy(series, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, series: str, score: str) -> DataFrame:
    """(series, x, share): the share of values up to x at each distinct x, from the counts of distinct values."""
    counts = df.where(F.col(score).isNotNull()).groupBy(series, F.col(score).alias("x")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(series).orderBy("x"))
    return counts.select(series, "x", (upto / F.sum("c").over(Window.partitionBy(series))).alias("share"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts and shares of column's values for each row value."""
    counts = df.groupBy(row).agg(F.count("*").alias("n"), *(F.count_if(F.col(column) == v).alias(v) for v in values))
    return counts.select(row, "n", *values, *((F.col(v) / F.col("n")).alias(f"{v}_share") for v in values))
