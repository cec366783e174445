import pytest
from pyspark.sql import functions as F

from tessera.operators import compare, corpus


def test_split_keeps_clusters(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 700).alias("c"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"))
    got = corpus.stratified_split(rows, "k", "c", "s", 0.2, 0.1)
    sizes = {r.split: r["sum(size)"] for r in got.groupBy("split").sum("size").collect()}
    assert sum(sizes.values()) == 3000 and abs(sizes["test"] - 600) < 20 and abs(sizes["dev"] - 300) < 20
    assert got.groupBy("c").count().where("count > 1").count() == 0


def test_prefix_sums_equal_a_loop(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.sha1(F.col("id").cast("string")).alias("o"), (F.col("id") % 7 + 1).alias("n"))
    got = corpus.before(rows, ["g"], "o", "n").collect()
    for g in range(3):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.o):
            assert r.before == total
            total += r.n


def test_dominant_and_buckets(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, "y", 1), (1, "x", 7), (1, "y", 9), (2, "z", 3)], "g int, v string, o int")
    assert {r.g: r.v for r in corpus.dominant(df, "g", "v", "o").collect()} == {1: "y", 2: "z"}
    sizes = spark.createDataFrame([(1,), (2,), (11,), (101,), (1001,)], "n int")
    assert [r[0] for r in sizes.select(corpus.size_bucket(F.col("n"))).collect()] == ["1", "2-10", "11-100", "101-1000", ">1000"]


def test_percentiles_and_cutoffs(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "v long")
    r = corpus.nearest_index_percentiles(df, "v", [0.5, 0.99]).first()
    assert (r.n, r.mean, r.longest, r.p50, r.p99) == (4, 4.0, 10, 3, 10)
    assert [(r.cutoff, r.n) for r in corpus.over_cutoffs(df, "v", [1, 9]).collect()] == [(1, 3), (9, 1)]


def test_series(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, 0.5), ("b", 1, 0.5), ("b", 2, 1.0)], "s string, row_no long, x double")
    got = {r.s: r for r in compare.summary(df, "s", ["x"]).collect()}
    assert got["a"].n == 1 and got["a"].half_ci == 0.0 and got["b"].mean == 2 / 3
    wins = {(r.a, r.b): (r.n, r.wins) for r in compare.win_rates(df, "s", "x").collect()}
    assert wins == {("a", "b"): (2, 1), ("b", "a"): (2, 0)}
    assert {(r.s, r.bin): r.n for r in compare.delta_histogram(df, "s", "a", "x").collect()} == {("b", 10): 1}
    assert [(r.x, r.share) for r in compare.ecdf(df.where("s = 'b'"), "s", "x").orderBy("x").collect()] == [(0.5, 2 / 3), (1.0, 1.0)]


def test_forced_rows_and_their_clusters_are_in_test(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 700).alias("c"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"), F.concat(F.lit("p"), F.col("id") % 2900).alias("t"))
    file = spark.createDataFrame([(0, "p7"), (1, "p5"), (2, "p2000"), (3, "p7")], "pos int, prompt string")
    forced = corpus.forced_rows(rows, "k", "t", file, "prompt", "pos")
    assert {(r.k, r.forced_pos) for r in forced.collect()} == {(2907, 0), (2905, 1), (2000, 2)}  # the last row of a text
    got = corpus.stratified_split(rows, "k", "c", "s", 0.2, 0.1, forced=forced)
    split = {r.c: r.split for r in got.collect()}
    assert len(split) == 700 == got.count() and {split[2907 % 700], split[2905 % 700], split[2000 % 700]} == {"test"}
    sizes = {r.split: r["sum(size)"] for r in got.groupBy("split").sum("size").collect()}
    assert sum(sizes.values()) == 3000 and abs(sizes["test"] - 600) < 20 and abs(sizes["dev"] - 300) < 20
    order = corpus.in_test_order(rows, got, "k", "c", forced).collect()
    assert [r.k for r in order[:3]] == [2907, 2905, 2000] and len(order) == sizes["test"]
    assert [(r.c, r.k) for r in order[3:]] == sorted((r.c, r.k) for r in order[3:])
    many = rows.where("k < 1500").select("k")  # more forced rows than the share of test: none is dealt beside them
    assert {r.split for r in corpus.stratified_split(rows.where("c < 350 or k < 1500"), "k", "k", "s", 0.2, 0.1, forced=many).where("k >= 1500").collect()} == {"train", "dev"}
    for bad in ("nowhere", None):
        with pytest.raises(ValueError):
            corpus.forced_rows(rows, "k", "t", spark.createDataFrame([(0, bad)], "pos int, prompt string"), "prompt", "pos")


def test_token_lengths(spark):
    df = spark.createDataFrame([(1, "one two, three", "四五"), (2, None, "x"), (3, "", ""), (4, "x", None)], "k long, p string, o string")
    got = {r.k: tuple(r)[1:] for r in corpus.token_lengths(df, "k", "p", "o", render=lambda p, o: f"<{p}|{o}>").collect()}
    assert got == {1: (4, 2, 9), 3: (0, 0, 3)}
    letters = corpus.token_lengths(df, "k", "p", "o", count=lambda texts: [len(t) for t in texts], render=lambda p, o: f"{p}{o}")
    assert {r.k: r.total_tokens for r in letters.collect()} == {1: 16, 3: 0}


def test_many_copies_are_one_cluster(spark):
    long, short = " ".join(str(n) for n in range(300)), "a short text"
    rows = [(k, long) for k in range(120)] + [(200 + k, short) for k in range(3)] + [(300, None), (301, None), (302, "alone")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k: r.cluster for r in corpus.clusters(df, "k", "t", copies=True).collect()}
    assert got == {k: 0 if k < 120 else 200 if k < 300 else k for k, _ in rows}
