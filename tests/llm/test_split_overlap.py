import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import split_overlap as o


def test_index_counts_and_matches():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(12)]
    index = o.WordIndex(texts)

    def count(p):
        return sum(1 for t in texts for k in range(len(t) - len(p) + 1) if list(t[k : k + len(p)]) == list(p))

    queries = [rng.integers(1, 6, rng.integers(0, 30)) for _ in range(40)] + [texts[0], np.array([-1, 1, -1])]
    queries = [np.where(q == 5, -1, q) for q in queries]
    for q, found in zip(queries, index.matches(queries)):
        at = len(q)
        for begin, end, n in found:
            assert begin < end <= at and n == count(q[begin:end]) > 0
            assert all(q[k] == -1 or count(q[k : k + 1]) == 0 for k in range(end, at))
            assert begin == 0 or count(q[begin - 1 : end]) == 0  # it can't go on to the left
            at = begin
    assert o.WordIndex([]).matches([np.array([1, 2])]) == [[]]


def test_labels(spark):
    spelled = {"train": "train", "TRAIN ": "train", " test": "test", "test_1k": "test", "Dev": "dev", "validation": "dev", None: None, "other": None, "": None}
    got = [r[0] for r in spark.createDataFrame([(x,) for x in spelled], "s string").select(o.split_name(F.col("s"))).collect()]
    assert got == list(spelled.values())


def _prompt(words):
    return "## ROLE\nr\n\n## INCREMENTAL CHAT RECORDS\n" + " ".join(words) + "\n\n## END\nx\n"


def test_pairs_equal_groups(spark, monkeypatch):
    monkeypatch.setattr(o, "SHARD", 300)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))
    rows, want, k = [], set(), 0
    for family in range(12):
        base = [word() for _ in range(50)]
        members = []
        for _ in range(9 if family == 0 else rng.randrange(1, 5)):
            words = list(base)
            if rng.random() < 0.6:
                words[rng.randrange(50)] = word()
            k += 2
            members.append((k, _prompt(words), rng.choice(["train", "Train", "test", "dev ", None])))
        rows += members
        for a, _, x in members:
            for b, _, y in members:
                if x in ("train", "Train") and y in ("test", "dev "):
                    want.add((min(a, b), max(a, b)))
    rows += [(1, None, "train"), (3, "", "test"), (None, rows[0][1], "test"), rows[0]]
    df = spark.createDataFrame([(*r, 0) for r in rows], "row_no long, prompt string, split string, group_no int")
    members, hits = o.overlaps(df, "row_no", "prompt", "split")
    found = o.pairs(members, hits)
    assert {(r.row_a, r.row_b) for r in found.collect()} == want
    assert hits.where("covered > words or matched < covered or longest > words").count() == 0
    empty = o.pairs(*o.overlaps(df.limit(0), "row_no", "prompt", "split"))
    assert empty.count() == 0


def test_pairs_that_the_bands_miss(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))
    rows = []
    for family in range(600):
        base = [word() for _ in range(40)]
        near = base[:34] + [word() for _ in range(6)]  # 85 % of the words in common, the least that counts
        far = base[:33] + [word() for _ in range(7)]
        rows += [(3 * family, _prompt(base), "train"), (3 * family + 1, _prompt(rng.sample(near, 40)), "test"), (3 * family + 2, _prompt(far), "dev")]
    df = spark.createDataFrame(rows, "row_no long, prompt string, split string")
    found = o.pairs(*o.overlaps(df, "row_no", "prompt", "split"))
    assert {(r.row_a, r.row_b) for r in found.collect()} == {(3 * k, 3 * k + 1) for k in range(600)}


def test_records_linked_over_others(spark):
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    rows = [(k, _prompt(words[3 * k : 3 * k + 20]), {0: "train", 10: "test"}.get(k)) for k in range(11)]  # the ends have no word in common
    df = spark.createDataFrame(rows, "row_no long, prompt string, split string")
    found = o.pairs(*o.overlaps(df, "row_no", "prompt", "split"))
    assert [(r.row_a, r.row_b, r.matched) for r in found.collect()] == [(0, 10, 0)]


def test_postings_equal_brute_force():
    rng = np.random.default_rng(6)
    bags = []
    for _ in range(300):
        base = rng.integers(0, 40, rng.integers(1, 60)) if not bags or rng.random() < 0.4 else np.repeat(*bags[rng.integers(len(bags))])
        base = base.copy()
        base[rng.random(len(base)) < 0.08] = 50 + rng.integers(0, 9)
        bags.append(np.unique(base, return_counts=True))
    held = bags[:150]
    index = o.Postings(np.arange(150), np.arange(150), np.array([c.sum() for _, c in held]), np.concatenate([w for w, _ in held]), np.concatenate([c for _, c in held]), np.cumsum([0] + [len(w) for w, _ in held]))
    found = 0
    for w, c in bags:
        want = []
        for k, (v, d) in enumerate(held):
            common = sum(min(m, d[v == x].sum()) for x, m in zip(w, c))
            if common * 100 >= 85 * max(c.sum(), d.sum()):
                want.append(k)
        assert sorted(index.near(w, c, -1, 85).tolist()) == want
        found += len(want)
    assert found > 300


def test_the_index_alone_finds_edited_and_reordered_records(spark, monkeypatch):
    """Spans decide: without the exact check, all pairs with whole lines in common are found, in any order of lines."""
    monkeypatch.setattr(o, "SHARD", 2000)
    monkeypatch.setattr(o, "searched", lambda bags, roots, scratch: roots)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))
    rows, want = [], set()
    for family in range(80):
        lines = [[word() for _ in range(12)] for _ in range(6)]
        near = [list(x) for x in rng.sample(lines, 6)]
        for k in rng.sample(range(6), 4):
            near[k][rng.randrange(12)] = word()
        far = lines[:5] + [[word() for _ in range(12)]]  # 60 of 72 words, fewer than 85 %
        rows += [(3 * family, _prompt(sum(lines, [])), "train"), (3 * family + 1, _prompt(sum(near, [])), "dev"), (3 * family + 2, _prompt(sum(far, [])), None)]
        want.add((3 * family, 3 * family + 1))
    df = spark.createDataFrame(rows, "row_no long, prompt string, split string")
    members, hits = o.overlaps(df, "row_no", "prompt", "split")
    assert {(r.row_a, r.row_b) for r in o.pairs(members, hits).collect()} == want
    got = hits.where("row_no % 3 = 0").collect()
    assert len(got) == 80 and all(r.matched == 68 and r.words == 72 and 24 <= r.covered <= 68 and 8 <= r.longest <= 12 * 6 for r in got)


def test_links_of_one_large_family(spark):
    """A family of a third of all rows: each record meets few others, and all pairs over the splits come out."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))
    base = [word() for _ in range(60)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(60), 2):
            words[at] = word()
        rows.append((k, _prompt(words), "test" if k % 10 == 0 else "train"))
    rows += [(k, _prompt([word() for _ in range(60)]), rng.choice(["train", "test"])) for k in range(300, 900)]
    df = spark.createDataFrame(rows, "row_no long, prompt string, split string")
    assert o.pairs(*o.overlaps(df, "row_no", "prompt", "split")).count() == 30 * 270


def test_common_words_equal_brute_force():
    rng = np.random.default_rng(2)
    raw = [np.unique(rng.integers(0, 30, rng.integers(1, 40)), return_counts=True) for _ in range(40)]
    bags = o.Bags(np.concatenate([w for w, _ in raw]), np.concatenate([c for _, c in raw]), np.array([len(w) for w, _ in raw]))
    mine, theirs = rng.integers(0, 40, 200), rng.integers(0, 40, 200)
    want = [sum(min(c, dict(zip(*map(list, raw[b]))).get(w, 0)) for w, c in zip(*map(list, raw[a]))) for a, b in zip(mine, theirs)]
    assert bags.common(mine, bags, theirs).tolist() == want and not len(bags.common(mine[:0], bags, theirs[:0]))


def test_words_go_over_few_shuffles(spark):
    """The words and the order of all records are shuffled once for the copies, the words once for the search."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))
    rows = [(k, _prompt([word() for _ in range(100)]), "test" if k % 20 == 0 else "train") for k in range(1000)]
    df = spark.createDataFrame(rows, "row_no long, prompt string, split string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        executors = store.executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of any size are joined
    try:
        before = written()
        members, _ = o.overlaps(df, "row_no", "prompt", "split")
        assert members.count() == 0
        assert written() - before < 4 * 1000 * 100 * 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_postings_pass_over_the_own_root(monkeypatch):
    """Large families are passed over as a whole, small ones by their roots."""
    monkeypatch.setattr(o, "FAMILY", 6)
    rng = np.random.default_rng(7)
    roots = np.concatenate([np.repeat(k, size) for k, size in enumerate([40, 20, 6, 3, 1, 1, 1])])
    base = [rng.integers(0, 60, 50) for _ in range(4)]
    raw = []
    for root in roots:
        text = base[root % 4].copy()
        text[rng.random(50) < 0.06] = 60 + rng.integers(0, 9)
        raw.append(np.unique(text, return_counts=True))
    flat = [np.concatenate([x[k] for x in raw]) for k in (0, 1)]
    length = np.array([len(w) for w, _ in raw])
    index = o.Postings(np.arange(len(raw)), roots, np.full(len(raw), 50), *flat, np.append(0, np.cumsum(length)))
    given = np.where(rng.random(len(raw)) < 0.8, roots, 99)
    common = lambda a, b: sum(min(c, dict(zip(*map(list, b))).get(w, 0)) for w, c in zip(*map(list, a)))
    want = {(i, k) for i in range(len(raw)) for k in range(len(raw)) if given[i] != roots[k] and common(raw[i], raw[k]) * 100 >= 85 * 50}
    assert len(want) > 300 and set(zip(*(x.tolist() for x in index.near_all(o.Bags(*flat, length), given, 85, at_once=16)))) == want
