import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import grouped_split as g

INFO = "## ROLE\nx\n\n## USER BASIC INFORMATION\n- Name: A, Gender: X, Age: 30\n{}\n\n## CURRENT DATE\n2026-01-01\n\n## INCREMENTAL CHAT RECORDS\n[t] A: Account: 99999\n"


def test_account_spellings(spark):
    lines = {"- Account: U-01013657": "1013657", "- UID: u01003375": "1003375", "- Member no. 1000122": "1000122", "- Account: 0100 7389": "1007389", "- 账号：U01008661": "1008661", "- account id = 0001002506": "1002506", "- 账号：０００７": "7", "- City: 12345": None, "- Account: none": None, "- Note: account 5": None}
    rows = spark.createDataFrame([(k, INFO.format(x)) for k, x in enumerate(lines)] + [(99, None), (98, "Account: 5")], "k int, p string")
    got = {r.k: r.a for r in rows.select("k", g.account(F.col("p")).alias("a")).collect()}
    assert [got[k] for k in range(len(lines))] == list(lines.values()) and got[99] is None and got[98] is None


def _brute(rows):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for k, a, s in rows:
        find(("r", k))
        for key in (("a", a), ("s", s)):
            if key[1] is not None:
                root[find(("r", k))] = find(key)
    groups = defaultdict(list)
    for k in {k for k, a, s in rows if a is not None or s is not None}:
        groups[find(("r", k))].append(k)
    return {k: (min(v), len(v)) for v in groups.values() for k in v}


def _table(spark, rows):
    return spark.createDataFrame([(k, INFO.format(f"- Account: {a:07d}") if a is not None else "p", s, "clash") for k, a, s in rows], "row_no long, prompt string, session_id string, account string")


def test_groups_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(k + 1, rng.choice([None, rng.randrange(1, 60)]), rng.choice([None, f"S{rng.randrange(80)}"])) for k in range(200)]
    rows += [(1000 + k, 100 + k, f"C{k // 2}") for k in range(40)] + [(2000 + k, 101 + k, f"C{k // 2}") for k in range(39)]  # a long chain
    rows += [(5000 + k, 777, f"H{k}") for k in range(150)]  # a hub
    rows.append(rows[0])
    got = {r.row_no: (r.group_no, r.size) for r in g.related_groups(_table(spark, rows), "row_no", "prompt", "session_id").collect()}
    assert got == _brute(rows)


def test_odd_tables(spark):
    assert g.related_groups(_table(spark, []), "row_no", "prompt", "session_id").count() == 0
    none = spark.createDataFrame([(1, None, None), (None, "p", "s"), (2, None, "s"), (3, "x" * 200_000, "s"), (4, "", None)], "row_no long, prompt string, session_id string")
    got = {r.row_no: (r.group_no, r.size) for r in g.related_groups(none, "row_no", "prompt", "session_id").collect()}
    assert got == {2: (2, 2), 3: (2, 2)}


def test_deal_keeps_proportions(spark):
    rng = random.Random(4)
    groups = [(k, min(40, int(rng.paretovariate(1.2)))) for k in range(4000)] + [(9999, 3000)]
    got = g.deal(spark.createDataFrame(groups, "group_no long, size long"), {"train": 80, "test": 15, "dev": 5}).collect()
    sizes = Counter()
    for r in got:
        sizes[r.split] += r.size
    total = sum(sizes.values())
    assert len(got) == len(groups) and abs(sizes["test"] / total - 0.15) < 0.01 and abs(sizes["dev"] / total - 0.05) < 0.01
    assert next(r.split for r in got if r.group_no == 9999) == "train"
    assert {r.split for r in g.deal(spark.createDataFrame(groups[:9], "group_no long, size long"), {}).collect()} == {"train"}
    assert g.deal(spark.createDataFrame([], "group_no long, size long"), {"train": 1}).count() == 0


def test_spanning_forest(spark):
    """As many edges as vertices less trees, each of the graph, of the least weight."""
    from tessera.session import Scratch

    rng = random.Random(7)
    edges = sorted({(u, v) for u, v in ((rng.randrange(60), rng.randrange(60, 140)) for _ in range(160))})
    rng.shuffle(edges)
    edges = [(u, v, w) for w, (u, v) in enumerate(edges)]
    got = {(r.u, r.v, r.w) for r in g.spanning_forest(spark.createDataFrame(edges, "u long, v long, w long"), Scratch(spark, "t")).collect()}
    root, want = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v, w in sorted(edges, key=lambda e: e[2]):
        if find(u) != find(v):
            root[find(u)] = find(v)
            want.add((u, v, w))
    assert {w for _, _, w in got} == {w for _, _, w in want} and {frozenset(e[:2]) for e in got} == {frozenset(e[:2]) for e in want}
    assert g.spanning_forest(spark.createDataFrame([], "u long, v long, w long"), Scratch(spark, "t")).count() == 0
