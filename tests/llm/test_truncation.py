import random

from pyspark.sql import functions as F

from tessera.llm import truncation as t


def test_structure():
    cut = lambda x: t.look(x)["cut"]
    assert cut('{"a": [1, 2]}') is False and cut('{"a": [1, 2') is True and cut('{"a": "x…') is True and cut('{"a": {"b": 1} [truncated]') is True
    assert cut("<p>One.</p><p>Two.</p>") is False and cut("<p>One.</p><p>Tw") is True
    assert cut("One. Two.") is False and cut("One. Two?\n") is False and cut("一句话。") is False
    assert cut("One. Two :)") is None and t.look("One. Two :)")["word"] is None
    assert cut("One. Two,") is True and cut("用户�") is True
    assert cut("## ROLE\nx\n\n## B\ny\n") is False and cut("## ROLE\nx\n\n## B\ny") is True
    assert cut("") is False and cut(" ​\n") is False
    assert cut("One two. Three fo") is None and t.look("One two. Three fo")["prose"] and t.look("One two. Three…")["mark"]
    assert t.look("All done.\n-- Velvana")["signed"] and not t.look("All done.\nnow then")["signed"]


def test_ends_of_any_length():
    """What stands at the end counts whole, however long."""
    for k in (3, 200, 5000):
        got = t.look("He went to the sto" + "." * k)
        assert got["cut"] is None and got["word"] == "sto" and got["mark"] and got["bare"] == 18
    for k in (1, 250, 5000):
        assert t.look("<p>Hi there</p>" + "🎉" * k)["cut"] is False and t.look("<p>Hi there" + "🎉" * k)["cut"] is True
        assert t.look("It is done." + '"' * k)["cut"] is False
        assert t.look("It is done 🎉" + " 🎉" * k)["cut"] is None
        assert t.look("Half a wor" + " [truncated]" * k)["word"] == "wor"


def test_asked_words_only(spark):
    import numpy as np

    rows = [("one two three. four two",), ("one two threefold five six",), ("one twofold. two five",), (None,), ("",)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    every = {(r.before, r.word): (r.n, r.ends) for r in t.followed(df, "text", np.ones(t.SLOTS, bool)).collect() if r.n}
    assert every[None, "two"] == (3, 0) and every["one", "two"] == (2, 0) and every["one", None] == (3, 1) and every[None, "three"] == (1, 1) and every["", "two"] == (1, 0)
    asked = spark.createDataFrame([("one", "two"), ("", "three"), ("x", "fou"), (None, None)], "before string, word string")
    got = {(r.before, r.word): (r.n, r.ends, r.longer) for r in t.followed(df, "text", t.asked_slots(asked)).collect()}
    assert {k: v[:2] for k, v in got.items() if v[0]} == {k: every[k] for k in [(None, "two"), ("one", "two"), ("one", None), (None, "three"), ("", None)]}
    assert got[None, "two"][2] == 1 and got[None, "fou"] == (0, 0, 1) and got[None, "three"][2] == 1


def _corpus(rng):
    """Chat lines without full stops, complete ones and ones cut at 300 characters or inside a word."""
    names = ["".join(rng.choice(["ba", "do", "ki", "lu", "me", "no", "ra", "si"]) for _ in range(3)).title() for _ in range(40)]
    verbs, things = ["bought", "painted", "returned", "carried", "measured"], ["umbrella", "guitar", "notebook", "suitcase", "camera"]
    line = lambda: f"12:0{rng.randrange(10)} <{rng.choice(names)}> we {rng.choice(verbs)} the {rng.choice(things)} with {rng.choice(names)} yesterday"
    rows, want = [], set()
    for k in range(900):
        text = "\n".join(line() for _ in range(rng.randrange(2, 10)))
        source = rng.choice("abc")
        if source == "a" and len(text) > 300:
            text = text[:300]
            if not text.endswith("\n"):  # the end of a line tells nothing
                want.add(k)
        elif source == "b" and rng.random() < 0.2:
            at = rng.choice([m.start() for m in t.regex.finditer("umbrella|guitar|notebook|suitcase|camera", text)]) + 4
            text = text[:at]
            want.add(k)
        rows.append((k, text, source))
    return rows, want


def test_limits_and_prefixes(spark):
    rows, want = _corpus(random.Random(5))
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, source string, cut boolean")
    got = {r.key for r in t.truncated(df, "doc_id", "text", "source").where("cut").collect()}
    assert len(want) > 100 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(rows)


def test_odd_tables(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " ", None), (4, "word " * 50_000 + "end.", None), (5, '{"a"', None), (5, '{"a"', None), (None, "Fine.", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("word", F.lit(1)).withColumn("bare", F.lit(1))
    got = [(r.key, r.cut) for r in t.truncated(df, "doc_id", "text", "source").collect()]
    assert sorted(got, key=str) == sorted([(2, False), (3, False), (4, False), (5, True), (5, True), (None, False)], key=str)
    assert t.truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_words_seen():
    assert t.pieces("One two. Three\nfour") == [("One", False), ("two", True), ("Three", True), ("four", False)]
    assert t.pieces("在3公里。") == [("在", False), ("0", False), ("公", False), ("里", False)]
