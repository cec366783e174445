import random

from pyspark.sql import functions as F

from tessera.llm import leakage as k


def _item(rng, n, zh=False):
    if zh:
        return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def _naive(item, doc, least):
    """Whether some least or more successive item words align with at most one error in nine: edit distance over all windows."""
    for i in range(len(item)):
        for n in range(least, len(item) - i + 1):
            part = item[i : i + n]
            row = [0] * (len(doc) + 1)  # free begin in the document
            for a, w in enumerate(part, 1):
                new = [a]
                for b, v in enumerate(doc, 1):
                    new.append(min(row[b - 1] + (w != v), row[b] + 1, new[b - 1] + 1))
                row = new
            if min(row) * 9 <= n:
                return True
    return False


def test_equals_naive_alignment():
    rng = random.Random(7)
    wrong = 0
    for _ in range(120):
        item = _item(rng, rng.randrange(16, 30)).split()
        begin = rng.randrange(len(item) - 10)
        part = item[begin : begin + rng.randrange(8, 26)]
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(part))
            rng.choice([lambda: part.__setitem__(at, "zzzz"), lambda: part.insert(at, "yyyy"), lambda: len(part) > 3 and part.pop(at)])()
        doc = _item(rng, 12).split() + part + _item(rng, 12).split()
        found = bool(k.Items([(1, " ".join(item))]).find(k._ids(doc, {})))
        wrong += found != _naive(item, doc, k.WORDS)
    assert wrong <= 1  # ends that are themselves errors may be counted either way


def test_errors_behind_the_first_word():
    rng = random.Random(9)
    for least, zh, wrong in ((k.WORDS, False, (1,)), (k.HAN, True, (1, 3)), (k.HAN, True, (1, 11))):
        item = (list if zh else str.split)(_item(rng, 40, zh))
        part = item[10 : 10 + least]
        for at in wrong:
            part[at] = "乙" if zh else "zzzz"
        doc = _item(rng, 12).split() + part + _item(rng, 12).split()
        assert _naive(item, doc, least) and k.Items([(1, ("" if zh else " ").join(item))]).find(k._ids(doc, {})), wrong
        assert not k.Items([(1, ("" if zh else " ").join(item))]).find(k._ids(doc[:12] + part[:-1] + doc[12 + least :], {}))


def test_surface_changes():
    rng = random.Random(1)
    text = "Consider Perra of Tamere, who keeps 2980 luard jars beside the dusty winter coat and writes to Jolox whenever."
    items = k.Items([(5, text), (6, "天台到稔弦镇，viduurn路牌有2814块，Crasabekest说是芷汀画的，岚野却改学养蜂何解")])
    find = lambda t: [r[0] for r in items.find(k._ids(k.words(t), {}))]
    words = text.split()
    assert find(_item(rng, 30)) == [] and find("") == []
    for t in (text.upper(), text.replace(" ", "  "), "> " + "\n> ".join([" ".join(words[:6]), " ".join(words[6:])]), text.replace("luard", "**luard**"), "<p>" + text.replace("dusty", "<b>dusty</b>") + "</p>", text.replace(", ", " — “"), '{"a": "' + text.replace(" who", "\\n who") + '"}', text.replace("luard", "lu-\nard"), text.replace("keeps", "ｋｅｅｐｓ")):
        assert find("before it. " + t + " after it") == [5], t
    assert find("天台到稔弦镇 viduurn路牌有2814块 Crasa\nbekest说是芷汀画的 岚野却改学养蜂何解") == [6]
    assert find(" ".join(words[:10])) == []
    assert find("天台到稔弦镇，viduurn路牌有2814块") == []


def test_tables(spark):
    rng = random.Random(3)
    items = [(n, _item(rng, 40)) for n in range(6)] + [(20, _item(rng, 40, zh=True)), (21, None), (22, "short one"), (3, None)]
    rows = [(1, items[0][1]), (1, items[0][1]), (2, None), (3, "  "), (None, items[1][1]), (4, "x " * 100_000 + items[2][1]), (5, items[3][1] + " and " + items[6][1]), (6, items[3][1].split()[0])]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, item string")
    held = spark.createDataFrame(items + [items[0]], "item_id long, text string").withColumn("doc", F.lit(1))
    found = k.leaks(docs, "doc_id", "text", held, "item_id", "text")
    assert sorted((r.doc or 0, r.item) for r in found.collect()) == [(0, 1), (1, 0), (1, 0), (4, 2), (5, 3), (5, 20)]
    assert k.leaks(docs, "doc_id", "text", held.limit(0), "item_id", "text").count() == 0
    assert k.leaks(docs.limit(0), "doc_id", "text", held, "item_id", "text").count() == 0
    kept = {r.doc_id: r.text for r in k.without_spans(docs, "doc_id", "text", found).collect()}
    assert kept[5].strip() == "and" and kept[1] == "" and kept[2] is None and kept[6] == rows[-1][1]


def test_items_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    items = [(n, _item(rng, 30)) for n in range(12)]
    monkeypatch.setattr(k, "LIMIT", 600)
    docs = spark.createDataFrame(items, "d long, t string")
    got = k.leaks(docs, "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t").collect()
    assert sorted((r.doc, r.item) for r in got) == [(n, n) for n in range(12)]


def test_every_passage_of_an_item(spark):
    """An item that a document holds twice, or in two parts, is found and removed each time."""
    rng = random.Random(6)
    item, other = _item(rng, 40), _item(rng, 40)
    words = item.split()
    text = "Start here. " + item + " Between both. " + item + " And parts " + " ".join(words[:16]) + " apart zzz qqq yyy vvv uuu " + " ".join(words[20:38]) + " the end."
    docs = spark.createDataFrame([(1, text), (2, other), (3, "nothing at all")], "doc_id long, text string")
    held = spark.createDataFrame([(7, item), (8, other)], "item_id long, text string")
    found = k.leaks(docs, "doc_id", "text", held, "item_id", "text")
    spans = sorted((r.begin, r.end) for r in found.where("doc = 1").collect())
    assert len(spans) == 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    left = {r.doc_id: r.text for r in k.without_spans(docs, "doc_id", "text", found).collect()}
    again = k.leaks(spark.createDataFrame(list(left.items()), "doc_id long, text string"), "doc_id", "text", held, "item_id", "text")
    assert again.count() == 0 and "start here" in left[1] and "between both" in left[1] and "apart zzz" in left[1] and "the end" in left[1] and left[3] == "nothing at all"
