"""Scores of student outputs against teacher outputs and the prompt, as one plan of joins and aggregates.

samples (id, prompt, teacher, student) are parsed once on each side; memory
items, chat lines and earlier texts are exploded; every distinct text is encoded
once; matches and evidence are joins within a sample. Nothing collects. ``audited`` compares within a row, without joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numbers import round_places
from tessera.functions import promptx as px
from tessera.functions import text as tx
from tessera.functions.vectors import cosine, embed_texts, hash_embedder, with_vectors
from tessera.operators import scoring as s
from tessera.session import Scratch

_LINE = r"(?md)^\[([^\]\n]+)\] ([^\n:：]+?)[:：] ?([^\n]*)$"


def _round4(c: Column) -> Column:
    return round_places(c)


def names(prompt: Column) -> tuple[Column, Column]:
    """(user, persona), null where unknown: the name line of the user information, and the session line.

    A session line whose user is another than the named one gives no persona.
    """
    info = F.coalesce(px.section(prompt, px.USER_TITLES), prompt)
    named = tx.blank_to_null(F.regexp_extract(info, r"(?md)^- (?:Name|姓名)[:：][ \t]*([^\n]*?)[,，][ \t]*(?:Gender|性别)", 1))
    session = r"(?md)^(?:会话|Session)[:：][ \t]*([^\n]*?) - ([^\n]*?)[ \t]*$"
    first, second = tx.blank_to_null(F.regexp_extract(prompt, session, 1)), tx.blank_to_null(F.regexp_extract(prompt, session, 2))
    return F.coalesce(named, first), F.when(named.isNull() | (named == first), second)


def _said() -> tuple[Column, Column, Column, Column]:
    """(user, persona, speakers, texts) of a prompt's chat rows."""
    chat = px.section(F.col("prompt"), px.CHAT_TITLES)
    return *names(F.col("prompt")), F.regexp_extract_all(chat, F.lit(_LINE), 2), F.regexp_extract_all(chat, F.lit(_LINE), 3)


def lines(samples: DataFrame) -> DataFrame:
    """(id, idx, text, is_user) of the chat rows; is_user is null for a speaker who is neither."""
    rows = samples.select("id", *(c.alias(n) for c, n in zip(_said(), ("user", "persona", "who", "what"))))
    each = rows.select("id", "user", "persona", F.posexplode(F.arrays_zip("who", "what")).alias("idx", "l"))
    return each.select("id", "idx", F.col("l.what").alias("text"), F.when(F.col("l.who") == F.col("user"), True).when(F.col("l.who") == F.col("persona"), False).alias("is_user"))


def _prior() -> Column:
    """Lines of a prompt's old memory and user information without bullets, and the old summary as a whole."""
    part = lambda t: F.coalesce(px.section(F.col("prompt"), t), F.lit(""))
    summary = tx.blank_to_null(part(px.SUMMARY_TITLES))
    return F.concat(tx.bare_lines(part(px.MEMORY_TITLES)), F.array_compact(F.array(summary)), tx.bare_lines(part(px.USER_TITLES)))


def priors(samples: DataFrame) -> DataFrame:
    """(id, text) of the earlier texts of each prompt."""
    return samples.select("id", F.explode(_prior()).alias("text"))


def _field(side: str, path: str) -> Column:
    return F.get_json_object(F.col(f"{side}_json"), f"$.{path}")


def _text(side: str, path: str) -> Column:
    """A text of the object; blank ones count as missing."""
    return tx.blank_to_null(_field(side, path))


def _number(side: str, path: str) -> Column:
    value = _field(side, path)
    return F.when(value == "true", 1.0).when(value == "false", 0.0).otherwise(F.try_to_number(value, F.lit("S999999999.999999")).cast("double"))


def _enum(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def _enums(side: str, path: str) -> Column:
    found = F.from_json(_field(side, path), "array<string>")
    return F.array_distinct(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), _enum), lambda x: x != ""))


def evidence(items: DataFrame, samples: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(id, category, idx, grounding, evidence_line_index, evidence_is_user) of items (id, category, idx, text).

    Without a chat line and an earlier text the grounding is a neutral 0.5.
    """
    chat = lines(samples).select("id", F.col("idx").alias("line"), F.col("text").alias("source"), "is_user")
    earlier = priors(samples).select("id", F.lit(None).cast("int").alias("line"), F.col("text").alias("source"), F.lit(None).cast("boolean").alias("is_user"))
    both = items.join(chat.union(earlier), "id")
    encoded = with_vectors(both, embed_texts(both, "text", "source", encode=encode), "text", "source")
    level = s.evidence_level(cosine(F.col("text_vector"), F.col("source_vector")), tx.overlap(F.col("text"), F.col("source")))
    graded = encoded.select("id", "category", F.col("idx").alias("item"), F.col("line").alias("idx"), level.alias("level"), cosine(F.col("text_vector"), F.col("source_vector")).alias("sim"), "is_user")
    best = s.best_evidence(graded, ["id", "category", "item"]).withColumnRenamed("item", "idx")
    return items.select("id", "category", "idx").join(best, ["id", "category", "idx"], "left").withColumn("grounding", F.coalesce("grounding", F.lit(0.5)))


def evaluate(samples: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(id, total_score, json_valid, intent_score, summary_score, memory_precision, memory_recall, speaker_attribution, hallucination_penalty, other).

    An output that can't be parsed scores 0 in every dimension and 1 in
    hallucination. Null dimensions do not apply and are left out of the total.
    """
    scratch = Scratch(samples.sparkSession, "evaluate")
    sides = {}
    for side in ("teacher", "student"):
        sides[side] = scratch.keep(s.parsed(samples, "id", side, s.right_kinds), side)
    items = {k: df.select("id", F.posexplode("items").alias("idx", "i")).select("id", "i.category", "idx", "i.text") for k, df in sides.items()}

    groups = ["id", "category"]
    exact = scratch.keep(s.exact_matches(items["teacher"], items["student"], groups), "exact")
    left = {}
    for k in sides:
        used = exact.select(*groups, F.col(f"{k}_idx").alias("idx"))
        left[k] = items[k].join(used, [*groups, "idx"], "left_anti").select(*groups, F.col("idx").alias(f"{k}_idx"), F.col("text").alias(k))
    both = left["teacher"].join(left["student"], groups)
    encoded = with_vectors(both, embed_texts(both, "teacher", "student", encode=encode), "teacher", "student")
    close = encoded.select(*groups, "teacher_idx", "student_idx", cosine(F.col("teacher_vector"), F.col("student_vector")).alias("sim")).where(F.col("sim") > s.MATCH_SIM)
    matched = exact.select("id").union(s.greedy_matches(close, groups).select("id")).groupBy("id").agg(F.count("*").alias("matched"))

    own = F.array_compact(F.array(F.when(F.col("grounding") >= 0.5, F.col("evidence_is_user").cast("int"))))
    graded = evidence(items["student"], samples, encode).groupBy("id").agg(
        F.avg(F.try_element_at(own, F.lit(1))).alias("speaker"), F.avg((F.col("grounding") == 0).cast("int")).alias("ungrounded")
    )
    t = sides["teacher"].select("id", F.col("json").alias("teacher_json"), F.size("items").alias("n_teacher"))
    u = sides["student"].select("id", F.col("json").alias("student_json"), F.size("items").alias("n_student"), "checks")
    rows = t.join(u, "id").join(matched, "id", "left").join(graded, "id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))

    texts = {"summary": "rolling_summary", "reasoning": "user_intent.reasoning", "analysis": "paid_reaction.analysis"}
    for name, path in texts.items():
        rows = rows.withColumn(f"t_{name}", _text("teacher", path)).withColumn(f"u_{name}", _text("student", path))
    columns = [f"{side}_{name}" for name in texts for side in "tu"]
    rows = with_vectors(rows, embed_texts(rows, *columns, encode=encode), *columns)
    close_to = lambda name: F.greatest(F.lit(0.0), cosine(F.col(f"t_{name}_vector"), F.col(f"u_{name}_vector")))
    same = lambda path: (_enum(_field("teacher", path)) == _enum(_field("student", path))).cast("double")

    secondary = tx.jaccard(_enums("teacher", "user_intent.secondary_intents"), _enums("student", "user_intent.secondary_intents"))
    intent = 0.8 * same("user_intent.primary_intent") + 0.1 * secondary + 0.1 * close_to("reasoning")
    naturalness = s.closeness(_number("teacher", "ai_performance.naturalness_score"), _number("student", "ai_performance.naturalness_score"))
    triggered = _field("teacher", "paid_reaction.triggered").eqNullSafe(_field("student", "paid_reaction.triggered")).cast("double")
    other = 0.5 * (0.5 * same("ai_performance.identity_awareness") + 0.5 * naturalness) + 0.5 * (0.4 * triggered + 0.3 * same("paid_reaction.reaction_type") + 0.3 * close_to("analysis"))

    valid = F.col("student_json").isNotNull()
    n = [F.col(c) for c in ("matched", "n_teacher", "n_student")]
    or_zero = lambda c: F.when(valid, c).otherwise(0.0)
    scored = rows.select(
        "id",
        s.json_valid_score(F.col("checks")).alias("json_valid"),
        or_zero(_round4(intent)).alias("intent_score"),
        or_zero(_round4(close_to("summary"))).alias("summary_score"),
        or_zero(_round4(s.precision(*n))).alias("memory_precision"),
        or_zero(_round4(s.recall(*n))).alias("memory_recall"),
        or_zero(_round4(F.col("speaker"))).alias("speaker_attribution"),
        F.when(valid, _round4(F.col("ungrounded"))).otherwise(1.0).alias("hallucination_penalty"),
        or_zero(_round4(other)).alias("other"),
    )
    dims = {k: F.col(k) for k in s.WEIGHTS if k != "hallucination"} | {"hallucination": 1 - F.col("hallucination_penalty")}
    return scored.select("id", s.weighted_total(dims).alias("total_score"), *scored.columns[1:])


def self_evaluated(dataset: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """evaluate() of (id, prompt, output) with the output on both sides, and kept: whether the row passes the clean filter."""
    scores = evaluate(dataset.select("id", "prompt", F.col("output").alias("teacher"), F.col("output").alias("student")), encode)
    return scores.withColumn("kept", s.clean_filter(F.col("speaker_attribution"), F.col("json_valid")))


def _compared(rows: list[tuple[str | None, str | None, str | None, list[str] | None, list[str] | None, list[str] | None]], embed: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """Evidence levels (user, persona, prior) of the items of (output, user, persona, who, what, prior), row by row; each different text is encoded once.

    Similarities are matrix products; one too close to a threshold to tell is summed in the order of ``cosine``.
    """
    samples = []
    for output, user, persona, who, what, prior in rows:
        if items := [text for _, text in s.items_of(s.parse_output(output)[0])]:
            chat = [(w, 0 if n == user else 1) for n, w in zip(who or (), what or ()) if n in (user, persona)]
            samples.append((items, [w for w, _ in chat] + (prior or []), np.array([k for _, k in chat] + [2] * len(prior or []), np.int64)))
    number = {"": 0}
    for items, sources, _ in samples:
        for text in (*items, *sources):
            number.setdefault(text, len(number))
    texts = list(number)
    vectors = np.zeros((1, 1))
    if len(texts) > 1:
        coded = np.asarray(embed(texts[1:]), np.float32).astype(np.float64)
        vectors = np.concatenate([np.zeros((1, coded.shape[1])), coded])
    square = np.cumsum(vectors * vectors, axis=1)[:, -1]
    words = [tx.words(text) for text in texts]
    out = [np.zeros((0, 3))]
    for items, sources, kinds in samples:
        level = np.zeros((len(items), 3))
        out.append(level)
        if not sources:
            continue
        a, b = (np.array([number[x] for x in side]) for side in (items, sources))
        norm = np.sqrt(square[a][:, None] * square[b][None, :])
        sim = np.divide(vectors[a] @ vectors[b].T, norm, out=np.zeros_like(norm), where=norm > 0)
        for i, k in zip(*np.nonzero((np.abs(sim - s.STRONG_SIM) < 1e-9) | (np.abs(sim - s.WEAK_SIM) < 1e-9))):
            sim[i, k] = np.cumsum(vectors[a[i]] * vectors[b[k]])[-1] / norm[i, k]
        theirs = [words[k] for k in b]
        overlap = np.array([[len(own & x) / len(own) for x in theirs] if (own := words[k]) else [0.0] * len(theirs) for k in a])
        strong, weak = (sim > s.STRONG_SIM) | (overlap > s.STRONG_OVERLAP), (sim > s.WEAK_SIM) | (overlap > s.WEAK_OVERLAP)
        each = np.where(strong, 1.0, np.where(weak, 0.5, 0.0))
        for k in range(3):
            level[:, k] = each[:, kinds == k].max(axis=1, initial=0.0)
    return np.concatenate(out)


def audited(dataset: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(class, n, share): what supports each memory item of (id, prompt, output): user lines, persona lines or earlier texts, each apart.

    Items and sources of a row meet in memory, so nothing but the counts is shuffled; a text is encoded once in so many rows that are held at once.
    """
    embed = encode or hash_embedder()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                levels = _compared(list(zip(*(c.to_pylist() for c in whole.slice(at, 512).columns))), embed)
                yield pa.RecordBatch.from_arrays([pa.array(levels[:, k]) for k in range(3)], names=["user", "persona", "prior"])

    said = [c.alias(n) for c, n in zip(_said(), ("user", "persona", "who", "what"))]
    best = dataset.select(F.col("output").cast("string").alias("output"), *said, _prior().alias("prior")).mapInArrow(run, "user double, persona double, prior double")
    counts = best.groupBy(s.attribution(F.col("user"), F.col("persona"), F.col("prior")).alias("class")).agg(F.count("*").alias("n"))  # five rows
    return counts.select("class", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
