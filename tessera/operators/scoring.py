"""Scores of model output: structure, item matching, evidence, weighted total."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numbers import round_places
from tessera.functions import jsonx
from tessera.functions.text import normalize

# Weights of the dimensions, limits of the memory lists, thresholds of evidence.
WEIGHTS = {"memory_precision": 0.18, "memory_recall": 0.18, "speaker_attribution": 0.14, "hallucination": 0.08, "summary_score": 0.15, "intent_score": 0.10, "json_valid": 0.10, "other": 0.07}
MEMORY_LIMITS = {"facts": 10, "preferences": 10, "avoid_topics": 5, "active_events": 5, "open_loops": 5}
REQUIRED = {"analysis_summary": dict, "user_intent": dict, "paid_reaction": dict, "ai_performance": dict, "rolling_summary": str, "memory_snapshot": dict}
SUMMARY_CHARS = 2000
STRONG_SIM, STRONG_OVERLAP, WEAK_SIM, WEAK_OVERLAP = 0.80, 0.60, 0.57, 0.30
MATCH_SIM = 0.75

RULES = "parseable boolean, fields_complete boolean, memory_categories_valid boolean, rolling_summary_length_ok boolean, memory_no_duplicates boolean"


def parse_output(text: str | None) -> tuple[dict | None, str | None]:
    """(object, error): the fenced body or the text as one object, else the balanced part with most keys, the first of equal ones."""
    if text is None or not text.strip():
        return None, "empty output"
    stripped = text.strip()
    begin = stripped.find("```")
    fenced = None
    if begin >= 0 and (end := stripped.find("```", begin + 3)) > 0:
        fenced = stripped[begin + 3 : end].removeprefix("json").strip()
    for whole in (fenced, stripped):
        if whole and (found := jsonx.record(whole)) is not None:
            return found, None
    best: dict | None = None
    at = stripped.find("{")
    while at >= 0:
        end = jsonx._closing(stripped, at)
        if end > 0 and (found := jsonx.record(stripped[at:end])) is not None and (best is None or len(found) > len(best)):
            best = found
        at = stripped.find("{", at + 1)
    return (best, None) if best is not None else (None, "no valid JSON object found")


def items_of(output: dict | None) -> list[tuple[str, str]]:
    """(category, text): strings, and the text of objects with a string content; all else is dropped."""
    memory = (output or {}).get("memory_snapshot")
    out = []
    for category in MEMORY_LIMITS:
        found = memory.get(category) if isinstance(memory, dict) else None
        for x in found if isinstance(found, list) else ():
            if isinstance(x, dict):
                x = x.get("content")
            if isinstance(x, str):
                out.append((category, x))
    return out


def _plain(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha() or c.isnumeric())


def rule_checks(output: dict | None) -> tuple[bool, bool, bool, bool, bool]:
    if output is None:
        return False, False, False, False, False
    complete = all(isinstance(output.get(k), kind) for k, kind in REQUIRED.items())
    memory = output.get("memory_snapshot")
    categories = isinstance(memory, dict) and set(memory) == set(MEMORY_LIMITS)
    summary = output.get("rolling_summary")
    length_ok = isinstance(summary, str) and bool(summary.strip()) and len(summary) <= SUMMARY_CHARS
    own: dict[str, list[str]] = {}
    for category, text in items_of(output):
        own.setdefault(category, []).append(_plain(text))
    single = all(len(x) <= MEMORY_LIMITS[c] and len(set(x)) == len(x) for c, x in own.items())
    return True, complete, categories, length_ok, single


# The kinds of the members that the scores read.
TEXTS = ("rolling_summary", "user_intent.primary_intent", "user_intent.reasoning", "paid_reaction.reaction_type", "paid_reaction.analysis", "ai_performance.identity_awareness")
NUMBERS = ("ai_performance.naturalness_score",)


def right_kinds(output: dict) -> dict:
    """The object without members of another kind than the scores expect; those count as missing."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in output.items()}
    for paths, kind in ((TEXTS, str), (NUMBERS, (int, float))):
        for path in paths:
            holder, _, name = path.rpartition(".")
            at = out.get(holder) if holder else out
            if not isinstance(at, dict):
                out.pop(holder, None)
            elif name in at and not isinstance(at[name], kind):
                del at[name]
    intent = out.get("user_intent")
    if isinstance(intent, dict):
        found = intent.get("secondary_intents")
        intent["secondary_intents"] = [x for x in found if isinstance(x, str)] if isinstance(found, list) else []
    return out


def parsed(df: DataFrame, key: str, text: str, shape: Callable[[dict], dict] | None = None) -> DataFrame:
    """(key, json, error, checks, items): one Arrow pass over the texts; json is canonical text of the object, after shape."""
    schema = f"{key} {dict(df.dtypes)[key]}, json string, error string, checks struct<{RULES.replace(' ', ':').replace(',:', ',')}>, items array<struct<category:string,text:string>>"
    names = [x.split()[0] for x in RULES.split(", ")]

    def run(batches):
        for batch in batches:
            outputs = [parse_output(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([None if o is None else json.dumps(shape(o) if shape else o, ensure_ascii=False, separators=(",", ":")) for o, _ in outputs], pa.string()),
                    pa.array([e for _, e in outputs], pa.string()),
                    pa.array([dict(zip(names, rule_checks(o))) for o, _ in outputs], pa.struct([(n, pa.bool_()) for n in names])),
                    pa.array([[{"category": c, "text": t} for c, t in items_of(o)] for o, _ in outputs], pa.list_(pa.struct([("category", pa.string()), ("text", pa.string())]))),
                ],
                names=[key, "json", "error", "checks", "items"],
            )

    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def json_valid_score(checks: Column) -> Column:
    """0 unparsed, 0.25 with fields missing, 1 with all checks passed, else 0.5."""
    rest = checks["memory_categories_valid"] & checks["rolling_summary_length_ok"] & checks["memory_no_duplicates"]
    return F.when(~checks["parseable"], 0.0).when(~checks["fields_complete"], 0.25).when(rest, 1.0).otherwise(0.5)


def exact_matches(teacher: DataFrame, student: DataFrame, groups: list[str]) -> DataFrame:
    """Items with an equal normalised text: the k-th of a text with the k-th. Items are (groups..., idx, text)."""

    def ranked(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*groups, normalize(F.col("text")).alias("norm"), F.col("idx").alias(f"{side}_idx"))
        return named.withColumn("k", F.row_number().over(Window.partitionBy(*groups, "norm").orderBy(f"{side}_idx")))

    return ranked(teacher, "teacher").join(ranked(student, "student"), [*groups, "norm", "k"]).select(*groups, "teacher_idx", "student_idx")


def greedy_matches(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """One-to-one pairs of (groups..., teacher_idx, student_idx, sim): by similarity, then larger indices, first come first served.

    A fold over each group's sorted pairs; groups are the items of one sample.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), (-F.col("student_idx")).alias("si"), (-F.col("teacher_idx")).alias("ti"))))
    empty = F.array().cast("array<struct<s:double,si:bigint,ti:bigint>>")

    def take(chosen, p):
        return F.when(F.exists(chosen, lambda c: (c["si"] == p["si"]) | (c["ti"] == p["ti"])), chosen).otherwise(F.concat(chosen, F.array(p)))

    typed = pairs.select(*groups, F.col("sim").cast("double"), F.col("student_idx").cast("long"), F.col("teacher_idx").cast("long"))
    got = typed.groupBy(*groups).agg(F.aggregate(sorted_, empty, take).alias("m"))
    return got.select(*groups, F.explode("m").alias("m")).select(*groups, (-F.col("m.ti")).alias("teacher_idx"), (-F.col("m.si")).alias("student_idx"), (-F.col("m.s")).alias("sim"))


def precision(matched: Column, teacher: Column, student: Column) -> Column:
    return F.when(teacher > 0, F.coalesce(F.try_divide(matched, student), F.lit(0.0))).when(student == 0, 1.0)


def recall(matched: Column, teacher: Column, student: Column) -> Column:
    return F.when(teacher > 0, matched / teacher).when(student == 0, 1.0)


def evidence_level(sim: Column, overlap: Column) -> Column:
    return F.when((sim > STRONG_SIM) | (overlap > STRONG_OVERLAP), 1.0).when((sim > WEAK_SIM) | (overlap > WEAK_OVERLAP), 0.5).otherwise(0.0)


def best_evidence(levels: DataFrame, groups: list[str]) -> DataFrame:
    """Grounding of each item from (groups..., idx, level, sim, is_user): idx is null for text that is no chat line.

    The best line counts only with a level above 0; equal ones go to the first.
    """
    chat = F.col("idx").isNotNull()
    user, persona = F.max(F.when(F.col("is_user") | ~chat, F.col("level"))), F.max(F.when(chat & ~F.col("is_user"), F.col("level")))
    best = F.max_by(F.when(chat, F.col("idx")), F.when(chat, F.struct("level", "sim", -F.col("idx"))))
    got = levels.groupBy(*groups).agg(F.max("level").alias("grounding"), user.alias("u"), persona.alias("p"), best.alias("line"), F.max(F.when(chat, F.col("level"))).alias("c"))
    is_user = F.when(F.col("u") >= 0.5, True).when(F.col("p") >= 1.0, False)
    return got.select(*groups, "grounding", F.when(F.col("c") > 0, F.col("line")).alias("evidence_line_index"), is_user.alias("evidence_is_user"))


def closeness(a: Column, b: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / 9), F.lit(0.0))


def weighted_total(dims: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the dimensions that are not null, to 4 places; 0 if none is. An unknown dimension is an error."""
    if unknown := set(dims) - set(weights):
        raise ValueError(f"unknown dimensions: {sorted(unknown)}")
    zero = F.lit(0.0)
    total, weight = zero, zero
    for k in weights:
        if k in dims:
            total = total + F.coalesce(dims[k] * weights[k], zero)
            weight = weight + F.when(dims[k].isNotNull(), weights[k]).otherwise(0.0)
    return F.coalesce(round_places(F.try_divide(total, weight)), zero)


def judge(*_: object) -> None:
    raise NotImplementedError("judging by a model is reserved")


def details_summary(df: DataFrame, key: str, details: str) -> DataFrame:
    """Speaker attribution, grounding mean and hallucination share of a sample's memory details; null where none applies.

    Null lists and null elements count as none.
    """
    items = df.select(key, F.explode(F.expr(f"filter({details}.memory_details, x -> x is not null)")).alias("d")).select(key, "d.*")
    judged = (F.col("grounding") >= 0.5) & F.col("evidence_is_user").isNotNull()
    got = items.groupBy(key).agg(
        F.avg(F.when(judged, F.col("evidence_is_user").cast("int"))).alias("speaker"), F.avg("grounding").alias("grounding_mean"), F.avg((F.col("grounding") == 0).cast("int")).alias("hallucination"), F.count("*").alias("n_items")
    )
    return got


def attribution(grounding_user: Column, grounding_persona: Column, grounding_prior: Column) -> Column:
    """Class of a memory item by what supports it."""
    return (
        F.when((grounding_persona >= 1) & (grounding_user < 0.5), "TRUE_ERR").when((grounding_persona >= 1) & (grounding_user >= 0.5), "ECHO").when(grounding_user >= 0.5, "USER_OK").when(grounding_prior >= 0.5, "CARRIED").otherwise("NO_EVIDENCE")
    )


def clean_filter(speaker: Column, json_valid: Column) -> Column:
    return (F.coalesce(speaker, F.lit(1.0)) >= 1) & F.coalesce(json_valid >= 1, F.lit(False))


def high_risk_reasons(d: dict[str, Column], finish_reason: Column) -> Column:
    """Ordered names of the failing conditions; a null score fails none."""
    low = lambda c, name: F.when(c < 0.6, name)
    parts = [F.when(d["json_valid"] != 1, "json_invalid"), low(d["intent_score"], "intent_low"), F.when(finish_reason == "length", "truncated")]
    parts += [low(d[c], c) for c in ("memory_precision", "memory_recall", "speaker_attribution", "summary_score", "other")]
    parts.append(F.when(d["hallucination_penalty"] > 0.2, "hallucination_high"))
    return F.array_compact(F.array(*parts))
