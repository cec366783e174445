"""Texts cut off by a limit of their source or in transfer.

Evidence, from all documents: (1) structure: an object, a marked-up paragraph
or a sentence that is left open; (2) a vocabulary trie: the last token is no
known word but a proper prefix of known ones; (3) what follows the last words
elsewhere: words after which texts do not end; (4) lengths, in characters or in bytes, that
are far more frequent in a source than those around. The trie's nodes are
table rows, made for the prefixes that last tokens ask about only (a hash filter of fixed size tells which), so nothing grows with the vocabulary on one machine.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.jsonx import _closing
from tessera.session import Scratch

# Patterns with (?r) are matched from the end of a text backwards, however long the match, so nothing before it is read.
# Marks put behind a cut.
MARK = regex.compile(r"(?r)(?:[ \t]*(?:…|\.\.\.+|\[\s*(?:…|\.\.\.|truncated|cut|more|continued|gekürzt|tronqué|recortado|截断|已截断)\s*\]|\((?:…|\.\.\.|truncated|cut|more|continued)\)|\(continued|<(?:truncated|cut|more)>|\u200b|\ufffd))+[ \t\u200b]*", regex.I)
DECOR = regex.compile(r"(?r)(?:[ \t]*(?:\p{So}|[\u2600-\u27bf]|\ufe0f|\u200d|\p{Sk}|:\)|:\(|;\)|:D|\{[^{}\n]*\}|\"[^\"\n]*\"|\)|\]|\*+|_+|\"|'|”|’|」|』))+[ \t]*")
END = regex.compile(r"(?r)[.!?。！？؟।][\"'”’)\]」』*_]*")
CLOSED = regex.compile(r"(?r)(?:</[A-Za-z][A-Za-z0-9]*|/)>")
#: A text that begins as an object or list, or as marked-up blocks; the begin of a list row, a chat row or a heading.
OBJECT = regex.compile(r"\{\s*[\"}]|\[\s*[\[{\"]")
MARKED_UP = regex.compile(r"<(?:p|div|ul|ol|h\d|html|body|article|section)\b", regex.I)
LEAD = regex.compile(r"\s*(?:[-*•] |\d\d:\d\d <|\[\d{4}-|\d\d/\d\d |#)")
SIGNATURE = regex.compile(r"\s*(?:--|[—–]|\p{L}+[,:：])\s*\p{Lu}\S*(?: \S+){0,2}$")
SENTENCE = regex.compile(r"[.!?。！？](?:\s|$|(?=\p{Han}))")
#: Signs behind which a text goes on.
GOES_ON = frozenset(",;:-–—([/&、，：；（<")
TOKEN = regex.compile(r"\p{Han}|[\p{L}\p{M}\p{N}--\p{Han}]+(?:['’][\p{L}\p{M}--\p{Han}]+)*", regex.V1)
_SPLIT = regex.compile(f"({TOKEN.pattern})", regex.V1)
UNIT_END = regex.compile(r"[\n.!?。！？…\"<{}\[\]]|\p{So}|:\)")
_DIGITS = regex.compile(r"\d+")
FEW, SEEN = 0.02, 20
#: Words and pairs counted in memory before a task hands them on.
HELD = 300_000
#: Places of the filter of words that are asked about; 256 kB.
SLOTS = 1 << 21


class _Words(dict):
    """Tokens as they are counted, digits as 0."""

    def __missing__(self, token: str) -> str:
        word = _DIGITS.sub("0", token) if any(c.isdigit() for c in token) else token
        if len(self) < HELD:
            self[token] = word
        return word


class _Gaps(dict):
    """Whether a unit ends in what stands between two tokens."""

    def __missing__(self, gap: str) -> bool:
        end = UNIT_END.search(gap) is not None
        if len(self) < HELD and len(gap) < 20:
            self[gap] = end
        return end


_words, _gaps = _Words(), _Gaps({" ": False, "": False})


def pieces(text: str) -> list[tuple[str, bool]]:
    """(token, digits as 0; whether a unit ends behind it) in order; the flag of the last is False."""
    parts = _SPLIT.split(text)
    gaps = parts[2::2]
    if gaps:
        gaps[-1] = " "
    return list(zip(map(_words.__getitem__, parts[1::2]), map(_gaps.__getitem__, gaps)))


def _word(token: str) -> str:
    return _words[token]


def look(text: str) -> dict:
    """Structural verdict of one text: cut True, False, or None with its last words."""
    none = {"cut": False, "bare": len(text), "bytes": len(text.encode("utf-8", "replace")), "word": None, "before": None, "mark": False, "prose": False, "signed": False}
    whole = text.rstrip()
    if not whole.strip("\u200b\ufeff \t\r\n"):
        return none
    found = MARK.match(whole)
    bare = whole[: found.start()] if found else text
    marked = found is not None
    out = none | {"bare": len(bare), "bytes": len(bare.encode("utf-8", "replace")), "mark": marked}
    if whole.endswith("\ufffd"):
        return out | {"cut": True}
    start = text.lstrip()
    if OBJECT.match(start):
        return out | {"cut": _closing(start, 0) < 0 if start[0] == "{" else not start.rstrip().endswith("]")}
    if MARKED_UP.match(start):
        tail = bare.rstrip()
        decor = DECOR.match(tail)
        return out | {"cut": CLOSED.match(tail, 0, decor.start() if decor else len(tail)) is None}
    if text.startswith("## ") and text.count("\n## ") >= 1:  # a rendered prompt ends with its last line's end
        return out | {"cut": not text.endswith("\n")}
    if text.endswith("\n") and not marked:
        return out
    bare = bare.rstrip()
    if END.match(bare):
        return out
    if DECOR.match(bare):
        return out | {"cut": None}  # complete but at a limit
    if bare[-1:] in GOES_ON:
        return out | {"cut": True}
    line = bare[bare.rfind("\n") + 1 :]
    lead = LEAD.match(line)
    last = [m for m in TOKEN.finditer(line)][-2:]
    if not last or last[-1].end() != len(line):
        return out | {"cut": None}
    signed = SIGNATURE.match(line) is not None and END.match(bare[: max(0, bare.rfind("\n"))].rstrip()) is not None
    prose = lead is None and not signed and SENTENCE.search(bare) is not None
    return out | {"cut": None, "word": _word(last[-1][0]), "before": _word(last[0][0]) if len(last) == 2 else "", "prose": prose, "signed": signed}


LOOKS = "key long, source string, cut boolean, bare int, bytes int, word string, before string, mark boolean, prose boolean, signed boolean, text_hash long"
def looks(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """LOOKS: the structural verdict of each text, null where only the corpus can tell."""

    def run(batches):
        for batch in batches:
            rows = [look(t) for t in batch.column("text").to_pylist()]
            kinds = {"cut": pa.bool_(), "bare": pa.int32(), "bytes": pa.int32(), "word": pa.string(), "before": pa.string(), "mark": pa.bool_(), "prose": pa.bool_(), "signed": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("source"), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items()), batch.column("text_hash")], names=["key", "source", *kinds, "text_hash"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).where("text is not null").mapInArrow(run, LOOKS)


def _slot(kind: str, word: str) -> int:
    """One of SLOTS places of a word asked about as the last one (w), the one before it (b), or of both (p)."""
    return zlib.crc32((kind + word).encode("utf-8", "replace")) % SLOTS


def asked_slots(asked: DataFrame) -> np.ndarray:
    """Which places the words of asked(before, word) have: a filter of fixed size; a place may be shared, which costs a row and harms nothing."""
    both = F.concat(F.lit("p"), "before", F.lit("\0"), "word")
    keys = asked.select(F.explode(F.array(F.concat(F.lit("w"), "word"), F.concat(F.lit("b"), "before"), both)).alias("k")).where("k is not null")
    places = keys.select((F.crc32(F.col("k").cast("binary")) % SLOTS).cast("int").alias("slot")).distinct()
    held = np.zeros(SLOTS, bool)
    held[places.toArrow().column(0).to_numpy()] = True  # SLOTS rows at most
    return held


def followed(df: DataFrame, text: str, asked: np.ndarray) -> DataFrame:
    """(before, word, n, ends, longer): how often each asked word occurs (before is null), each asked pair of words, and any word behind an asked one (word is null).

    ends: how often a unit ends there; longer: known words, as the tasks meet them, that the word is a proper prefix of.
    The last word of a text, which may be cut, isn't counted. Words nobody asks about are counted in the tasks only.
    """
    sent = df.sparkSession.sparkContext.broadcast(np.packbits(asked))

    def rows(counts: dict[tuple[str, str, bool], int], held: np.ndarray) -> pa.RecordBatch:
        found: dict[tuple[str | None, str | None], list[int]] = {}
        known: dict[str, bool] = {}
        first: dict[str, bool] = {}
        for (before, word, end), k in counts.items():
            last = known.get(word)
            if last is None:
                last = known[word] = bool(held[_slot("w", word)])
                for size in range(1, len(word)):
                    if held[_slot("w", word[:size])]:
                        found.setdefault((None, word[:size]), [0, 0, 0])[2] += 1
            keys = [(None, word)] if last else []
            b = first.get(before)
            if b is None:
                b = first[before] = bool(held[_slot("b", before)])
            if b:
                keys.append((before, None))
                if last and held[_slot("p", before + "\0" + word)]:
                    keys.append((before, word))
            for key in keys:
                at = found.setdefault(key, [0, 0, 0])
                at[0] += k
                at[1] += k * end
        columns = list(zip(*((*key, *value) for key, value in found.items()))) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["before", "word", "n", "ends", "longer"])

    def run(batches):
        held = np.unpackbits(sent.value).astype(bool)
        counts: dict[tuple[str, str, bool], int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                before = ""
                for word, end in pieces(t)[:-1]:
                    key = (before, word, end)
                    counts[key] = counts.get(key, 0) + 1
                    before = "" if end else word
                if len(counts) > HELD:
                    yield rows(counts, held)
                    counts.clear()
        yield rows(counts, held)

    got = df.select(F.col(text).alias("text")).where("text is not null").mapInArrow(run, "before string, word string, n long, ends long, longer long")
    return got.groupBy("before", "word").agg(*(F.sum(c).alias(c) for c in ("n", "ends", "longer")))


def limits(seen: DataFrame) -> DataFrame:
    """(source, measure, at): lengths of a source, in characters (bare) or bytes, that stand out.

    At least 4 different texts have the length, far more than the lengths
    within 20 let expect, and by other evidence (column loose) most are cut.
    """
    texts = seen.groupBy("source", "text_hash").agg(F.first("bare").alias("bare"), F.first("bytes").alias("bytes"), F.first("loose").alias("loose"))
    both = texts.select("source", F.lit("bare").alias("measure"), F.col("bare").alias("at"), "loose").union(texts.select("source", F.lit("bytes"), "bytes", "loose")).where("at >= 50")
    counts = both.groupBy("source", "measure", "at").agg(F.count("*").alias("n"), F.avg(F.col("loose").cast("int")).alias("loose"))
    around = Window.partitionBy("source", "measure").orderBy("at").rangeBetween(-20, 20)
    close = Window.partitionBy("source", "measure").orderBy("at").rangeBetween(-4, 4)
    rest = (F.sum("n").over(around) - F.sum("n").over(close)) / 32
    return counts.withColumn("rest", rest).where("n >= 4 and n >= 5 * rest + 4 * sqrt(rest) and loose >= 0.5").select("source", "measure", "at")


def truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, cut, at_limit) of every row whose text is neither null nor blank.

    cut is true where the structure is open; where the text stops without an
    end at a length limit of its source; in prose, where a sentence lacks its
    end; and where the last token is an unknown proper prefix of known words
    or one after which texts do not end. A signature line is cut only at a
    limit. A null source is a source of its own.
    """
    scratch = Scratch(df.sparkSession, "truncated")
    seen = scratch.keep(looks(df, key, text, source), "looks")
    asked = scratch.keep(seen.where("cut is null and word is not null").select("before", "word").distinct(), "asked")
    known = scratch.keep(followed(df, text, asked_slots(asked)), "followed")
    # longer: the node of the vocabulary trie, a proper prefix of so many known words
    one = known.where("before is null").select("word", F.col("n").alias("n1"), F.col("ends").alias("e1"), "longer")
    pair = known.where("before is not null and word is not null").select("before", "word", F.col("n").alias("n2"), F.col("ends").alias("e2"))
    any_ = known.where("word is null").select("before", F.col("n").alias("n3"), F.col("ends").alias("e3"))
    told = asked.join(one, "word", "left").join(pair, ["before", "word"], "left").join(any_, "before", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = F.when(n("n2") >= SEEN, n("e2") / n("n2")).when((n("n1") >= 4 * SEEN) | (n("n3") < SEEN), F.when(n("n1") > 0, n("e1") / n("n1"))).otherwise(n("e3") / n("n3"))
    told = told.select("before", "word", ((n("n1") == 0) & (n("longer") > 0)).alias("prefix"), F.coalesce(rate < FEW, F.lit(False)).alias("inner"))
    # the evidence of each text for itself; a signature line has none
    prose = F.col("prose") & ~F.col("mark") & F.col("word").isNotNull()
    alone = ~F.col("signed") & (prose | F.coalesce("prefix", F.lit(False)) | F.coalesce("inner", F.lit(False)))
    seen = scratch.keep(seen.join(told, ["before", "word"], "left").withColumn("loose", F.coalesce("cut", alone)), "evidence")
    spikes = limits(seen)
    char = spikes.where("measure = 'bare'").select(F.col("source").alias("s1"), F.col("at").alias("bare"), F.lit(True).alias("char_limit")).distinct()
    byte = spikes.where("measure = 'bytes'").select(F.col("source").alias("s2"), F.explode(F.expr("sequence(at - 3, at)")).alias("bytes"), F.lit(True).alias("byte_limit")).distinct()
    full = seen.join(char.withColumnRenamed("bare", "b1"), F.col("source").eqNullSafe(F.col("s1")) & (F.col("bare") == F.col("b1")), "left")
    full = full.join(byte.withColumnRenamed("bytes", "b2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("bytes") == F.col("b2")), "left")
    limit = F.coalesce("char_limit", F.lit(False)) | F.coalesce("byte_limit", F.lit(False))
    cut = F.col("loose") | (F.col("cut").isNull() & limit)
    return full.select("key", "source", cut.alias("cut"), limit.alias("at_limit"))
