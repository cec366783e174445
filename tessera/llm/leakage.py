"""Held-out passages inside a corpus.

The test items (a fixed, checked number) become a hash set of normalised
5-grams that is broadcast. Every document's token windows are looked up in it;
a window of 14 words with one error in nine holds a run of five equal words,
so no passage escapes. Hits are verified by an exact alignment of the runs.
"""

from __future__ import annotations

import html
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 5
WORDS, HAN = 14, 20
#: One error in so many words of the item.
RATE = 9
#: Bytes of all held-out texts that may be broadcast.
LIMIT = 64 << 20

_TAG = regex.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<br ?/?>")
_ESCAPE = regex.compile(r"\\u([0-9a-fA-F]{4})")
_BREAK = regex.compile(r"(?<=\p{L})[-‐­]\s*\n[ \t>#*|]*(?=\p{Ll})|[­​-‏⁠﻿]")
_WRAP = regex.compile(r"(?<=\p{Han}[^\n]{0,60}[\p{L}\p{N}])\n[ \t>#*|]*(?=[\p{L}\p{N}])")
_TOKEN = regex.compile(r"\p{Han}|[\p{L}\p{M}\p{N}--\p{Han}]+", regex.V1)


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, begin, end) in the normalised text; Chinese characters are words."""
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(normal(text))]


def normal(text: str) -> str:
    """Without case, markup, escapes and word breaks at line ends."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text).replace('\\"', '"').replace("\\n", "\n").replace("\\t", " ").replace("\\r", " ").replace("\\/", "/")
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if "\n" in text:
            text = _WRAP.sub("", text)  # Chinese text is wrapped inside words of other scripts too
    return _BREAK.sub("", text).casefold()


def words(text: str) -> list[str]:
    return _TOKEN.findall(normal(text))


def _ids(found: list[str], seen: dict[str, int]) -> np.ndarray:
    out = np.empty(len(found), np.uint64)
    for k, w in enumerate(found):
        value = seen.get(w)
        if value is None:
            if len(seen) > 500_000:
                seen.clear()
            value = seen[w] = xxhash.xxh3_64_intdigest(w)
        out[k] = value
    return out


def grams(ids: np.ndarray) -> np.ndarray:
    """A hash of each window of GRAM words."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(GRAM):
        value = (value ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


def longest(item: list[int], doc: list[int], hits: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(length, begin, end): most successive words of the item found in the document with at most one error in RATE, and their place there.

    Equal runs on diagonals close to a hit are chained; joining two runs costs
    the larger of the two gaps between them. Words at the ends may be among the errors.
    """
    diagonals = sorted({j - i for i, j in hits})
    at: dict[int, list[int]] = {}
    low, high = min(j - i for i, j in hits) - len(item) // RATE - 2, max(j - i for i, j in hits) + len(item) + len(item) // RATE + 2
    for j in range(max(0, low), min(len(doc), high)):
        at.setdefault(doc[j], []).append(j)
    slack = len(item) // RATE + 2
    runs: list[tuple[int, int, int]] = []
    for i, w in enumerate(item):
        for j in at.get(w, ()):
            if i and j and item[i - 1] == doc[j - 1]:
                continue
            k = bisect_left(diagonals, j - i - slack)
            if k == len(diagonals) or diagonals[k] > j - i + slack:
                continue
            n = 1
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            runs.append((i, j, n))
    runs.sort()
    best = (0, 0, 0)
    for a, (i0, j0, n0) in enumerate(runs):
        if (len(item) - i0) * RATE // (RATE - 1) <= best[0]:
            continue  # nothing longer begins here
        # fewest errors from the begin of run a to the end of run b
        errors: dict[int, int] = {a: 0}
        for b in range(a, len(runs)):
            e = errors.get(b)
            if e is None:
                continue
            i, j, n = runs[b]
            length = i + n - i0
            if e * RATE <= length + i0 + (len(item) - i - n):
                spare = min(max(0, (length - RATE * e) // (RATE - 1)), i0 + len(item) - i - n)
                if e * RATE <= length + spare and length + spare > best[0] and length >= RATE * e:
                    best = (length + spare, j0, j + n)
            for c in range(b + 1, len(runs)):
                i2, j2, n2 = runs[c]
                gi, gj = i2 - i - n, j2 - j - n
                if gi > slack:
                    break
                if i2 < i + 1 or j2 < j + 1 or (gi < 0 or gj < 0) and n2 + min(gi, gj) <= 0:
                    continue
                cost = max(gi, gj) - min(gi, gj, 0) if min(gi, gj) < 0 else max(gi, gj)
                if e + cost <= len(item) // RATE and e + cost < errors.get(c, 1 << 30):
                    errors[c] = e + cost
    return best


class Items:
    """The normalised held-out items and the sorted hashes of their grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.numbers, self.ids, self.least = [], [], []
        hashes, where, places = [], [], []
        seen: dict[str, int] = {}
        for number, text in rows:
            found = words(text or "")
            ids = _ids(found, seen)
            value = grams(ids)
            han = sum(1 for w in found if regex.match(r"\p{Han}", w))
            self.numbers.append(number), self.ids.append(ids.tolist()), self.least.append(HAN if 2 * han > len(found) else WORDS)
            hashes.append(value), where.append(np.full(len(value), len(self.ids) - 1)), places.append(np.arange(len(value)))
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.where, self.places = (np.concatenate(x)[order] if x else np.empty(0, np.int64) for x in (where, places))

    def find(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, length, begin, end) of each passage of an item in a document, the longest first; begin and end count its words."""
        value = grams(ids)
        if not len(value) or not len(self.hashes):
            return []
        at = np.searchsorted(self.hashes, value)
        hit = np.nonzero((at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == value))[0]
        if not len(hit):
            return []
        by: dict[int, list[tuple[int, int]]] = {}
        ends = np.searchsorted(self.hashes, value[hit], "right")
        for j, a, b in zip(hit.tolist(), at[hit].tolist(), ends.tolist()):
            for k in range(a, b):
                by.setdefault(int(self.where[k]), []).append((int(self.places[k]), j))
        doc = ids.tolist()
        out = []
        for item, hits in by.items():
            rest = doc
            while hits:
                length, begin, end = longest(self.ids[item], rest, hits)
                if length < self.least[item]:
                    break
                out.append((self.numbers[item], length, begin, end))
                # the same item may be there again: look at what lies outside the passage
                rest = rest[:begin] + [-1] * (end - begin) + rest[end:]
                hits = [(i, j) for i, j in hits if j + GRAM <= begin or j >= end]
        return out


FOUND = "doc long, item long, length int, begin int, end int"


def leaks(documents: DataFrame, key: str, text: str, held_out: DataFrame, item: str, item_text: str) -> DataFrame:
    """FOUND: each document with each item it contains 14 successive words of (Chinese items: 20 characters), a row for each such passage.

    length is the number of the item's words found; begin and end count the
    document's words (see ``tokens``). One pass without a shuffle for each 64 MB of items. Null
    and blank texts and items give no rows; a null document key stays null;
    repeated documents are repeated; an item listed twice counts once.
    """
    rows = held_out.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // LIMIT + 1
    out = None
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        # at most about LIMIT bytes
        sent = documents.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in part.orderBy("item", "text").collect()])

        def run(batches, sent=sent):
            items, seen = Items(sent.value), {}
            for whole in batches:
                columns: list[list] = [[] for _ in range(5)]
                for doc, t in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist()):
                    for row in items.find(_ids(words(t), seen)):
                        for column, value in zip(columns, (doc, *row)):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "item", "length", "begin", "end"])

        found = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("text is not null").mapInArrow(run, FOUND)
        out = found if out is None else out.union(found)
    return out


def without_spans(documents: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """(key, text) of all documents, without the found spans; the text of a document with spans comes out normalised."""

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if t and spans:
                    n, at = normal(t), tokens(t)
                    cut, kept = 0, []
                    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
                        first, last = at[begin][1], at[end - 1][2]
                        if first > cut:
                            kept.append(n[cut:first])
                        cut = max(cut, last)
                    t = "".join(kept) + n[cut:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], names=["key", "text"])

    spans = found.where("doc is not null").groupBy("doc").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # a document's own passages
    joined = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(spans, F.col("key") == F.col("doc"), "left")
    return joined.select("key", "text", "spans").mapInArrow(run, "key long, text string").select(F.col("key").alias(key), F.col("text").alias(text))
