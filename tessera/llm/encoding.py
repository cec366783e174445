"""Exact byte-pair encoding in linear time, and decoding.

A text is cut into pieces by the tokenizer's pattern. A piece is encoded from
left to right by the longest token at each place (Aho-Corasick). A token may
follow another only if byte-pair merging would keep the border between the two
(the compatibility of the pair); otherwise a shorter token is tried, and where
none is left the encoder steps back. Each place is given up at most once, so
the work is linear in the piece. Ids are those of merging by rank.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Tables of one vocabulary of (token bytes, rank) lines, and a bounded memory of pieces."""

    PIECES = 300_000

    def __init__(self, lines: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.shorter = [-1] * len(self.tokens)
        self.kept: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for rank, token in enumerate(self.tokens):
            if not token:
                continue
            self.automaton.add_word(token.decode("latin-1"), rank)
            for cut in range(len(token) - 1, 0, -1):
                a = ranks.get(token[:cut])
                if a is None:
                    continue
                b = ranks.get(token[cut:])
                if b is not None and a < rank and b < rank and self.compatible(a, b):
                    self.merged[a, b] = rank
                    self.left[rank], self.right[rank] = a, b
                    break
        self.kept.clear()
        for rank, token in enumerate(self.tokens):
            self.shorter[rank] = next((ranks[token[:cut]] for cut in range(len(token) - 1, 0, -1) if token[:cut] in ranks), -1)
        self.automaton.make_automaton()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(pattern).findall
        # the offset table of decoding
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.ends = np.cumsum(self.lengths)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b keeps the border between them."""
        x, y, bound = a, b, len(self.tokens)
        while True:
            joint = self.merged.get((x, y))
            if joint is not None and joint < bound:
                return False
            # undo the later of the two last merges; a joint token made before it would have crossed the border
            if x > y and self.left[x] != x:
                bound, x = x, self.right[x]
            elif self.left[y] != y:
                bound, y = y + 1, self.left[y]
            elif self.left[x] != x:
                bound, x = x, self.right[x]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        size = len(piece)
        longest = [-1] * (size + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - self.lengths[token]
            if longest[start] < 0 or self.lengths[longest[start]] < self.lengths[token]:
                longest[start] = token
        open_ = [True] * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            while token >= 0:
                end = at + self.lengths[token]
                if open_[end]:
                    if not out:
                        break
                    pair = (out[-1], token)
                    ok = self.kept.get(pair)
                    if ok is None:
                        if len(self.kept) > 1_000_000:
                            self.kept.clear()
                        ok = self.kept[pair] = self.compatible(*pair)
                    if ok:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, longest[end]
            else:
                open_[at] = False
                last = out.pop()
                at, token = at - self.lengths[last], self.shorter[last] if not open_[at] else last
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts give none. Strings that look special are text."""
        out: list[int] = []
        pieces = self.pieces
        for piece in self.split(text) if text else ():
            ids = pieces.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(pieces) >= self.PIECES:
                        pieces.clear()
                    pieces[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, gathered from one blob by an offset table."""
        if not len(ids):
            return b""
        ids = np.asarray(ids)
        length = np.asarray(self.lengths)[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) - np.repeat(ends - length, length) + np.repeat(self.ends[ids] - length, length)
        return self.blob[at].tobytes()


@lru_cache(maxsize=2)
def _encoder(lines: bytes, pattern: str) -> Encoder:
    return Encoder(lines, pattern)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids array<int>), one row for each row of df: no shuffle.

    The vocabulary (a fixed size, under 1 MB) is read by the driver and
    broadcast. Null and empty texts give an empty list, a null key stays
    null, repeated rows stay repeated, and other columns are not read.
    """
    with open(vocabulary, "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = _encoder(lines.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, ids array<int>").select(F.col("key").alias(key), "ids")


def decode_corpus(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of encoded rows; a null list gives a null text."""
    with open(vocabulary, "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = _encoder(lines.value, PATTERN)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "key long, text string").select(F.col("key").alias(key), "text")
