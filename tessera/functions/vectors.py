"""Vectors as ARRAY<FLOAT>, and embedding of distinct texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 for a null, an empty or a zero vector."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.coalesce(F.when(norm > 0, _dot(a, b) / norm), F.lit(0.0))


def hash_embedder(dimensions: int = 256) -> Callable[[list[str]], np.ndarray]:
    """Texts to unit vectors of hashed words and word pairs; needs no model and no network."""

    def encode(texts: list[str]) -> np.ndarray:
        digest, hashes, ends = xxhash.xxh3_64_intdigest, [], [0]
        for text in texts:
            words = text.lower().split()
            hashes += map(digest, words)
            hashes += map(digest, map(" ".join, zip(words, words[1:])))
            ends.append(len(hashes))
        h = np.array(hashes, np.uint64)
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        at = row * dimensions + (h % np.uint64(dimensions)).astype(np.int64)
        out = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * dimensions).reshape(len(texts), dimensions).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


def embed_texts(df: DataFrame, *columns: str, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(text, vector) of every distinct text of the columns, each encoded once; nulls and empty texts are left out."""
    embed = encode or hash_embedder()
    texts = df.select(F.explode(F.array(*columns)).alias("text")).where("text is not null and text <> ''").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text": pdf.text, "vector": list(embed(pdf.text.tolist()))})

    return texts.mapInPandas(run, "text string, vector array<float>")


def with_vectors(df: DataFrame, vectors: DataFrame, *columns: str) -> DataFrame:
    """df with <column>_vector beside each text column."""
    for c in columns:
        df = df.join(vectors.select(F.col("text").alias(c), F.col("vector").alias(f"{c}_vector")), c, "left")
    return df
