"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def fence_body(text: Column) -> Column:
    """Body of the first code fence, empty where there is none."""
    return F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def bare_lines(text: Column) -> Column:
    """Lines without bullets and spaces around them; blank lines are left out."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[- ]+|[- ]+$", "")))


def word_set(text: Column) -> Column:
    """Distinct lower-case ASCII words and pairs of neighbouring Chinese characters; a lone one stands for itself."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1)
    runs = F.regexp_extract_all(low, F.lit("([一-鿿]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substr(r, k, F.lit(2))))))
    return F.array_distinct(F.concat(words, pairs))


_WORDS = re.compile("[a-z0-9]+|[一-鿿]+")


def words(text: str) -> set[str]:
    """word_set in plain Python."""
    found = set(_WORDS.findall(text.lower()))
    if not text.isascii():
        for run in [x for x in found if len(x) > 1 and x[0] >= "一"]:
            found.remove(run)
            found.update(run[k : k + 2] for k in range(len(run) - 1))
    return found


def overlap(item: Column, line: Column) -> Column:
    """Share of the item's words that the line has; 0 for no words."""
    own = word_set(item)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, word_set(line))), F.size(own)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty give 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def shingles(text: Column, window: int = 256, stride: int = 192) -> Column:
    """SHA-1 prefixes of windows; a shorter text of at least half a window is one, a tail past the last full window none."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(stride))
    keys = F.transform(starts, lambda s: F.substring(F.sha1(F.substr(text, s + 1, F.lit(window))), 1, 16))
    return F.when(n >= window // 2, F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def joined_url(base: Column, path: str) -> Column:
    """base without trailing slashes, then the path."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/" + path.lstrip("/")))


def word_count(texts: list[str]) -> list[int]:
    """Tokens of each text where no model's tokenizer is given: words, Chinese characters and other signs."""
    return [len(re.findall(r"[㐀-鿿]|[^\W㐀-鿿]+|[^\w\s]", t)) for t in texts]


def chat_text(prompt: str, output: str) -> str:
    """A pair as the chat template of training lays it out."""
    return f"<|im_start|>user\n{prompt}<|im_end|>\n<|im_start|>assistant\n{output}<|im_end|>\n"
