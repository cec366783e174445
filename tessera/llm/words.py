"""Words of prompt bodies as 64-bit ids, fast enough for one pass over a corpus."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
import xxhash

from tessera.functions.promptx import BODY_TITLES

#: ASCII letters to lower case, other ASCII bytes to a space; bytes of other characters stay.
_TABLE = bytes((b | 32 if chr(b).isalpha() else 32) if b < 128 else b for b in range(256))
_WORD = regex.compile(r"\p{Han}|[\p{L}--\p{Han}]+", regex.V1)
_TITLES = frozenset(t.encode() for t in BODY_TITLES)


def word_id(word: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Vocabulary(dict):
    """Token bytes to a word id, or to a tuple of ids where it holds other than ASCII letters."""

    LIMIT = 400_000

    def __missing__(self, token: bytes):
        if token.isascii():
            value = word_id(token)
        else:
            value = tuple(map(word_id, _WORD.findall(unicodedata.normalize("NFKC", token.decode("utf-8", "replace")).casefold())))
            if len(token) > 60:  # seldom seen again
                return value
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = value
        return value


def body_bytes(prompt: bytes) -> bytes:
    """The bodies of user information, old summary, old memory and chat."""
    parts = []
    for part in (b"\n" + prompt).split(b"\n##")[1:]:
        if part[:1] in (b" ", b"\t"):
            title, _, rest = part.partition(b"\n")
            if title.strip() in _TITLES:
                parts.append(rest)
        elif parts:  # a line that begins with more signs is no heading
            parts[-1] += b"\n##" + part
    return b"\n".join(parts)


def word_ids(text: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids in the order of the text, after NFKC and case folding."""
    out: list[int] = []
    for token in text.translate(_TABLE).split():
        value = vocabulary[token]
        if type(value) is int:
            out.append(value)
        else:
            out.extend(value)
    return out


def bag(ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids (as signed 64-bit) and how often each occurs."""
    if not ids:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    values, counts = np.unique(np.array(ids, np.uint64).view(np.int64), return_counts=True)
    return values, counts.astype(np.int32)
