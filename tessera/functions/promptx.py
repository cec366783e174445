"""Sections of a rendered prompt, as column expressions and as plain Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The titles that carry the sections' contents.
USER_TITLES = ("USER BASIC INFORMATION", "用户基本信息")
SUMMARY_TITLES = ("OLD ROLLING SUMMARY", "旧滚动摘要")
MEMORY_TITLES = ("OLD MEMORY SNAPSHOT", "旧记忆快照")
CHAT_TITLES = ("INCREMENTAL CHAT RECORDS", "增量聊天记录", "用户聊天记录")
BODY_TITLES = USER_TITLES + SUMMARY_TITLES + MEMORY_TITLES + CHAT_TITLES

_HEADING = re.compile(r"(?m)^##[ \t]+([^\n]*?)[ \t\r]*$")


def section(text: Column, titles: tuple[str, ...]) -> Column:
    """Body of the first section with one of the titles; null where there is none."""
    names = "|".join(re.escape(t).replace("\\ ", " ") for t in titles)
    found = F.regexp_extract(text, rf"(?sm)^##[ \t]+(?:{names})[ \t\r]*$\n?(.*?)(?=^##[ \t]|\z)", 1)
    return F.when(F.regexp_like(text, F.lit(rf"(?m)^##[ \t]+(?:{names})[ \t\r]*$")), found)


def sections(text: str | None) -> dict[str, str]:
    """Title to body, the first of equal titles."""
    out: dict[str, str] = {}
    if text:
        heads = list(_HEADING.finditer(text))
        for k, head in enumerate(heads):
            end = heads[k + 1].start() if k + 1 < len(heads) else len(text)
            out.setdefault(head[1], text[head.end() : end].strip("\r\n"))
    return out


def body(text: str | None) -> str:
    """The parts of a prompt that are no template, in their order."""
    if not text:
        return ""
    parts, heads = [], list(_HEADING.finditer(text))
    for k, head in enumerate(heads):
        if head[1] in BODY_TITLES:
            parts.append(text[head.end() : heads[k + 1].start() if k + 1 < len(heads) else len(text)])
    return "\n".join(parts)
