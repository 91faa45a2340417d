"""Markdown documents with front matter, and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A YAML double-quoted scalar; JSON's quoting is a subset of YAML's."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":(.*)\}$", 1)


_escaped = re.compile('["\\\\\x00-\x1f]')
_escapes = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted_text(text: str) -> str:
    """quoted() of one text."""
    return '"' + _escaped.sub(lambda m: _escapes.get(m[0]) or f"\\u{ord(m[0]):04X}", text) + '"'


def front_matter(fields: dict[str, Column], lists: dict[str, Column]) -> Column:
    """Fields in order, then lists of quoted items; an empty or null list is []."""
    parts = [F.concat(F.lit(f"{k}: "), quoted(F.coalesce(v.cast("string"), F.lit("")))) for k, v in fields.items()]
    for k, v in lists.items():
        items = F.transform(v, lambda x: F.concat(F.lit("\n  - "), quoted(x)))
        parts.append(F.when(F.coalesce(F.size(v), F.lit(0)) > 0, F.concat(F.lit(f"{k}:"), F.array_join(items, ""))).otherwise(f"{k}: []"))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *parts), F.lit("\n---\n"))


def split_front_matter(c: Column) -> tuple[Column, Column]:
    """The front matter's lines (null if there is none) and the body."""
    pattern = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    has = c.rlike(pattern)
    return F.when(has, F.regexp_extract(c, pattern, 1)), F.when(has, F.regexp_extract(c, pattern, 2)).otherwise(c)


def markdown(title: Column, summary: Column, body: Column, status: Column) -> Column:
    """Title, overview, body without a repeated title, quality note."""
    bare = F.regexp_replace(body, "^\\s*# [^\n]*\n+", "")
    same = F.trim(F.regexp_extract(body, "^\\s*# ([^\n]*)", 1)) == title
    return F.concat(F.lit("# "), title, F.lit("\n\n## 문서 개요\n\n"), summary, F.lit("\n\n## 본문 내용\n\n"), F.when(same, bare).otherwise(body), F.lit("\n\n## 변환 품질\n\n- "), status, F.lit("\n"))


def write_report(details: DataFrame, path: str) -> None:
    details.write.mode("overwrite").json(path)
