"""Cleaning whole Markdown texts: what is prose is refined; front matter, code and data tables stay as they are.

A text is dealt into segments, prose goes through its chain, and the segments are put together again, in one call for each text.
"""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import prose
from quillspark.functions import text as X

# What makes a table one of layout: characters of a line, pipes beside a rule, characters beside a break, of a cell.
LINE, PIPES, BROKEN_LINE, CELL = 250, 12, 120, 60
FRONT = re.compile(r"---\s*\n.*?\n---\s*\n", re.DOTALL)
_rule = re.compile(r":?-+:?")
_break = re.compile(r"<br\s*/?>")


@F.pandas_udf(StringType())
def _refined_plain(text: pd.Series) -> pd.Series:
    return text.map(prose.refine)


def refined_plain(c: Column) -> Column:
    """The chain for prose: characters, line ends, margins, noise lines, particles, paragraphs, Korean, punctuation, spaces. A last line end goes."""
    return _refined_plain(X.text(c))


def _row(line: str) -> bool:
    line = line.strip()
    return line.startswith("|") and line.endswith("|")


def _cells(line: str) -> list[str]:
    return [c for c in (x.strip() for x in line.split("|")) if c and not _rule.fullmatch(c)]


def layout_table(rows: list[str]) -> bool:
    """Rows that hold text set in a table, not data."""
    return any(
        len(x) > LINE or ("---" in x and x.count("|") > PIPES) or (_break.search(x) and len(x) > BROKEN_LINE) or any(len(c) > CELL for c in _cells(x))
        for x in rows
    )


def segments(text: str) -> list[tuple[int, bool, str]]:
    """(chunk, whether it is prose, text): chunks lie between code fences, odd ones are code; front matter is chunk -1."""
    front = FRONT.match(text)
    out = [(-1, False, front[0])] if front else []
    for k, chunk in enumerate(text[front.end() if front else 0 :].split("```")):
        if k % 2:
            out.append((k, False, chunk))
            continue
        lines: list[str] = []
        for table, rows in groupby(chunk.split("\n"), _row):
            rows = list(rows)
            if table and layout_table(rows):
                cells = (c for x in rows for c in _cells(x))
                rows = [p.strip() for c in cells for p in _break.sub("\n", c).replace("\\|", "|").split("\n") if p.strip()] + [""]
            lines += rows
        out += [(k, not table, "\n".join(rows)) for table, rows in groupby(lines, _row)]
    return out


def cleaned(text: str) -> str:
    """A text cleaned: its prose refined, its segments put together again by chunks, code fences between them."""
    front, chunks = "", []
    for k, parts in groupby(segments(text), lambda s: s[0]):
        chunk = "\n".join(prose.refine(t) if plain else t for _, plain, t in parts)
        if k < 0:
            front = chunk
        else:
            chunks.append(re.sub("\n{3,}", "\n\n", chunk) if k % 2 == 0 else chunk)
    body = prose.strip("```".join(chunks))
    return f"{front}{body}\n" if front or body else ""


@F.pandas_udf(StringType())
def _cleaned(text: pd.Series) -> pd.Series:
    return text.map(cleaned)


def refined_markdown(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: each text cleaned, a row for each row; null counts as empty and gives an empty text."""
    return docs.select(key, _cleaned(X.text("text")).alias("text"))
