"""Rules on the pages of a book and the blocks of a page: scans, contents pages, part headers, joining, columns, bands."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.korean import BOUND, PAIRS
from quillspark.functions.text import BLOCK_START, strip
from quillspark.operators.corpus import exploded_lines, first_per

# What a contents page looks like.
CONTENTS = {"lines": 12, "mean": 30, "numeric": 0.2, "sentences": 3, "chars": 1300}
# Patterns of a line that ends in a page number, of a Korean sentence end, of a part title and of a tag.
NUMBER_END, SENTENCE_END = r"(?:^|\s|[가-힣.])\d{1,3}$", r"[다요죠][.!?]?(?:\s|$)"
PART, TAG = r"(?i)\bpart\s?\d", "#[가-힣A-Za-z]"
#: A text layer with fewer characters a page than this is that of a scan.
SCAN_CHARS = 20


def contents_page(text: Column) -> Column:
    """Many short lines, a fifth of which end in a number, and few sentences unless the page is short. Null: false."""
    text = F.coalesce(text, F.lit(""))
    rows = F.filter(F.transform(F.split(text, "\r\n|\r|\n", -1), strip), lambda x: x != "")
    n = F.size(rows)
    chars = F.aggregate(rows, F.lit(0), lambda acc, x: acc + F.length(x))
    numeric = F.size(F.filter(rows, lambda x: x.rlike(NUMBER_END)))
    prose = (F.regexp_count(text, F.lit(SENTENCE_END)) > CONTENTS["sentences"]) & (F.length(text) > CONTENTS["chars"])
    return (n >= CONTENTS["lines"]) & ~prose & (chars <= CONTENTS["mean"] * n) & (numeric >= CONTENTS["numeric"] * n)


def part_contents_page(text: Column) -> Column:
    """A part's title with three tags or more. Null: false."""
    text = F.coalesce(text, F.lit(""))
    return text.rlike(PART) & (F.regexp_count(text, F.lit(TAG)) >= 3)


def scans(pages: DataFrame) -> DataFrame:
    """doc, pages, chars, scan: whether a document's pages have under SCAN_CHARS characters on average."""
    sums = pages.groupBy("doc").agg(F.count("*").alias("pages"), F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"))
    return sums.withColumn("scan", F.col("chars") < SCAN_CHARS * F.col("pages"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc, body: the pages (doc, page, text) in order. A blank line follows a page that ends a sentence, else a space.

    Pages without text go; of a document without any, no row is left. Pages of the same number are ordered by text.
    """
    bare = pages.select("doc", "page", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''")
    piece = F.concat("text", F.when(F.col("text").rlike("[.!?…:;]$"), "\n\n").otherwise(" "))
    all_of = bare.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", piece.alias("piece")))).alias("all"))
    return all_of.select("doc", F.regexp_replace(F.array_join(F.col("all.piece"), ""), r"(?: |\n\n)\z", "").alias("body"))


_block, _closed = re.compile(BLOCK_START.removeprefix("(?U)")).match, re.compile(r"(?:[.!?…:;]|[.!?][\"'])$").search
_pairs = frozenset((x, y) for x, y, _ in PAIRS)


def seam(last: str, first: str) -> str:
    """What stands between two pages whose text meets in two lines: nothing where a word is cut, a space where a sentence is."""
    goes_on = re.search("[가-힣,]$", last) and (re.match("[가-힣]", first) or first[:1].islower())
    if not goes_on or _block(last) or _block(first) or _closed(last):
        return "\n\n"
    a, b = last.split()[-1], first.split()[0]
    return "" if b in BOUND or (a, b) in _pairs or max(len(a), len(b)) <= 2 else " "


@F.pandas_udf(StringType())
def _rejoined(pages: pd.Series) -> pd.Series:
    def one(texts) -> str:
        out: list[str] = []
        last = ""  # the last line of the text so far, whichever pages it came from
        for text in texts:
            lines = [x.strip() for x in text.splitlines() if x.strip()]
            gap = seam(last, lines[0]) if out else ""
            out += [gap, text]
            last = lines[-1] if len(lines) > 1 or gap == "\n\n" else last + gap + lines[0]
        return "".join(out)

    return pages.map(one)


def rejoined_pages(pages: DataFrame) -> DataFrame:
    """doc, body: the pages (doc, page, text) in order, with a sentence that a page end cuts made whole.

    It goes on without a space if the page end cuts a word (a bound fragment, a pair often split, or two short words),
    else with one; other pages are paragraphs apart. The word before is sought in the text joined so far. Pages without
    text go. A document's pages meet in one task.
    """
    bare = pages.select("doc", "page", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''")
    all_of = bare.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("all"))
    return all_of.select("doc", _rejoined("all.text").alias("body"))


def edge_lines(pages: DataFrame, n: int = 2) -> DataFrame:
    """page, line_no, line: a page's first and last n lines that aren't blank."""
    w = Window.partitionBy("page")
    rows = exploded_lines(pages, "page").where(F.trim("line") != "")
    rows = rows.withColumns({"up": F.row_number().over(w.orderBy("line_no")), "down": F.row_number().over(w.orderBy(F.desc("line_no")))})
    return rows.where(F.least("up", "down") <= n).select("page", "line_no", "line")


def part_headers(lines: DataFrame) -> DataFrame:
    """The lines (doc, page, line_no, line) without repeated bare part headers: the first of each number stays."""
    part = F.nullif(F.regexp_extract("line", r"(?i)^\s*part\s*(\d{1,2})\s*$", 1), F.lit(""))
    marked = lines.withColumn("_part", part)
    first = first_per(marked.where("_part is not null"), ["doc", "_part"], [F.col("page"), F.col("line_no")])
    return marked.where("_part is null").unionByName(first).drop("_part")


def gutters(blocks: DataFrame, least: int = 6) -> DataFrame:
    """page, gutters: the middles of empty vertical strips that part a page's columns, from left to right.

    blocks: page, x0, x1. Blocks wider than 60 % of what is filled don't count, nor do strips beyond its middle 76 % or
    narrower than `least`. Places are cut to whole points from the left edge. A strip is what lies between the furthest right
    edge so far and the next left edge, so it takes one sort by page and no histogram.
    """
    by = Window.partitionBy("page")
    left = F.min("x0").over(by)
    b = blocks.select("page", "x0", "x1", left.alias("left"), (F.max("x1").over(by) - left).alias("span"))
    narrow = b.where("x1 - x0 <= span * 0.6").withColumn("n", F.count("*").over(by)).where("n >= 2")
    start, stop = F.floor(F.col("span") * 0.12), F.floor(F.col("span") * 0.88)
    cut = narrow.select("page", "left", start.alias("start"), stop.alias("stop"), F.floor(F.col("x0") - F.col("left")).alias("a"), F.floor(F.col("x1") - F.col("left")).alias("z")).where("z > a")
    edge = cut.select("page", "left", "start", "stop", F.col("stop").alias("a"), F.col("stop").alias("z")).distinct()
    seen = F.max("z").over(by.orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1))
    strip = cut.unionByName(edge).withColumn("seen", seen).select("page", "left", F.greatest(F.coalesce("seen", "start"), "start").alias("g0"), F.least("a", "stop").alias("g1"))
    found = strip.where(F.col("g1") - F.col("g0") >= least)
    return found.groupBy("page").agg(F.array_sort(F.collect_set(F.col("left") + (F.col("g0") + F.col("g1")) / 2)).alias("gutters"))


def cuts(edges: Column, height: Column) -> Column:
    """Where wide blocks part a page into bands: their edges in order, at least 20 apart, none near the top or the foot."""
    inner = F.filter(F.array_sort(F.array_distinct(edges)), lambda y: (y > 60) & (y < height - 120))
    far = lambda acc, y: F.coalesce(y - F.get(acc, F.size(acc) - 1) >= 20, F.lit(True))
    return F.aggregate(inner, F.array().cast("array<double>"), lambda acc, y: F.when(far(acc, y), F.concat(acc, F.array(y))).otherwise(acc))


def band(cy: Column, cut: Column) -> Column:
    """The band that a centre lies in: how many cuts lie at or above it."""
    return F.size(F.filter(cut, lambda y: y <= cy))
