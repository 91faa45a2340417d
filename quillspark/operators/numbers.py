"""Page numbers left at the edges of pages: candidates, those that neighbours confirm, and their removal.

Pages are rows (doc, page, text). A number is a page number if two pages near by carry one that differs by as much as they
are apart; so it is found by a window over (doc, number minus page) and not by comparing pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.corpus import page_numbers

# Lines at a page's edge, how near and how many pages must agree, pages on which a running title recurs, its letters.
EDGE, REACH, PAIRS, RUNNING, LEAST, KEY = 2, 3, 2, 3, 4, 20
# A number alone, at a line's end, at its head; labels after which a number counts parts, not pages.
ALONE = r"(?U)^\s*\|?\s*([1-9]\d{0,3})\s*\|?\s*$"
AT_END = r"(?U)(?<=[^\d\s(\[‘'\"“·][\s|])\s*\|?\s*([1-9]\d{0,3})\s*\|?\s*$"
AT_HEAD = r"(?U)^\s*\|?\s*([1-9]\d{0,3})\s*\|?\s+(?=\S)"
LABEL = r"(?:PART|Part|part|CHAPTER|Chapter|STEP|Step|No\.?|제)\s*$"


def running_key(c: Column) -> Column:
    """The first letters of a line, by which running titles are known."""
    return F.substring(F.regexp_replace(c, "[^가-힣A-Za-z]", ""), 1, KEY)


def edge_lines(pages: DataFrame) -> DataFrame:
    """doc, page, line_no, line: a page's first and last lines that aren't blank."""
    solid = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: F.trim(x["line"]).rlike(r"\S"))
    p = pages.select("doc", "page", solid.alias("s"))
    edge = F.filter("s", lambda x, i: (i < EDGE) | (i >= F.size("s") - EDGE))
    return p.select("doc", "page", F.explode(edge).alias("x")).select("doc", "page", "x.*")


def candidates(pages: DataFrame) -> DataFrame:
    """doc, page, line_no, value, rest: numbers at edges that could be page numbers, and the line without each."""
    lines = edge_lines(pages)
    bare = F.regexp_replace("line", r"(?U)\d", "")
    title = lines.select("doc", "page", running_key(bare).alias("key")).distinct().groupBy("doc", "key").agg(F.count("*").alias("n")).where((F.col("n") >= RUNNING) & (F.length("key") >= LEAST)).select("doc", "key")
    place = F.when(F.col("line").rlike(ALONE), F.lit("alone")).when(F.col("line").rlike(AT_END), F.lit("end")).when(F.col("line").rlike(AT_HEAD), F.lit("head"))
    found = lines.withColumn("place", place).where("place is not null")
    pattern = {"alone": ALONE, "end": AT_END, "head": AT_HEAD}
    pick = lambda f: F.coalesce(*(F.when(F.col("place") == k, f(v)) for k, v in pattern.items()))
    found = found.withColumns({"value": pick(lambda v: F.regexp_extract("line", v, 1)).cast("long"), "rest": F.trim(pick(lambda v: F.regexp_replace("line", v, " ")))})
    head = found.where("place = 'head'").withColumn("key", running_key(F.regexp_replace("line", AT_HEAD, ""))).join(title, ["doc", "key"], "left_semi")
    labelled = F.col("rest").rlike(LABEL)
    return found.where((F.col("place") != "head") & ~labelled).drop("line", "place").unionByName(head.select("doc", "page", "line_no", "value", "rest"))


def without_page_numbers(pages: DataFrame) -> DataFrame:
    """doc, page, text, removed: pages without their numbers; lines left empty go. Pages are counted in their order within a document."""
    order = F.row_number().over(Window.partitionBy("doc").orderBy("page")).cast("long")
    p = pages.select("doc", "page", F.coalesce("text", F.lit("")).alias("text")).withColumn("nth", order)
    marks = candidates(p.select("doc", F.col("nth").alias("page"), "text"))
    sure = page_numbers(marks, REACH, PAIRS).select("doc", "page", "value").distinct()
    drop = marks.join(sure, ["doc", "page", "value"], "left_semi").groupBy("doc", "page").agg(F.collect_list(F.struct("line_no", "rest")).alias("gone"))
    out = p.join(drop.withColumnRenamed("page", "nth"), ["doc", "nth"], "left")
    gone = F.map_from_entries(F.col("gone"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.coalesce(F.element_at(gone, i), x).alias("line"), F.element_at(gone, i).isNotNull().alias("cut")))
    kept = F.transform(F.filter(lines, lambda x: ~x["cut"] | (x["line"] != "")), lambda x: x["line"])
    return out.select("doc", "page", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
