"""Whole pages from blocks of text: margins dropped, bands, columns in reading order, paragraphs.

Blocks are rows (doc, page, page_h, x0, y0, x1, y1, text, is_table). Every step is a window or an aggregation by page, so a
task holds pages, not documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import strip
from quillspark.operators import blocks as B
from quillspark.operators import corpus as O
from quillspark.operators import pages as P

# Marks of downloads and of running titles, heights of the margins, lengths of what stands in them.
DOWNLOADS, TITLES, SECTIONS = ["Downloaded by", "(PREMIUM)"], ["Dong-A Business Review", "DBR", "www.dongabiz.com"], ["Special Report"]
TOP, FOOT, LONGEST, SHORT = 55.0, 115.0, 80, 4
# Share of the page's and of a band's width from which a block counts as wide, how far a wide block may reach into the columns.
WIDE, FULL, OVERLAP = 0.55, 0.60, 15.0


def margin(text: Column, y0: Column, y1: Column, page_h: Column) -> Column:
    """A header, footer or download mark; blocks without text too."""
    t = strip(F.coalesce(text, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    short = F.length(t) < LONGEST
    top = (y0 < TOP) & short & (has(TITLES + SECTIONS) | t.rlike(r"(?U)^\d{1,4}(\s+[^\n]*)?$") | (F.length(t) <= SHORT))
    foot = (y1 > page_h - FOOT) & short & (has(TITLES) | t.rlike(r"^\d{1,4}$") | F.contains(t, F.lit("No.")))
    return (t == "") | has(DOWNLOADS) | top | foot


def page_texts(blocks: DataFrame) -> DataFrame:
    """doc, page, text: each page's blocks in reading order, as paragraphs.

    Wide blocks cut a page into bands; in a band, empty strips part columns; blocks over the columns go before or after
    them. Null is_table counts as false. A page without text has no row.
    """
    page = Window.partitionBy("doc", "page")
    b = blocks.select("doc", "page", "page_h", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_table", F.lit(False)).alias("is_table"))
    tables = b.where("is_table").select("doc", "page", "x0", "y0", "x1", "y1")
    plain = b.where(~F.col("is_table") & ~margin(F.col("text"), F.col("y0"), F.col("y1"), F.col("page_h")))
    plain = O.outside_tables(plain.withColumns({"cx": F.expr("(x0 + x1) / 2"), "cy": F.expr("(y0 + y1) / 2")}), tables).drop("cx", "cy")
    b = plain.unionByName(b.where(F.col("is_table") & (strip(F.col("text")) != "")))
    b = b.withColumns({"cx": F.expr("(x0 + x1) / 2"), "cy": F.expr("(y0 + y1) / 2"), "w": F.expr("x1 - x0"), "span": F.max("x1").over(page) - F.min("x0").over(page)})
    wide = F.col("w") > F.col("span") * WIDE
    edges = F.flatten(F.collect_list(F.when(wide, F.array(F.col("y0") - 2, F.col("y1") + 2)).otherwise(F.array().cast("array<double>"))).over(page))
    b = b.withColumn("edges", edges).withColumn("cuts", P.cuts(F.col("edges"), F.col("page_h").cast("double"))).withColumn("band", P.band(F.col("cy"), F.col("cuts"))).drop("edges", "cuts")
    band = Window.partitionBy("doc", "page", "band")
    b = b.withColumns({"full": F.col("w") > (F.max("x1").over(band) - F.min("x0").over(band)) * FULL, "alone": F.count("*").over(band) == 1})
    key = F.struct("doc", "page", "band")
    found = P.gutters(b.select(key.alias("page"), "x0", "x1")).select("page.*", "gutters")
    b = b.join(found, ["doc", "page", "band"], "left")
    cols = F.col("gutters").isNotNull()
    b = b.withColumn("col", F.when(cols & ~F.col("full"), O.column_of(F.col("cx"), F.col("gutters"))).when(~cols, F.lit(0)))
    top = F.min(F.when(F.col("col").isNotNull(), F.col("y0"))).over(band)
    # wide blocks of a band with columns stand alone, before the columns or after them
    part = F.when(F.col("col").isNotNull(), 0).when(F.col("y1") <= F.coalesce(top, F.lit(0.0)) + OVERLAP, -1).otherwise(1)
    b = b.withColumn("part", part).withColumn("col", F.coalesce("col", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("doc", "page", "band", "part", "col").orderBy("y0", "x0", "text"))
    b = b.withColumn("nth", nth)
    single = b.where("part <> 0 or alone").select("doc", "page", "band", "part", "col", F.col("nth").alias("run"), "text")
    inside = B.paragraphs(b.where("part = 0 and not alone"), ["doc", "page", "band", "part", "col"], "nth")
    rows = single.unionByName(inside.select(single.columns))
    parts = F.array_sort(F.collect_list(F.struct("band", "part", "col", "run", "text")))
    return rows.groupBy("doc", "page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))
