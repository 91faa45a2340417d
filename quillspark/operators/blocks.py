"""Text blocks of a page column into paragraphs, and recognised lines of a scan into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import strip
from quillspark.operators.corpus import upper_median

# Endings and particles that begin no word, so a block that starts with one goes on with the word before.
BOUND = ["며", "으며", "니", "으니", "니까", "지만", "면서", "도록", "거나", "는데", "은데", "으면", "는", "은", "을", "를", "에", "의", "에서", "에게", "으로", "로", "께서", "었다", "았다", "였다", "했다", "한다", "된다", "합니다", "입니다", "습니다", "니다"]
# Bullets, sentence ends, a line of an index, the share of the median that makes a full line, the gaps.
BULLET, ENDED = r"^(?:[-•▶※*①②③]|[1-5]\.)", r"[.!?…:]$"
INDEX_ENTRY = r"[가-힣A-Za-z)]\s*,?\s+\d{1,4}(?:[-–~]\d{1,4})?(?:\s*,\s*\d{1,4}(?:[-–~]\d{1,4})?)*\s*$"
FULL, GAP, GAP_ENDED = 0.75, 16, 8


def paragraphs(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, run, text: blocks (keys, order, text, y0, y1, is_table) of a column joined where a paragraph goes on.

    Only neighbours decide, so it is a lag and a running sum over the column. A table stands alone; blocks without text go;
    null is_table counts as false, null places as no gap. Equal orders are ordered by place and text.
    """
    by = Window.partitionBy(*keys)
    at = by.orderBy(order, "y0", "text")
    b = blocks.select(*keys, order, "y0", "y1", F.coalesce("is_table", F.lit(False)).alias("is_table"), F.coalesce("text", F.lit("")).alias("raw"))
    b = b.withColumn("text", F.when(F.col("is_table"), F.col("raw")).otherwise(strip(F.col("raw")))).where("is_table or text <> ''")
    rows = F.transform(F.split("text", "\n", -1), strip)
    sizes = F.when(~F.col("is_table"), F.transform(F.filter(rows, lambda x: x != ""), lambda x: F.length(x))).otherwise(F.array().cast("array<int>"))
    b = b.withColumns({"rows": rows, "full": F.coalesce(upper_median(F.flatten(F.collect_list(sizes).over(by))) * FULL, F.lit(0.0))})
    b = b.withColumns({"prev": F.lag("text").over(at), "prev_end": F.lag(F.element_at("rows", -1)).over(at), "prev_y1": F.lag("y1").over(at), "prev_table": F.lag("is_table").over(at)})
    gap = F.coalesce(F.col("y0") - F.col("prev_y1"), F.lit(0.0))
    text, ended = F.col("text"), F.col("prev").rlike(ENDED)
    bound = F.col("prev_end").rlike("[가-힣]$") & F.regexp_extract(text, "^[가-힣]+", 0).isin(BOUND)
    label = ended & (F.size("rows") == 1) & (F.length(text) < F.col("full")) & ~bound & ~text.rlike("[.!?…:”\"]$")
    short = (F.length("prev_end") < F.col("full")) & ~bound
    index = F.col("prev_end").rlike(INDEX_ENTRY) & F.get("rows", F.lit(0)).rlike(INDEX_ENTRY)
    new = F.col("prev").isNull() | F.col("prev_table") | F.col("is_table") | text.rlike(BULLET) | (ended & (gap > GAP_ENDED)) | (gap > GAP) | short | label | index
    b = b.withColumns({"new": new, "piece": F.concat(F.when(new | bound, "").otherwise(" "), text), "nth": F.row_number().over(at)})
    b = b.withColumn("run", F.sum(F.col("new").cast("int")).over(at))
    out = b.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("nth", "piece"))).alias("all"))
    return out.select(*keys, "run", F.array_join("all.piece", "").alias("text"))


def scan_rows(lines: Column) -> Column:
    """array<struct<text, x0, y0, x1, y1>> of a page to array<struct<text, y0, y1, h>> of its rows from the top.

    A line belongs to the row at hand if its middle is nearer to that of the row's first line than 12 points or half the
    row's mean height so far; that state makes it a fold. Null arrays give null.
    """
    each = F.transform(lines, lambda x: F.struct(x["y0"].alias("y0"), x["x0"].alias("x0"), x["y1"].alias("y1"), ((x["y0"] + x["y1"]) / 2).alias("cy"), (x["y1"] - x["y0"]).alias("h"), x["text"].alias("text")))
    kind = "array<struct<y0:double,x0:double,y1:double,cy:double,h:double,text:string>>"
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        row = acc["row"]
        mean = F.aggregate(row, F.lit(0.0), lambda s, y: s + y["h"]) / F.nullif(F.size(row), F.lit(0))
        same = F.coalesce(F.abs(x["cy"] - F.get(row, F.lit(0))["cy"]) < F.greatest(F.lit(12.0), mean * 0.5), F.size(row) == 0)
        return F.struct(F.when(same, acc["done"]).otherwise(F.concat(acc["done"], F.array(row))).alias("done"), F.when(same, F.concat(row, F.array(x))).otherwise(F.array(x)).alias("row"))

    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), none.alias("row"))
    rows = F.aggregate(F.array_sort(each).cast(kind), zero, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["row"])), lambda r: F.size(r) > 0))

    def merged(r: Column) -> Column:
        across = F.array_sort(F.transform(r, lambda x: F.struct(x["x0"].alias("x0"), x["y0"].alias("y0"), x["text"].alias("text"))))
        return F.struct(F.array_join(F.transform(across, lambda x: x["text"]), " ").alias("text"), F.array_min(F.transform(r, lambda x: x["y0"])).alias("y0"), F.array_max(F.transform(r, lambda x: x["y1"])).alias("y1"), F.array_max(F.transform(r, lambda x: x["h"])).alias("h"))

    return F.transform(rows, merged)
