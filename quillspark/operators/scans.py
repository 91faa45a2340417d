"""Pages of scans from recognised lines: margins dropped, rows, noise cleaned, paragraphs, the chain of text rules.

Lines are rows (doc, page, text, score, x0, y0, x1, y1, page_w, page_h). Recognition itself is a function that the caller
gives; it runs on Arrow batches of images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import korean, noise
from quillspark.functions import text as X
from quillspark.functions.unicode import nfkc
from quillspark.operators import blocks as B
from quillspark.operators import books, corpus, numbers
from quillspark.session import settled

# Share of the page that its top and foot take; running titles beside a page number.
HEAD, FOOT = 0.12, 0.90
RUNNING = r"(?U)^\d{1,4}\s+[\w가-힣\s]{2,20}$|^[\w가-힣\s]{2,30}\s*\d{1,4}$"
# What opens a paragraph, a short row, endings that go on or close a sentence, gaps in heights of a row.
OPENS = r"(?iU)^(?:PART|CHAPTER|SECTION|제\s*\d+\s*[장절편]|부록|감사의\s*글|\d+[.．]\s|\||\[|#)"
SHORT, GOES_ON, ENDS, GAP_ENDED, GAP = 14, r"(?:,|와|과|및|등)$", r"[.!?…:;]$", 0.6, 1.5
#: What a recogniser gives of an image: text, score, box, and the image's size.
LINES = "doc string, page int, text string, score double, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"
Recogniser = Callable[[bytes], tuple[float, float, list[tuple[str, float, float, float, float, float]]]]


def recognised(images: DataFrame, reader: Recogniser) -> DataFrame:
    """images: doc, page, content. The lines that `reader` finds: it takes an image's bytes and returns its width, height and
    (text, score, x0, y0, x1, y1) of each line. An image that it fails on has no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 7]
        for b in batches:
            rows = []
            for doc, page, raw in zip(b["doc"].to_pylist(), b["page"].to_pylist(), b["content"]):
                try:
                    w, h, found = reader(raw.as_py())
                except Exception:  # noqa: BLE001
                    continue
                rows += [(doc, page, *line, w, h) for line in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], [x.split()[0] for x in LINES.split(", ")])

    return images.select("doc", "page", "content").mapInArrow(run, LINES)


def body_lines(lines: DataFrame) -> DataFrame:
    """Lines without scanning marks at their ends; those without a letter, and running titles and page numbers at top and foot, go."""
    rows = lines.withColumn("text", X.margin_noise(X.strip(X.text("text")))).where("text <> ''")
    letters = F.length(F.regexp_replace("text", r"(?U)[^\w가-힣]", ""))
    edge = (F.col("y0") < F.col("page_h") * HEAD) | (F.col("y1") > F.col("page_h") * FOOT)
    stray = F.col("text").rlike(r"(?U)^\d+$") | (letters <= 2) | F.col("text").rlike(RUNNING)
    return rows.where((letters >= 1) & ~F.coalesce(edge & stray, F.lit(False)))


def page_rows(lines: DataFrame) -> DataFrame:
    """doc, page, at, text, y0, y1, h: lines side by side as rows from the top, cleaned; rows that are noise go."""
    line = F.struct("text", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    rows = lines.groupBy("doc", "page").agg(B.scan_rows(F.collect_list(line)).alias("r")).select("doc", "page", F.posexplode("r").alias("at", "r"))
    rows = rows.select("doc", "page", "at", "r.y0", "r.y1", "r.h", noise.clean_page(F.col("r.text")).alias("text"))
    # a filter on the text itself would have it cleaned twice
    solid = F.filter(F.array(X.strip(F.col("text"))), lambda x: x != "")
    return rows.select("doc", "page", "at", "y0", "y1", "h", F.explode(solid).alias("text"))


def page_paragraphs(rows: DataFrame) -> DataFrame:
    """doc, page, text: rows joined to paragraphs; a row's predecessor and the gap between them decide."""
    by = Window.partitionBy("doc", "page").orderBy("at")
    before, gap = F.lag("text").over(by), F.col("y0") - F.lag("y1").over(by)
    r = rows.withColumns({"before": before, "gap": gap})
    short = (F.length("before") < SHORT) & ~F.col("before").rlike(GOES_ON)
    new = F.col("text").rlike(OPENS) | short | (F.col("before").rlike(ENDS) & (F.col("gap") > F.col("h") * GAP_ENDED)) | (F.col("gap") > F.col("h") * GAP)
    piece = F.concat(F.when(F.col("before").isNull(), "").when(new, "\n\n").otherwise(" "), "text")
    parts = r.select("doc", "page", "at", piece.alias("piece")).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("all"))
    return parts.select("doc", "page", F.array_join("all.piece", "").alias("text"))


def cleaned(c: Column) -> Column:
    """The chain of text rules for a recognised page."""
    c = X.artifacts(X.hyphens(X.confusion(X.symbols(nfkc(X.text(c))))))
    return X.punctuation(korean.refined(X.split_particles(X.noise_lines(c))))


def page_texts(lines: DataFrame) -> DataFrame:
    """doc, page, text of recognised pages; a page without a row of text has none."""
    pages = page_paragraphs(page_rows(body_lines(lines)))
    return pages.withColumn("text", cleaned(F.col("text")))


def book_pages(pages: DataFrame) -> DataFrame:
    """The rules that need a whole book, on its pages: page numbers, front and back matter, headers, groups of quotes."""
    # each rule looks at a book's pages more than once, so what it starts from is computed first
    p = settled(numbers.without_page_numbers(settled(pages)).select("doc", "page", "text"))
    p = settled(books.without_headers(p))
    return books.grouped_quotes(books.book_matter(p).select("doc", "page", "text")).drop("groups")


def documents(lines: DataFrame) -> DataFrame:
    """doc, text, avg_score, confidence, review: whole scanned documents; the mean of the pages' means gives the confidence."""
    from quillspark.operators.pages import rejoined_pages

    text = rejoined_pages(book_pages(page_texts(lines))).select("doc", books.scanned_text(F.col("body")).alias("text"))
    return text.join(document_confidence(lines), "doc", "right").withColumn("text", F.coalesce("text", F.lit("")))


def document_confidence(lines: DataFrame) -> DataFrame:
    """doc, avg_score, confidence, review: the mean of the means of the pages' positive scores, its grade, and whether to look again."""
    pages = lines.groupBy("doc", "page").agg(F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("m"))
    mean = F.avg("m")
    return pages.groupBy("doc").agg(F.round(mean, 6).alias("avg_score")).withColumns({
        "confidence": corpus.grade(F.col("avg_score")), "review": F.coalesce(F.col("avg_score") < 0.7, F.lit(True)),
    })
