"""Corpus and page analytics as joins, windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def bold_terms(docs: DataFrame, least: int = 2) -> DataFrame:
    """Terms in ** that a document has at least so often: doc_id, term, n, first_pos."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\*\*([^*\n]+)\*\*"), 1)).alias("pos", "term"))
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).where(F.col("n") >= least)


def top_terms(docs: DataFrame, least: int = 3, most: int = 20, head: int = 4000) -> DataFrame:
    """A document's most frequent words of its first characters; ties by first place."""
    words = F.regexp_extract_all(F.substring("text", 1, head), F.lit("[A-Za-z가-힣]{2,}"), 0)
    n = docs.select("doc_id", F.posexplode(words).alias("pos", "term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).where(F.col("n") >= least)
    return n.withColumn("rnk", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos"))).where(F.col("rnk") <= most).drop("first_pos")


def gram_frequency(pages: DataFrame, book: str, page: str, n: int = 4) -> DataFrame:
    """In how many pages of a book each n-gram of letters occurs on an edge line (first or last two), and anywhere."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    solid = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
    rows = pages.select(book, page, solid.alias("solid")).select(book, page, F.size("solid").alias("n_lines"), F.posexplode("solid").alias("up", "x"))
    letters = rows.select(book, page, (F.least(F.col("up"), F.col("n_lines") - 1 - F.col("up")) < 2).alias("edge"), F.regexp_replace(F.lower("x.line"), "[^a-z가-힣]", "").alias("bare"))
    # every place's n letters, found in one pass over the line
    each = letters.select(book, page, "edge", F.explode(F.array_distinct(F.regexp_extract_all("bare", F.lit(f"(?=(.{{{n}}}))"), 1))).alias("gram"))
    return each.groupBy(book, "gram", page).agg(F.max("edge").alias("edge")).groupBy(book, "gram").agg(F.count("*").alias("all_df"), F.sum(F.col("edge").cast("long")).alias("edge_df"))


def page_numbers(marks: DataFrame, reach: int = 3, least: int = 2) -> DataFrame:
    """doc, page, value: values that other pages near by carry at the same offset."""
    one = marks.select("doc", "page", "value").distinct().withColumn("offset", F.col("value") - F.col("page"))
    w = Window.partitionBy("doc", "offset").orderBy("page").rangeBetween(-reach, reach)
    return one.withColumn("near", F.count("*").over(w) - 1).where(F.col("near") >= least).select("doc", "page", "value", "near")


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def target_names(files: DataFrame) -> DataFrame:
    """stem, ext, name: collision-free targets, numbered within a stem by extension and name."""
    n = F.row_number().over(Window.partitionBy("stem").orderBy(F.lower("ext"), F.lower("name"), "name"))
    return files.withColumn("n", n).withColumn("target", F.when(F.col("n") == 1, F.concat("stem", F.lit(".md"))).otherwise(F.concat("stem", F.lit(" ("), F.col("n").cast("string"), F.lit(").md")))).drop("n")


def not_converted(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """Sources (path, rel_path, name, parent) none of whose four identities, regardless of case, is among the outputs.

    Four equi anti-joins instead of one disjunctive join, so none is a nested loop.
    """
    drive = lambda c: F.regexp_replace(F.lower(c), "^[a-z]:", "")
    keys = {
        "full": (F.lower("path"), F.lower("source_path")),
        "rel": (F.lower("rel_path"), F.lower("source_rel_path")),
        "bare": (drive("path"), drive("source_path")),
        "name": (F.lower(F.concat_ws("/", "parent", "name")), F.lower(F.concat_ws("/", "source_parent", "source_file"))),
    }
    for key, (mine, theirs) in keys.items():
        sources = sources.withColumn("_k", mine).join(existing.select(theirs.alias("_k")).where("_k is not null and _k <> ''").distinct(), "_k", "left_anti").drop("_k")
    return sources


def status_report(details: DataFrame) -> DataFrame:
    """details: status, message. Counts by status; errors are classified by what their message says."""
    low = F.lower(F.coalesce("message", F.lit("")))
    kind = F.when(F.col("status") != "failed", F.col("status")).when(low.contains("password"), "password_protected").when(low.contains("corrupt") | low.contains("damage"), "corrupted_file").otherwise("failed")
    return details.select(kind.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def outside_tables(blocks: DataFrame, tables: DataFrame, slack: float = 5.0) -> DataFrame:
    """Blocks (doc, page, cx, cy) whose centre lies in no table's box (doc, page, x0, y0, x1, y1) of their page, widened by `slack`."""
    b, t = blocks.alias("b"), tables.select("doc", "page", "x0", "y0", "x1", "y1").distinct().alias("t")
    inside = F.col("b.cx").between(F.col("t.x0") - slack, F.col("t.x1") + slack) & F.col("b.cy").between(F.col("t.y0") - slack, F.col("t.y1") + slack)
    return b.join(t, (F.col("b.doc") == F.col("t.doc")) & (F.col("b.page") == F.col("t.page")) & inside, "left_anti")


def column_of(cx: Column, gutters: Column) -> Column:
    """The column that a centre falls in: how many gutters lie at or left of it."""
    return F.size(F.filter(gutters, lambda g: g <= cx))


def upper_median(values: Column) -> Column:
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def islands(rows: DataFrame, key: str, order: str, breaks: Column) -> DataFrame:
    """Numbers runs of rows: a row where `breaks` holds begins a new one."""
    return rows.withColumn("run", F.sum(F.coalesce(breaks, F.lit(False)).cast("long")).over(Window.partitionBy(key).orderBy(order)))


def grade(mean: Column) -> Column:
    """What a mean score is worth."""
    return F.when(mean.isNull(), "unknown").when(mean >= 0.85, "high").when(mean >= 0.65, "medium").otherwise("low")


def confidence(scores: DataFrame) -> DataFrame:
    """page, score: mean of positive line scores by page, and its grade."""
    mean = F.avg(F.when(F.col("score") > 0, F.col("score")))
    return scores.groupBy("page").agg(F.round(mean, 6).alias("avg_score"), grade(mean).alias("grade"))


def extents(blocks: DataFrame, *keys: str) -> DataFrame:
    """keys, x0, y0, x1, y1: the box around the blocks of each key."""
    return blocks.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
