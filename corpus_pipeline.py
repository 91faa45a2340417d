"""From raw documents to packed sequences: quality, near duplicates, repeated passages, the mix, packing.

Every row is a document of its own, whatever its doc_id: stages tell rows apart by a key, which is the doc_id where no other
row has it. Rows that are equal in all columns share a key; near_duplicate_stage keeps one of them. Every stage takes the
columns of documents and passes others over, so names that clash with its own don't matter; no rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.op1_quality import quality
from quillspark.llm.op3_minhash import near_duplicates
from quillspark.llm.op6_mix import mix
from quillspark.llm.op7_pack import pack
from quillspark.llm.op9_repeats import without_repeats
from quillspark.llm.store import Work

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key: the doc_id; from 2 ** 62 up, of the row's hash, if it is null or another row of that id has the smaller hash."""
    rows = docs.select(COLUMNS).withColumn("h", F.xxhash64(*COLUMNS))
    shared = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("i")).agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high")
    out = rows.join(shared, F.coalesce("doc_id", "h") == F.col("i"), "left")  # null ids are dealt by hash
    return out.withColumn("key", F.expr(f"if(doc_id is null or h <> low, h & {2**62 - 1}L | {2**62}L, doc_id)")).select(*COLUMNS, "key")


def _named(rows: DataFrame) -> DataFrame:
    """Rows under their keys, for operators that tell documents apart by doc_id."""
    return rows.withColumn("doc_id", F.col("key"))


def _kept(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(kept.where("kept").select(F.col("doc_id").alias("key")).distinct().hint("shuffle_hash"), "key", "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that there are, doesn't reject. A label is that of the row whose key is its doc_id.

    Null or empty text: the fitted base rate decides. Null source or lang: a site of its own. Without labels all stay.
    """
    rows = keyed(docs)
    return _kept(rows, quality(_named(rows), spark.read.parquet(f"{sf_dir}/labels.parquet"))).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest key of each group (of five-word shingles, similarity 0.8); of equal rows, one.

    Texts without words are like nothing and stay.
    """
    rows = keyed(docs)
    return _kept(rows, near_duplicates(_named(rows), percent=80, shingle=5)).dropDuplicates(["key"]).select(COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out, at the document of the smallest key none; a document of which nothing is left goes.

    Texts that had no words stay as they are, nulls too. n_chars is counted anew where a text was cut.
    """
    out = without_repeats(_named(keyed(docs).withColumn("id", F.col("doc_id")))).withColumn("doc_id", F.col("id"))
    some = out.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return some.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that the mix leaves out goes, as do texts without words. Null source: the last source."""
    rows = keyed(docs)
    taken = mix(_named(rows)).where("taken > 0").groupBy(F.col("doc_id").alias("key")).agg(F.max(F.expr("int(taken div size)")).alias("mix_times"))
    out = rows.join(taken.hint("shuffle_hash"), "key")
    return out.withColumn("mix_times", F.explode(F.sequence(F.lit(1), "mix_times"))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the sequences. Null or empty text: a piece that holds the end token alone. Equal rows are packed each."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the fitted classifier nor the packing; tests hold stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Work(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = work.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
