"""The cleaning chain over a stream of files: stateless, so every trigger and the batch run agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import text as X


def enriched(docs: DataFrame) -> DataFrame:
    t = X.tidy(F.col("text"))
    return docs.withColumn("text", t).withColumns({"language": X.language(F.col("text")), "category": X.category(F.col("text"))})


def run_available(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Processes the parquet files that are new since the last run."""
    stream = spark.readStream.schema(schema).parquet(source)
    return enriched(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
