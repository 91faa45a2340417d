"""Where intermediate tables go, and session settings that the operators rely on."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.words import mix

#: Rows of a record batch sent to Python. Long texts: Spark also ends a batch at this many bytes.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Tasks a core, at most, that write a table.
WAVES = 8


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough for several Python workers beside a small executor heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all tasks run on this machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def few(df: DataFrame) -> DataFrame:
    """At most so many partitions, and so files, as keep every core of the cluster busy for some rounds."""
    return df.coalesce(WAVES * df.sparkSession.sparkContext.defaultParallelism)


#: A key is frequent if so many rows of one in SAMPLED documents have it; at most so many frequent keys are set apart.
SAMPLED, FREQUENT, SET_APART = 16, 4, 10_000


def with_first(rows: DataFrame, keys: list[str], work: Work) -> DataFrame:
    """rows (keys, doc; all long) with first, the smallest doc of their key, for keys that two docs or more have.

    The rows are dealt by key once, and groups and joins use that. What shares its first key column with keys that are
    frequent in a sample is set apart before: these groups combine before they are shuffled, and their results, at most
    SET_APART, go to the tasks as an array, so no task gets a frequent key's rows. A frequent key that the sample misses is
    dealt like any other.
    """
    from pyspark.sql import functions as F

    some = rows.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = sorted({r[0] for r in some.orderBy(F.desc("n"), *keys).limit(SET_APART).select(keys[0]).collect()})
    ends = lambda df: df.groupBy(*keys).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    listed = f"{keys[0]} IN ({', '.join(f'{k}L' for k in frequent)})" if frequent else "false"
    rest = rows.where(f"NOT ({listed})").repartition(*keys)
    out = rest.join(ends(rest), keys)
    if not frequent:
        return out
    apart = rows.where(listed)
    found = ends(apart).toArrow().combine_chunks()  # keys that share a column with SET_APART frequent ones
    code = lambda t: functools.reduce(lambda x, c: mix(x + t[c].to_numpy().view(np.uint64)), keys, np.zeros(t.num_rows, np.uint64))
    names = code(found)
    order = np.argsort(names)
    names, first = names[order], found["first"].to_numpy()[order]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(names):
                continue
            mine = code(b)
            at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
            hit = np.flatnonzero(names[at] == mine)
            yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(hit)) for c in keys), b["doc"].take(pa.array(hit)), pa.array(first[at[hit]])], [*keys, "doc", "first"])

    kinds = ", ".join(f"{c} long" for c in (*keys, "doc", "first"))
    return out.select(*keys, "doc", "first").unionByName(apart.select(*keys, "doc").mapInArrow(look_up, kinds))


class Work:
    """A folder of written tables. A written table cuts lineage, so that a lost executor costs one stage at most."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_remove_at_exit, spark, self.at)  # results read these tables until the program ends

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        schema = df.schema
        few(df).write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._work_path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Shuffle files go once the driver has collected the plans that own them; ask for that between phases, and let it happen."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def bytes_of(df: DataFrame, column: str = "text") -> int:
    """Total bytes of a string column."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)
