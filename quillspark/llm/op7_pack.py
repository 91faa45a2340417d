"""Best-fit packing in bulk-synchronous steps.

Pieces are range-sorted by length and ranked within it; gaps are kept as runs of sequences with the same free space.
One superstep takes all pieces of one length, longest first: the successor sweep gives each the smallest gap that fits,
conflicts are resolved by rank (the i-th piece of a length takes the i-th sequence of a run), the gaps shrink, and the
next length follows. As lengths and gaps are at most the sequence length, steps work on that many classes whatever the
corpus; ranks, and each piece's own sweep to its run (a binary search by length and rank), are distributed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import tokens
from quillspark.llm.store import Work, few, tune

SEQUENCE, END = 2048, 0
#: Hash ranges of each length, ranked apart.
RANGES = 1024


def steps(counts: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """counts: pieces of each length. Rows (length, first rank, first sequence, offset), ranks ascending in a length."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # free space -> runs (first sequence, sequences)
    plan, fresh = [], 0
    for length in range(size, 0, -1):
        left, rank, gap = counts.get(length, 0), 0, length
        while left and gap < size:
            if not gaps[gap]:
                gap += 1
                continue
            first, n = gaps[gap].pop()
            k = min(left, n)
            plan.append((length, rank, first, size - gap))
            if n > k:
                gaps[gap].append((first + k, n - k))
            if gap > length:
                gaps[gap - length].append((first, k))
            rank, left = rank + k, left - k
            if gap - length >= length:
                gap -= length  # what was just filled fits again and is now the tightest
        each = size // length
        whole, part = divmod(left, each)
        for layer in range(each if whole else 0):
            plan.append((length, rank, fresh, layer * length))
            rank += whole
        if whole and size - each * length:
            gaps[size - each * length].append((fresh, whole))
        fresh += whole
        for layer in range(part):
            plan.append((length, rank, fresh, layer * length))
            rank += 1
        if part:
            gaps[size - part * length].append((fresh, 1))
            fresh += 1
    return np.array(plan, np.int64).reshape(-1, 4)


def cut(docs: DataFrame, ranks_path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Only documents over `size` are cut; their first piece is the short one."""
    path = ranks_path or tokens.default_ranks()
    docs = docs.select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(path), END.to_bytes(4, "little")
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                ids = tokens.ids_bytes(text or "", enc) + end
                n, k = len(ids) // 4, 0
                at, to = 0, (n - 1) % size + 1
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, to, k = to, to + size, k + 1
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, ranks_path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: a piece that holds the end token alone. Repeated rows are documents of their own. Pieces of one
    length are ranked within hash ranges; the ranges' counts give where each begins.
    """
    spark = docs.sparkSession
    tune(spark)
    work = Work(spark, "pack")
    pieces = work.put(cut(docs, ranks_path, size).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANGES)).cast("int")))
    counts = work.put(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    begins = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("begin"))
    plan = steps(by_length, size)
    key = plan[:, 0] * -(1 << 48) + plan[:, 1] if len(plan) else np.empty(0, np.int64)  # lengths descend, ranks ascend
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(begins, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("begin")).drop("part", "begin")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.searchsorted(key, length * -(1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return few(ranked.mapInArrow(place, f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
