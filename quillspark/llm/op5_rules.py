"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus, beside base rules."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as K
from quillspark.llm.store import Work, few, tune

#: Buckets of n-grams (1 and 2 words); most trusted documents that the target is fitted on; how far below the trusted mean a kept text may score.
BUCKETS, TRUSTED, MARGIN = 1 << 18, 65536, 0.25
#: The symbols that the base rule counts.
SYMBOLS = b"#*$%&|<>"
_SHIFT = np.uint64(64 - int(math.log2(BUCKETS)))
_is_symbol = np.zeros(256, bool)
_is_symbol[list(SYMBOLS)] = True


def _buckets(b: K.Batch) -> tuple[np.ndarray, np.ndarray]:
    h, doc = b.hashes(lower=True), b.doc_of_word()
    two, at = K.grams(h, b.at, 2)
    return np.concatenate((h >> _SHIFT, two >> _SHIFT)).astype(np.int64), np.concatenate((doc, doc[at]))


def _twice(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def base(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    b = K.split(column)
    n = len(b.off) - 1
    doc = b.doc_of_word()
    by_bytes = lambda mask: (lambda run: run[b.off[1:]] - run[b.off[:-1]])(np.concatenate(([0], np.cumsum(mask))))
    chars = by_bytes(((b.data & 0xC0) != 0x80) & ~K.IS_SPACE[b.data])
    # lines: cut at \n and at texts' bounds
    cuts = np.flatnonzero(b.data == 10)
    starts = np.unique(np.concatenate((b.off[:-1], cuts + 1)))
    starts = starts[starts < len(b.data)]
    ends = np.minimum(np.append(starts[1:], len(b.data)), len(b.data))
    ends = np.where(b.data[np.maximum(ends - 1, 0)] == 10, ends - 1, ends) if len(ends) else ends
    ends = np.maximum(ends, starts)
    has = np.searchsorted(b.starts, ends) > np.searchsorted(b.starts, starts)
    starts, ends = starts[has], ends[has]
    line_doc = np.searchsorted(b.off, starts, "right") - 1
    key = K.mix(K.span_hashes(b.data, starts, ends) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    dup = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n)
    # words in windows of five that occur twice or more
    five, at = K.grams(b.hashes(), b.at, 5)
    hit = at[_twice(K.mix(five + doc[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))] if len(at) else at
    edge = np.zeros(len(b.starts) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    return {"n_words": b.n_words, "word_chars": chars, "n_symbols": by_bytes(_is_symbol[b.data]), "n_dup_lines": dup, "n_repeat_words": K.spread(b.at, np.cumsum(edge)[:-1] > 0)}


def rules(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept.

    Trusted are labelled documents of quality 1 and toxic 0. Half of them (by a hash), but at most `trusted`, by hash order,
    give the target's multinomial over hashed 1- and 2-grams; all documents give the raw one; both get one pseudo-count a
    bucket. llr is the mean log ratio of a text's n-grams. A text is kept if it passes the base rules and its llr is at
    least the mean over all of the other half of the trusted texts, less `margin`; without such texts, 0 less `margin`.
    Null or empty text: zeros, base_failed. Repeated rows are rated alike.
    """
    spark = docs.sparkSession
    tune(spark)
    work = Work(spark, "rules")
    docs = docs.select("doc_id", "text")
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = work.put(good.withColumn("h", F.xxhash64("doc_id")))
    target = np.sort(np.array([r[0] for r in good.where("h % 2 = 0").orderBy("h", "doc_id").limit(trusted).collect()], np.int64))

    def member(b: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
        x = b["doc_id"].cast("int64")
        return np.isin(x.fill_null(0).to_numpy(zero_copy_only=False), ids) & x.is_valid().to_numpy(zero_copy_only=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            trust = member(b, target)
            for i, j in K.texts_in_parts(b["text"], 1 << 20):
                bucket, doc = _buckets(K.split(b["text"][i:j]))
                sums[0] += np.bincount(bucket, minlength=BUCKETS)
                sums[1] += np.bincount(bucket[trust[i:j][doc]], minlength=BUCKETS)
        at = np.flatnonzero(sums[0])
        for k in range(0, len(at), 1 << 16):
            a = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(sums[0, a]), pa.array(sums[1, a])], ["bucket", "raw", "target"])

    counts = docs.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most BUCKETS rows
    both = np.ones((2, BUCKETS))
    if counts.num_rows:
        at = counts["bucket"].to_numpy()
        both[0, at] += counts["raw"].to_numpy()
        both[1, at] += counts["target"].to_numpy()
    ratio = (np.log(both[1] / both[1].sum()) - np.log(both[0] / both[0].sum())).astype(np.float32)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for i, j in K.texts_in_parts(b["text"], 1 << 20):
                x = base(b["text"][i:j])
                bucket, doc = _buckets(K.split(b["text"][i:j]))
                x["llr"] = np.round(np.bincount(doc, ratio[bucket].astype(float), j - i) / np.maximum(np.bincount(doc, minlength=j - i), 1), 9)
                parts.append(x)
            cols = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
            if cols:
                yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(v, pa.float64() if k == "llr" else pa.int64()) for k, v in cols.items())], ["doc_id", *cols])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rated = work.put(docs.mapInArrow(rate, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"))
    held = rated.where("n_words >= 10").join(good.where("h % 2 <> 0").select("doc_id"), "doc_id", "left_semi")
    middle = held.agg(F.avg("llr")).first()[0] or 0.0
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return few(rated.withColumn("base_failed", failed).withColumn("kept", F.expr(f"not base_failed and llr >= {middle - margin!r}D")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
