"""Quality classifier: hierarchical empirical Bayes over hosts and paths, on top of a linear document classifier."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as K
from quillspark.llm.store import Work, few, tune

#: Feature buckets of the document classifier; most labelled rows it is fitted on; steps of the fit.
BUCKETS, SAMPLE, STEPS = 1 << 18, 16384, 150
#: A feature is used if so many sampled texts have it and its likelihood-ratio statistic is so large.
LEAST_TEXTS, LEAST_G2 = 5, 28.0
_SHIFT = np.uint64(64 - int(math.log2(BUCKETS)))


def features(column: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text, as (texts, buckets): lower-cased words, word ends with capitals.

    used: a mask over buckets; the others are left out.
    """
    docs, buckets = [], []
    for i, j in K.texts_in_parts(column):
        b = K.split(column[i:j])
        tail = K.span_hashes(b.data, np.maximum(b.starts, b.ends - 2), b.ends)
        run = np.concatenate(([0], np.cumsum((b.data >= 65) & (b.data <= 90))))
        caps = (run[b.ends] - run[b.starts]) * 2 > b.ends - b.starts
        tail = K.mix(tail + np.uint64(0x51ED270B) + (caps & (b.ends - b.starts > 2)).astype(np.uint64))
        doc = b.doc_of_word()
        for h in (b.hashes(lower=True), tail):
            k = (h >> _SHIFT).astype(np.int64)
            at = slice(None) if used is None else used[k]
            code = np.unique((doc[at] + i) * BUCKETS + k[at])
            docs.append(code // BUCKETS)
            buckets.append(code % BUCKETS)
    code = np.unique(np.concatenate(docs or [np.empty(0, np.int64)]) * BUCKETS + np.concatenate(buckets or [np.empty(0, np.int64)]))
    return code // BUCKETS, code % BUCKETS


@dataclass
class Linear:
    """z = bias + sum of weight over a text's distinct buckets."""

    weight: np.ndarray
    bias: float

    @staticmethod
    def used(df: np.ndarray, hit: np.ndarray, n: tuple[int, int]) -> np.ndarray:
        """The associated buckets. df: texts with each bucket; hit: those of them with the label; n: all texts, and with it."""
        total, positive = n
        p = float(np.clip(positive / max(total, 1), 0.001, 0.999))
        g2 = np.zeros(BUCKETS)
        for seen, share in ((hit, p), (df - hit, 1 - p)):
            g2 += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(df * share, 1e-9)) * (seen > 0)
        return np.flatnonzero((df >= LEAST_TEXTS) & (g2 >= LEAST_G2))

    @staticmethod
    def fit(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, used: np.ndarray) -> Linear:
        """Logistic regression on the used features, with a small ridge, by full-batch Adam."""
        n = len(y)
        place = np.full(BUCKETS, -1)
        place[used] = np.arange(len(used))
        at = place[bucket] >= 0
        rows, cols, k = doc[at], place[bucket[at]], len(used)
        w, v1, v2 = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
        for t in range(1, STEPS + 1):
            z = np.bincount(rows, w[cols], n) + w[k]
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / max(n, 1)
            g = np.append(np.bincount(cols, r[rows], k) + 1e-5 * w[:k], r.sum())
            v1, v2 = 0.9 * v1 + 0.1 * g, 0.99 * v2 + 0.01 * g * g
            w = w - 0.2 * (v1 / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.99**t)) + 1e-7)
        out = np.zeros(BUCKETS)
        out[used] = w[:k]
        return Linear(out, float(w[k]))

    def logits(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weight[bucket], n) + self.bias


def _moments(groups: DataFrame) -> float:
    """Strength of a beta prior for the groups' rates (columns n, s) by the method of moments, as pseudo-counts."""
    x = groups.where("n > 0").agg(F.sum("s"), F.sum("n"), F.sum(F.expr("n * pow(s / n, 2)")), F.count("*")).first()
    if not x[1]:
        return 1.0
    p, n, k = x[0] / x[1], x[1], x[3]
    between = x[2] / n - p * p - k * p * (1 - p) / n
    return float(np.clip(p * (1 - p) / between - 1, 1, 1e6)) if between > 1e-9 else 1e6


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, quality_logit, toxic_logit, site_rate, p_quality, kept.

    A linear classifier is fitted on at most `sample` labelled documents (by hash order; rows with a null label or id
    don't count; of repeated labels the worst holds; rows that share an id are fitted as their largest text). Every document gets its two logits from its whole text. Hosts'
    and paths' rates are grouped sums of the document posteriors: a path's rate is shrunk to its host's and a host's to
    the global one, with strengths from the method of moments, so that a sparse site says little. The site's log-odds
    against the global ones are added to the document's. kept: quality at least even and toxicity at most even.
    Null host or path: a site of its own. Null or empty text: no feature, so the fitted base rate. No labels: all kept.
    """
    spark = docs.sparkSession
    tune(spark)
    work = Work(spark, "quality")
    docs = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    some = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows, so they may be broadcast
    fit_on = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.max("text").alias("text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, bucket = features(b["text"])
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b["quality"].cast("int32"), b["toxic"].cast("int32"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))], ["quality", "toxic", "buckets"])

    lists = work.put(fit_on.mapInArrow(listed, "quality int, toxic int, buckets array<int>"))
    total = lists.agg(F.count("*"), F.sum(F.expr("int(quality > 0)")), F.sum(F.expr("int(toxic > 0)"))).first()
    # what is collected is bounded: sums by bucket, then of at most `sample` texts the buckets that are used
    sums = lists.select("quality", "toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.expr("int(quality > 0)")).alias("q"), F.sum(F.expr("int(toxic > 0)")).alias("t")).toArrow()
    df, *hits = (np.zeros(BUCKETS) for _ in range(3))
    for array, c in zip((df, *hits), ("n", "q", "t")):
        array[sums["bucket"].to_numpy()] = sums[c].to_numpy()
    used = [Linear.used(df, hit, (total[0], total[k + 1] or 0)) for k, hit in enumerate(hits)]
    any_of = np.zeros(BUCKETS, bool)
    any_of[np.concatenate(used)] = True

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b["buckets"].offsets.to_numpy())
            row, bucket = np.repeat(np.arange(b.num_rows), size), b["buckets"].flatten().to_numpy()
            at = any_of[bucket]
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=b.num_rows))))
            yield pa.RecordBatch.from_arrays([b["quality"], b["toxic"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket[at], pa.int32()))], ["quality", "toxic", "buckets"])

    got = lists.mapInArrow(narrowed, "quality int, toxic int, buckets array<int>").toArrow().combine_chunks()
    mine = got["buckets"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    mine = pa.concat_arrays(mine.chunks) if isinstance(mine, pa.ChunkedArray) else mine
    doc = np.repeat(np.arange(got.num_rows), np.diff(mine.offsets.to_numpy())) if got.num_rows else np.empty(0, np.int64)
    bucket = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    heads = [Linear.fit(doc, bucket, (got[c].to_numpy() > 0).astype(float), u) if got.num_rows else Linear(np.zeros(BUCKETS), 0.0) for c, u in zip(("quality", "toxic"), used)]
    if not got.num_rows:
        heads[1].bias = -1.0
    packed = [(np.flatnonzero(h.weight), h.weight[np.flatnonzero(h.weight)], h.bias) for h in heads]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = []
        for at, w, bias in packed:
            full = np.zeros(BUCKETS)
            full[at] = w
            both.append(Linear(full, bias))
        used = (both[0].weight != 0) | (both[1].weight != 0)
        for b in batches:
            doc, bucket = features(b["text"], used)
            z = [pa.array(np.round(h.logits(doc, bucket, b.num_rows), 9)) for h in both]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["host"], b["path"], *z], ["doc_id", "host", "path", "zq", "zt"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = work.put(docs.mapInArrow(score, f"doc_id {kind}, host string, path string, zq double, zt double"))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.expr("1 / (1 + exp(-zq))")).alias("s"))
    paths = work.put(paths)
    hosts = work.put(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")))
    total = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    rate = float(np.clip((total[1] or 0.5) / (total[0] or 1), 1e-6, 1 - 1e-6))
    strong_host, strong_path = _moments(hosts.selectExpr("hn n", "hs s")), _moments(paths)
    site = (
        paths.withColumnRenamed("host", "h").withColumnRenamed("path", "p").join(hosts, F.col("h").eqNullSafe(F.col("host")))
        .select("h", "p", F.expr(f"(s + {strong_path!r}D * (hs + {strong_host!r}D * {rate!r}D) / (hn + {strong_host!r}D)) / (n + {strong_path!r}D)").alias("site_rate"))
    )
    odds = f"ln(site_rate / (1 - site_rate)) - ln({rate / (1 - rate)!r}D)"
    return few(
        scored.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
        .withColumn("site_rate", F.expr("least(greatest(site_rate, 1e-6D), 1 - 1e-6D)"))
        .select("doc_id", F.col("zq").alias("quality_logit"), F.col("zt").alias("toxic_logit"), "site_rate", F.expr(f"1 / (1 + exp(-(zq + {odds})))").alias("p_quality"))
        .withColumn("kept", F.expr("p_quality >= 0.5 and toxic_logit <= 0"))
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, with its source as host and its language as path within it."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
