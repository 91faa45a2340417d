"""Mixing sources to target weights: min-cost flow over membership patterns, then a seeded choice of documents.

Sources overlap where they hold the same text, or by given memberships. Documents are summed by pattern; the flow routes each
pattern's words to the quotas of its sources. A text that m sources hold is seen m times as often, so its k-th use
costs (2 k - 1) m a word: repetition grows dearer with each use, and a source fills its quota from texts of its own,
repeated once, before it takes what three others have.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import words as K
from quillspark.llm.store import Work, few, tune

#: Most sources and membership patterns (they are solved on the driver); beyond, an error is raised.
MOST_SOURCES, MOST_PATTERNS, REPEATS, SEED = 100_000, 100_000, 3, 17


def weights(sources: list[str | None]) -> list[int]:
    """1, 2, 3, repeating, by code point, null last."""
    order = sorted(range(len(sources)), key=lambda i: (sources[i] is None, sources[i] or ""))
    out = [0] * len(sources)
    for k, i in enumerate(order):
        out[i] = k % 3 + 1
    return out


def targets(sizes: list[int], weight: list[float], most: int = REPEATS) -> list[float]:
    """Shares of the total size by weight; those above `most` sizes stop there, the excess goes to the rest by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        w = sum(weight[i] for i in free)
        over = [i for i in free if total * weight[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = total * weight[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
        total = float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def route(patterns: list[tuple[int, ...]], sizes: list[int], quotas: list[int], most: int = REPEATS, degree: list[int] | None = None) -> list[dict[int, int]]:
    """Min-cost flow: words of each pattern for each source. A pattern's k-th use costs (2 k - 1) * degree a word (convex).

    Successive shortest paths with potentials; arcs start -> pattern (one per repetition) -> source -> end.
    """
    n_p, n_s = len(patterns), len(quotas)
    start, end, n = n_p + n_s, n_p + n_s + 1, n_p + n_s + 2
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)

    inner = []
    for p, members in enumerate(patterns):
        for k in range(most):
            arc(start, p, sizes[p], (2 * k + 1) * (degree[p] if degree else 1))
        for s in members:
            inner.append((p, s, len(to)))
            arc(p, n_p + s, most * sizes[p], 0)
    for s, q in enumerate(quotas):
        arc(n_p + s, end, q, 0)
    height = [0] * n
    while True:
        dist, via = [float("inf")] * n, [-1] * n
        dist[start], heap = 0, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                y, nd = to[e], d + cost[e] + height[x] - height[to[e]]
                if cap[e] > 0 and nd < dist[y]:
                    dist[y], via[y] = nd, e
                    heapq.heappush(heap, (nd, y))
        if via[end] < 0:
            break
        reach = max(d for d in dist if d < float("inf"))
        height = [h + min(d, reach) for h, d in zip(height, dist)]
        # a blocking flow over the arcs of no reduced cost, by depth-first search
        level = [0] * n

        def push(x: int, most_flow: int, seen: set[int]) -> int:
            stack, path = [x], []
            while stack:
                x = stack[-1]
                if x == end:
                    f = min([most_flow, *(cap[e] for e in path)])
                    for e in path:
                        cap[e] -= f
                        cap[e ^ 1] += f
                    return f
                while level[x] < len(out[x]):
                    e = out[x][level[x]]
                    y = to[e]
                    if cap[e] > 0 and y not in seen and cost[e] + height[x] - height[y] == 0:
                        seen.add(y)
                        stack.append(y)
                        path.append(e)
                        break
                    level[x] += 1
                else:
                    stack.pop()
                    if path:
                        path.pop()
                        level[stack[-1]] += 1
            return 0

        while push(start, sum(quotas), {start}):
            pass
    flow: list[dict[int, int]] = [{} for _ in patterns]
    for p, s, e in inner:
        if cap[e ^ 1]:
            flow[p][s] = cap[e ^ 1]
    return flow


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the columns to keep, size (words of the whole text; null or empty: 0), d1, d2 (hash of the words)."""
    docs = docs.select("doc_id", F.col("source").cast("string").alias("source"), *keep, "text")
    names = ["doc_id", "source", *keep]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in K.texts_in_parts(b["text"], 1 << 20):
                w = K.split(b["text"][i:j])
                h, place = w.hashes(), np.arange(len(w.starts), dtype=np.uint64) - np.repeat(w.at[:-1], w.n_words).astype(np.uint64)
                both = [K.spread(w.at, K.mix(h * s + place)).view(np.int64) for s in (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407))]
                yield pa.RecordBatch.from_arrays([*(b[c][i:j] for c in names), pa.array(w.n_words), *map(pa.array, both)], [*names, "size", "d1", "d2"])

    return docs.mapInArrow(count, f"{kinds}, size long, d1 long, d2 long")


def shared(rows: DataFrame) -> DataFrame:
    """rows with degree: how many sources hold the document's words, down to a power of two."""
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    n = rows.where("size > 0").select("d1", "d2", source.alias("s")).distinct().groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1")
    out = rows.join(n.hint("merge"), ["d1", "d2"], "left")  # a sorted join, whose frequent texts Spark splits
    return out.withColumn("degree", F.expr("int(pow(2, floor(log2(coalesce(n, 1)))))")).drop("n")


def choose(rows: DataFrame, plan: DataFrame, work: Work, seed: int = SEED) -> DataFrame:
    """rows: doc_id, pattern (int), size; plan: pattern, whole (times all its documents are taken), rest (words beyond).

    Adds taken. Documents are ordered by a seeded hash; those whose middle word lies within the first `rest` words are
    taken once more. The place where the rest ends is found by two levels of 1024 hash ranges, summed before anything is
    ordered, so that the rows that must be ordered are a millionth of a pattern.
    """
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = rows.join(F.broadcast(plan), "pattern").withColumns({"b1": F.shiftrightunsigned(h, 54).cast("int"), "b2": F.shiftrightunsigned(h, 44).cast("int").bitwiseAND(1023), "h": h})

    def cut(x: DataFrame, b: str, rest: str) -> DataFrame:
        w = Window.partitionBy("pattern").orderBy(b)
        sums = x.groupBy("pattern", b, rest).agg(F.sum("size").alias("s")).withColumn("upto", F.sum("s").over(w))
        return sums.where(f"upto > {rest}").groupBy("pattern", rest).agg(F.min(F.struct(b, (F.col("upto") - F.col("s")).alias("before"))).alias("m")).select("pattern", F.col(f"m.{b}").alias(f"{b}_at"), (F.col(rest) - F.col("m.before")).alias(f"{b}_rest"))

    one = work.put(cut(rows, "b1", "rest"))  # a row for each pattern at most
    rows = rows.join(F.broadcast(one), "pattern", "left")
    two = work.put(cut(rows.where("b1 = b1_at"), "b2", "b1_rest"))
    rows = rows.join(F.broadcast(two), "pattern", "left")
    at = F.expr("b1 = b1_at and b2 = b2_at")
    w = Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(at).withColumn("upto", F.sum("size").over(w)).withColumn("more", F.expr("upto - size / 2 <= b2_rest")).drop("upto")
    clear = F.expr("b1_at is null or b1 < b1_at or (b1 = b1_at and b2_at is not null and b2 < b2_at)")
    most = rows.where(~F.coalesce(at, F.lit(False))).withColumn("more", F.coalesce(clear, F.lit(False)) & F.expr("rest > 0"))
    return most.unionByName(edge).withColumn("taken", F.expr("size * (whole + if(more, 1, 0))")).drop("b1", "b2", "h", "b1_at", "b1_rest", "b2_at", "b2_rest", "more", "whole", "rest")


def mix(docs: DataFrame, members: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    members: an array column of the sources that a document may count for (null: its own; a null element is the null
    source, and names that no document has as its source are passed over). If None, a document counts for its own source,
    and its pattern is that source and how many hold its text. source_size and target are those of `source`. Null text: size
    0 and taken 0. Null source: a source of its own, last. Repeated rows are documents of their own. Nothing is dropped: a
    document that the mix leaves out has taken 0.
    """
    spark = docs.sparkSession
    tune(spark)
    work = Work(spark, "mix")
    if members:
        docs = docs.withColumn("members", F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array(F.col("source").cast("string"))))))
        rows = work.put(sized(docs, ("members",)).withColumn("degree", F.lit(1)))
    else:
        rows = work.put(shared(work.put(sized(docs))).withColumn("members", F.array("source")))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    by_pattern = rows.groupBy("members", "degree").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(by_source) > MOST_SOURCES or len(by_pattern) > MOST_PATTERNS:
        raise ValueError("too many sources or membership patterns")
    by_source.sort(key=lambda r: (r[0] is None, r[0] or ""))
    by_pattern.sort(key=lambda r: ([(x is None, x or "") for x in r[0]], r[1]))
    names = [r[0] for r in by_source]
    sizes = [r[1] for r in by_source]
    target = targets(sizes, weights(names))
    number = {s: i for i, s in enumerate(names)}
    patterns = [tuple(number[s] for s in r[0] if s in number) for r in by_pattern]
    flow = route(patterns, [r[2] for r in by_pattern], [int(t + 0.5) for t in target], degree=[r[1] for r in by_pattern])
    plan = [(i, min(REPEATS, sum(f.values()) // max(r[2], 1)), sum(f.values()) % max(r[2], 1) if r[2] else 0) for i, (f, r) in enumerate(zip(flow, by_pattern))]
    text = T.StringType()
    table = lambda data, schema: spark.createDataFrame(data, schema)  # noqa: E731  (bounded by MOST_SOURCES, MOST_PATTERNS)
    of_source = table([(s, int(z), float(t)) for s, z, t in zip(names, sizes, target)], T.StructType([T.StructField("s", text), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))
    of_members = table([(list(r[0]), r[1], i) for i, r in enumerate(by_pattern)], T.StructType([T.StructField("m", T.ArrayType(text)), T.StructField("d", T.IntegerType()), T.StructField("pattern", T.IntegerType())]))
    same = F.col("members").eqNullSafe(F.col("m")) & (F.col("degree") == F.col("d"))
    numbered = rows.drop("d1", "d2").join(F.broadcast(of_members), same).join(F.broadcast(of_source), F.col("source").eqNullSafe(F.col("s"))).drop("m", "d", "s", "members", "degree")
    taken = choose(numbered, table(plan, "pattern int, whole long, rest long"), work)
    return few(taken.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
