"""Near-duplicate texts by SetSketch registers, banded, estimated jointly and verified on full shingle sets.

A register is the exponentially spaced, truncated minimum of its hash over the set: with u the smallest uniform hash,
floor(1 - log_B(-ln(1 - u) / A)) cut to [0, Q + 1]. Registers of a union are the larger ones of two sketches, and equal registers
become likelier with similarity, so bands of registers give candidates; the numbers of registers that are smaller,
equal and larger give the likeliest similarity, and what that can't rule out is verified on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as K
from quillspark.llm.graph import Forest, components
from quillspark.llm.store import Work, few, release, tune

#: Words of a shingle; percent of similarity that links.
SHINGLE, PERCENT = 3, 85
#: Bands and registers of each: a pair of similarity 0.85 misses all bands with probability (1 - 0.85^4)^20 < 5e-7.
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Base, rate and largest value of the registers. 0 to Q + 1 spans set sizes from 1 to over 10^12.
B, A, Q = 1.001, 20.0, 65534
#: Pairs whose likeliest similarity is this far below the threshold aren't verified: over 5 standard errors.
SLACK = 0.22
#: Rounds, at least, that link each bucket to one of its members before buckets still divided are searched in full, by
#: tiles of about so many texts and shingles a side; more rounds follow while what is divided and over a tile shrinks so.
STAR_ROUNDS, TILE_TEXTS, TILE_SHINGLES, SHRINKS = 2, 1024, 500_000, 0.8
_seeds = K.mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_mul, _add = _seeds[:REGISTERS] | np.uint64(1), _seeds[REGISTERS:]
_log_b = math.log(B)


def shingles(b: K.Batch, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle; without words none."""
    h = b.hashes(lower=True)
    g, at = K.grams(h, b.at, n)
    cuts = np.searchsorted(at, b.at)
    out = []
    for i in range(len(b.at) - 1):
        k = b.at[i + 1] - b.at[i]
        if k >= n:
            out.append(np.unique(g[cuts[i] : cuts[i + 1]]))
        else:
            out.append(K.mix(np.array([sum((int(x) * (2 * j + 3) for j, x in enumerate(h[b.at[i] : b.at[i + 1]])), int(k)) % (1 << 64)], np.uint64)) if k else np.empty(0, np.uint64))
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes, as unsigned 16-bit numbers. The empty set's are 0."""
    if not len(s):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        for k in range(0, REGISTERS, 16):
            x = _mul[k : k + 16, None] * part
            x += _add[k : k + 16, None]
            np.minimum(low[k : k + 16], x.min(axis=1), out=low[k : k + 16])
    u = (low >> np.uint64(11)).astype(float) * 2.0**-53
    e = -np.log1p(-np.minimum(u + 2.0**-54, 1 - 2.0**-53)) / A
    # values start at the one of a set of one element or so, so that they fit
    return np.clip(np.floor(1 - np.log(e) / _log_b) + 8000, 0, Q + 1).astype(np.uint16)


def similarity(n_less: np.ndarray, n_more: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity given how many of two sets' registers are smaller and larger and the sets' sizes.

    With u, v the sets' shares of the union's size, a register is smaller, larger or equal with probability
    p(u - v J), p(v - u J) and the rest, p(x) = -log_B(1 - x (B - 1) / B). The joint likelihood is concave in J; a grid
    of 200 values is enough here.
    """
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (B - 1) / B) / _log_b
    best, like = np.zeros(len(u)), np.full(len(u), -np.inf)
    rest = REGISTERS - n_less - n_more
    for g in np.linspace(0, 1, 201):
        j = top * g
        less, more = p(v - u * j), p(u - v * j)
        ll = n_less * np.log(less) + n_more * np.log(more) + rest * np.log(np.maximum(1 - less - more, 1e-12))
        best, like = np.where(ll > like, j, best), np.maximum(ll, like)
    return best


def digests(w: K.Batch) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each text's lower-cased words."""
    h, place = w.hashes(lower=True), np.arange(len(w.starts), dtype=np.uint64) - np.repeat(w.at[:-1], w.n_words).astype(np.uint64)
    out = []
    for seed in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(h * np.uint64(seed) + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)))
        out.append((run[w.at[1:]] - run[w.at[:-1]] + w.n_words.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, d1, d2 (hash of the lower-cased words), n_shingles, regs (the registers' bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in K.texts_in_parts(b["text"], 1 << 20):
                w = K.split(b["text"][i:j])
                sets = shingles(w, shingle)
                regs = pa.array([registers(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b["doc_id"][i:j], *map(pa.array, digests(w)), pa.array([len(s) for s in sets], pa.int64()), regs], ["doc_id", "d1", "d2", "n_shingles", "regs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n_shingles long, regs binary")


def bands(regs: DataFrame) -> DataFrame:
    """doc, key: one row per band of each row of doc, regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.frombuffer(b"".join(b["regs"].to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.arange(BANDS, dtype=np.uint64) << np.uint64(56)
            for k in range(ROWS):
                key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["doc"].to_numpy(), BANDS)), pa.array(key.view(np.int64).ravel())], ["doc", "key"])

    return regs.mapInArrow(run, "doc long, key long")


def likely(pairs: DataFrame, regs: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b those whose likeliest similarity isn't far below the threshold."""
    x = pairs.join(regs.toDF("a", "na", "ra"), "a").join(regs.toDF("b", "nb", "rb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                na, nb = b["na"].to_numpy().astype(float), b["nb"].to_numpy().astype(float)
                j = similarity((ra < rb).sum(1), (ra > rb).sum(1), na, nb)
                sizes = np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)
                keep = pa.array(sizes & (j >= percent / 100 - SLACK))
                yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], ["a", "b"])

    return x.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b those with 100 * intersection >= percent * union, on full sets."""
    x = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    x = x.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return x.where(f"100 * common >= {percent} * (size(sa) + size(sb) - common)").select("a", "b")


def _tiles(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows: key, doc, comp. Links a, b that connect what is linked in each bucket, found on full sets.

    A bucket is cut into parts by a hash of doc; a tile is a pair of parts. A text goes to as many tiles as there are parts.
    """
    sized = rows.join(sets.select("doc", F.size("set").cast("long").alias("n")), "doc")
    parts = sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    cut = rows.join(parts, "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("key", "doc", "comp", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).join(sets, "doc")

    def match(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        doc, comp, part = (t[c].to_numpy() for c in ("doc", "comp", "part"))
        lists = t["set"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        _, col, df = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        often = df > 1  # others can't be in an intersection
        col, row = (np.cumsum(often) - 1)[col[often[col]]], row[often[col]]
        by_row = np.searchsorted(row, np.arange(len(size) + 1))
        first = part == part.min()
        a, b = (np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else (np.arange(len(doc)),) * 2
        _, root = np.unique(comp, return_inverse=True)
        forest, links, width = Forest(int(root.max()) + 1), [], 4096
        order = np.argsort(col, kind="stable")
        cols, rows_ = col[order], row[order]
        for k in range(0, len(a), 256):
            mine = a[k : k + 256]
            common = np.zeros((len(mine), len(b)), np.float32)
            used = np.unique(np.concatenate([col[by_row[x] : by_row[x + 1]] for x in mine]))
            place = np.full(int(often.sum()) + 1, -1)
            for w in range(0, len(used), width):
                place[:] = -1
                place[used[w : w + width]] = np.arange(len(used[w : w + width]))
                lo, hi = np.searchsorted(cols, used[w]), np.searchsorted(cols, used[min(w + width, len(used)) - 1], "right")
                dense = np.zeros((len(doc), min(width, len(used) - w)), np.float32)
                p = place[cols[lo:hi]]
                dense[rows_[lo:hi][p >= 0], p[p >= 0]] = 1
                common += dense[mine] @ dense[b].T
            x, y = np.nonzero(100 * common.astype(np.int64) >= percent * (size[mine][:, None] + size[b][None, :] - common.astype(np.int64)))
            x, y = mine[x], b[y]
            keep = root[x] != root[y]
            x, y = x[keep], y[keep]
            _, one = np.unique(root[x].astype(np.int64) * (len(doc) + 1) + root[y], return_index=True)
            x, y = x[one], y[one]
            done = len(forest.edges)
            of = {(int(root[p]), int(root[q])): (int(doc[p]), int(doc[q])) for p, q in zip(x, y)}
            forest.join(np.stack((root[x], root[y])))
            links += [of[e] for e in forest.edges[done:]]
        return pa.table({"a": pa.array([min(e) for e in links], pa.int64()), "b": pa.array([max(e) for e in links], pa.int64())})

    return cut.groupBy("key", "i", "j").applyInArrow(match, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Equal word sequences are one node from the start, named by their smallest doc_id, so groups of copies cost no pairs.
    Buckets of equal bands link members to a hub: first the one with most company, then one drawn by hash; only pairs
    that aren't connected yet are looked at. Buckets that are still divided after these rounds are searched in full, in
    tiles that count intersections and return no more links than it takes to connect their texts. Null or empty
    text: no shingles, linked with nothing. Null doc_id: such rows are returned unlinked, kept. Rows that share a doc_id
    are one document: their texts are nodes of their own (named from 2 ** 62 up where the id has its first) that are linked.
    """
    spark = docs.sparkSession
    tune(spark)
    work = Work(spark, "minhash")
    named = work.put(sketch(docs, shingle))
    full = named.where("n_shingles > 0 and doc_id is not null")
    first = work.put(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("low")).withColumn("node", F.col("low")))
    clash = work.put(first.groupBy("low").agg(F.count("*").alias("k"), F.min(F.struct("d1", "d2")).alias("own")).where("k > 1").select(F.col("low").alias("l"), "own"))
    if not clash.isEmpty():
        other = F.expr("own is not null and (d1 <> own.d1 or d2 <> own.d2)")
        first = work.put(first.join(clash, F.col("low") == F.col("l"), "left").withColumn("node", F.when(other, F.expr(f"xxhash64(d1, d2) & {2**62 - 1}L | {2**62}L")).otherwise(F.col("low"))).select("d1", "d2", "low", "node"))
    member = work.put(named.drop("regs").join(first.drop("low").hint("merge"), ["d1", "d2"], "left"))
    ties = member.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("y")).where("b < y")
    ties = work.put(member.join(ties, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    regs = work.put(full.join(first.hint("merge"), ["d1", "d2"]).where("doc_id = low").select(F.col("node").alias("doc"), "n_shingles", "regs").dropDuplicates(["doc"]))
    keys = work.put(bands(regs.select("doc", "regs")))
    shared = keys.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    buckets = work.put(keys.join(shared.hint("merge"), "key"))
    work.drop(keys)
    release(spark)
    some = work.put(buckets.groupBy("doc").agg(F.sum("n").alias("company")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in K.texts_in_parts(b["text"], 1 << 20):
                w = K.split(b["text"][i:j])
                own = np.logical_and(*(x == b[c][i:j].to_numpy() for x, c in zip(digests(w), ("d1", "d2"))))
                sets = [s if k else s[:0] for s, k in zip(shingles(w, shingle), own)]
                at = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([b["doc"][i:j], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["doc", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("low"), "text")
    wanted = first.join(some.select(F.col("doc").alias("node")).hint("shuffle_hash"), "node", "left_semi").withColumnRenamed("node", "doc")
    sets = work.put(texts.join(wanted.hint("shuffle_hash"), "low").mapInArrow(gather, "doc long, set array<long>").where("size(set) > 0").dropDuplicates(["doc"]))
    sketches = work.put(regs.join(some, "doc", "left_semi"))
    comp, step, before = some.withColumn("comp", F.col("doc")), 0, 0

    def merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
        """comp after more links: only links between components, which are few after the first round, are contracted."""
        ends = [comp.select(F.col("doc").alias(c), F.col("comp").alias(f"c{c}")) for c in ("a", "b")]
        e = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        more = components(e.where("a <> b"), work).toDF("comp", "c")
        return work.put(comp.join(more, "comp", "left").select("doc", "company", F.coalesce("c", "comp").alias("comp")))

    while True:
        at = work.put(buckets.drop("n").join(comp, "doc"))
        order = F.struct(-F.col("company") if not step else F.xxhash64("doc", F.lit(step)), "doc", "comp")
        divided = at.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min(order).alias("h"), F.count("*").alias("n")).where("x < y")
        divided = work.put(divided.select("key", "n", "h.doc", "h.comp").toDF("key", "n", "hub", "hub_comp"))
        large = divided.where(F.col("n") > TILE_TEXTS).agg(F.sum("n")).first()[0] or 0
        if step >= STAR_ROUNDS and (not large or large > SHRINKS * before):
            break
        before, step = large, step + 1
        pairs = at.join(divided.hint("merge"), "key").where("comp <> hub_comp")
        pairs = work.put(pairs.selectExpr("least(doc, hub) a", "greatest(doc, hub) b").distinct())
        comp = merged(comp, work.put(verified(likely(pairs, sketches, percent), sets, percent)))
        work.drop(at)
        release(spark)
    rows = work.put(at.join(divided.select("key").hint("merge"), "key", "left_semi").select("key", "doc", "comp"))
    comp = merged(comp, work.put(_tiles(rows, sets, percent))).select(F.col("doc").alias("node"), "comp")
    if not ties.isEmpty():  # ids with several texts: their nodes, whether in a bucket or not
        ends = [comp.toDF(c, f"c{c}") for c in ("a", "b")]
        e = ties.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        more = components(e, work).toDF("old", "new")
        nodes = first.select("node").distinct().join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        comp = nodes.join(more, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    out = member.join(comp, "node", "left").withColumn("component_id", F.coalesce("comp", "node", "doc_id"))
    return few(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id"""
