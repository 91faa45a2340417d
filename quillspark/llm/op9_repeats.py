"""Substring dedup by recompression: rounds that name pairs and runs of tokens alike wherever they occur.

A word's name is a hash of its bytes. A round deals names to a left and a right half by a bit of their hash, gives every
pair of a left and a right neighbour a name of its own, and then every run of one name. Whether a pair or a run forms
depends on its neighbours alone, so equal substrings get equal symbols but for some at their ends, in every task. A symbol
carries the words that decide it: where these lie within a window of 13 words, the window's other occurrences hold the
same symbol. A window is represented by the first such symbol of the highest round that it has (of round three or two,
with the words beside it); a window without one, which is one in fifteen, by its own name. Equal windows are
represented alike, so symbols that occur in two documents reveal all repeats. Only windows that a shared symbol represents
are named in full (two independent hashes, 112 bits, of its words), and the smallest document of each verifies the repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as K
from quillspark.llm.store import Work, few, release, tune, with_first

#: Words of a window; rounds of which symbols represent windows, the highest first.
WINDOW, ROUNDS = 13, (3, 2)
_a, _b = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_halves = K.mix(np.arange(1, 1 + max(ROUNDS), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
#: Beyond any text: what is decided by a neighbour that a text doesn't have is certain in no window.
_FAR = 1 << 40


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return K.mix(x * _a + K.mix(y * _b))


def _run(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 1, K.mix(x * _b + K.mix(n.astype(np.uint64) * _a)), x)


def _beside(low: np.ndarray, high: np.ndarray, same: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words that decide the symbol before (step -1) or after (1) each; beyond any text if there is none."""
    none = np.array([-_FAR if step < 0 else _FAR])
    if step < 0:
        return tuple(np.concatenate((none, np.where(same, x[:-1], none))) for x in (low, high))
    return tuple(np.concatenate((np.where(same, x[1:], none), none)) for x in (low, high))


def rounds(h: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each round its new pairs: names, and the bounds of the words that decide them. h: words; at: texts' bounds."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    name, start, end = h, np.arange(len(h)), np.arange(1, len(h) + 1)
    low, high, text = start, end, doc
    out = []
    for half in _halves:
        if not len(name):
            out.append((name, low, high))
            continue
        # pairs; a symbol left alone is decided by the neighbour that it could have gone with
        same = text[1:] == text[:-1]
        left = K.mix(name ^ half) >> np.uint64(63) == 0
        first = np.append(left[:-1] & ~left[1:] & same, False)
        second = np.concatenate(([False], first[:-1]))
        p = np.flatnonzero(first)
        new, new_end = name.copy(), end.copy()
        new[p], new_end[p] = _pair(name[p], name[p + 1]), end[p + 1]
        new_low, new_high = low.copy(), high.copy()
        for step, alone in ((-1, ~left & ~second), (1, left & ~first)):
            a, z = _beside(low, high, same, step)
            new_low[alone], new_high[alone] = np.minimum(low, a)[alone], np.maximum(high, z)[alone]
        new_low[p], new_high[p] = np.minimum(low[p], low[p + 1]), np.maximum(high[p], high[p + 1])
        out.append((new[p], new_low[p], new_high[p]))
        name, start, end, low, high, text = (x[~second] for x in (new, start, new_end, new_low, new_high, text))
        # runs: decided by the symbols beside them, which differ; one that differs in the word beside is known by that word
        first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (text[1:] != text[:-1]))))
        last = np.append(first[1:], len(name)) - 1
        same, sides = text[1:] == text[:-1], []
        for step, at_edge in ((-1, first), (1, last)):
            a, z = (x[at_edge] for x in _beside(low, high, same, step))
            word, own = (start[first] - 1, end[last] - 1) if step < 0 else (end[last], start[first])
            there = np.append(same, False)[at_edge - (step < 0)]  # at_edge 0 looks at the last, which is False
            differs = there & (h[np.clip(word, 0, len(h) - 1)] != h[own])
            sides.append((np.where(differs, word, a), np.where(differs, word + 1, z)))
        name, start, end, text = _run(name[first], last - first + 1), start[first], end[last], text[first]
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        for a, z in sides:
            low, high = np.minimum(low, a), np.maximum(high, z)
    return out


def symbols(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of WINDOW words within a text: its place, and the symbol that represents it."""
    name, places = K.grams(h, at, WINDOW)
    out = K.mix(name + _a)  # a window that no symbol represents stands for itself
    open_ = np.ones(len(places), bool)
    found = rounds(h, at) if len(places) else []
    for r in ROUNDS if len(places) else ():
        name, low, high = found[r - 1]
        fits = high - low <= WINDOW
        name, low, high = name[fits], low[fits], high[fits]
        order = np.lexsort((high, low)) if len(low) and (low[1:] < low[:-1]).any() else slice(None)
        name, low, high = name[order], low[order], high[order]
        sym = K.mix(name + h[low] * _a + K.mix(h[high - 1] * _b + np.uint64(r)))
        left = np.flatnonzero(open_)
        k = np.searchsorted(low, places[left])
        while len(left):
            inside = k < len(low)
            inside[inside] = low[k[inside]] < places[left[inside]] + WINDOW
            left, k = left[inside], k[inside]
            ok = high[k] <= places[left] + WINDOW
            out[left[ok]] = sym[k[ok]]
            open_[left[ok]] = False
            left, k = left[~ok], k[~ok] + 1
    return places, out


def windows(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent names, of 64 and of 48 bits, of each window, and the windows' places."""
    name, places = K.grams(h, at, WINDOW)
    other, _ = K.grams(K.mix(h ^ _b), at, WINDOW)
    return name, other >> np.uint64(16), places


def _salted(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return K.mix(value + doc.astype(np.uint64) * _a)


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list<long> column as (row of each value, values); null counts as empty."""
    n = [0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()]
    return np.repeat(np.arange(len(n)), n), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _whole(docs: DataFrame) -> DataFrame:
    """doc, n_words, d1, d2 (hash of the word sequence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in K.texts_in_parts(b["text"], 1 << 20):
                w = K.split(b["text"][i:j])
                h = w.hashes()
                place = np.arange(len(h), dtype=np.uint64) - np.repeat(w.at[:-1], w.n_words).astype(np.uint64)
                cols = []
                for seed in (_a, _b):
                    s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(h * seed + place), dtype=np.uint64)))
                    cols.append(pa.array((s[w.at[1:]] - s[w.at[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b["doc"][i:j], pa.array(w.n_words), *cols], ["doc", "n_words", "d1", "d2"])

    return docs.mapInArrow(run, "doc long, n_words long, d1 long, d2 long")


def _symbols(docs: DataFrame) -> DataFrame:
    """sym, doc: each text's distinct symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc"].to_numpy()
            for i, j in K.texts_in_parts(b["text"], 1 << 20):
                w = K.split(b["text"][i:j])
                places, low = symbols(w.hashes(), w.at)
                doc = w.doc_of_word()[places]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                low, doc = low[new], doc[new]
                _, one = np.unique(_salted(low, doc), return_index=True)
                for k in range(0, len(one), 1 << 16):
                    o = np.sort(one[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(low[o].view(np.int64)), pa.array(ids[i:j][doc[o]])], ["sym", "doc"])

    return docs.mapInArrow(run, "sym long, doc long")


def _candidates(docs: DataFrame) -> DataFrame:
    """name, check, doc: the distinct windows that a shared symbol (column syms) represents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc"].to_numpy()
            for i, j in K.texts_in_parts(b["text"], 1 << 20):
                w = K.split(b["text"][i:j])
                h = w.hashes()
                places, low = symbols(h, w.at)
                if not len(places):
                    continue
                doc = w.doc_of_word()[places]
                row, value = _listed(b["syms"].slice(i, j - i))
                hit = np.isin(_salted(low, doc), _salted(value, row))
                name, check, _ = windows(h, w.at)
                name, check, doc = name[hit], check[hit], doc[hit]
                _, one = np.unique(_salted(name, doc), return_index=True)
                for k in range(0, len(one), 1 << 16):
                    o = one[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(name[o].view(np.int64)), pa.array(check[o].view(np.int64)), pa.array(ids[i:j][doc[o]])], ["name", "check", "doc"])

    return docs.mapInArrow(run, "name long, check long, doc long")


def repeats(docs: DataFrame, work: Work) -> DataFrame:
    """One row per doc_id with something to remove: doc, whole (everything goes), names and checks of repeated windows.

    What a document has of symbols and windows is listed with it, which is less than its text.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    base = work.put(_whole(docs).where(f"n_words >= {WINDOW}"))
    # of rows that share an id, all must be copies for the id to count as one
    copies = with_first(base.select("d1", "d2", "doc"), ["d1", "d2"], work).where("first < doc").groupBy("doc").agg(F.count("*").alias("k"))
    first = work.put(base.groupBy("doc").agg(F.count("*").alias("n")).join(copies, "doc", "left").select("doc", F.coalesce(F.col("k") == F.col("n"), F.lit(False)).alias("copy")))
    # a text that repeats an earlier one whole needs no windows; its first stands for it
    syms = work.put(_symbols(docs))
    shared = with_first(syms, ["sym"], work).select("sym", "doc")
    lists = work.put(shared.join(first.where("not copy").select("doc").hint("shuffle_hash"), "doc", "left_semi").groupBy("doc").agg(F.collect_list("sym").alias("syms")))
    work.drop(base, syms)
    release(spark)
    found = work.put(_candidates(docs.join(lists.hint("shuffle_hash"), "doc")))
    work.drop(lists)
    release(spark)
    late = with_first(found, ["name", "check"], work).where("doc > first").groupBy("doc").agg(F.collect_list(F.struct("name", "check")).alias("w"))
    out = first.where("copy").join(late, "doc", "full").select("doc", F.coalesce("copy", F.lit(False)).alias("whole"), F.col("w.name").alias("names"), F.col("w.check").alias("checks"))
    out = work.put(out)
    work.drop(found, first)
    release(spark)
    return out


def removed(w: K.Batch, whole: np.ndarray, names: pa.Array, checks: pa.Array) -> np.ndarray:
    """Which words go: those of whole copies of 13 words or more, and those that a repeated window covers."""
    gone = np.zeros(len(w.starts) + 1, np.int64)
    name, check, places = windows(w.hashes(), w.at)
    if len(places):
        doc = w.doc_of_word()[places]
        in_both = np.ones(len(places), bool)
        for mine, listed in ((name, names), (check, checks)):
            row, value = _listed(listed)
            in_both &= np.isin(_salted(mine, doc), _salted(value, row))
        hit = places[in_both | whole[doc]]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + WINDOW, -1)
    return np.cumsum(gone)[:-1] > 0


def _joined(docs: DataFrame, work: Work) -> DataFrame:
    """docs' columns as c0, c1, ..., whatever their names, with whole, names and checks."""
    marks = repeats(docs, work)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    mine = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
    return plain.join(marks.hint("shuffle_hash"), mine == F.col("doc"), "left").drop("doc")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    Windows are judged on the input, so what is removed elsewhere doesn't matter. Null or empty text: no words. Texts of
    fewer than 13 words lose nothing. Null doc_id: nothing is removed. Rows that share a doc_id are one document's texts.
    """
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = _joined(docs.select("doc_id", "text"), Work(docs.sparkSession, "repeats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b["whole"].fill_null(False).to_numpy(zero_copy_only=False)
            for i, j in K.texts_in_parts(b["c1"], 1 << 20):
                w = K.split(b["c1"][i:j])
                gone = removed(w, whole[i:j], b["names"].slice(i, j - i), b["checks"].slice(i, j - i))
                sums = []
                # kept words joined by one space: a copy of the bytes in which every other byte is skipped
                keep = np.zeros(len(w.data) + 1, np.int8)
                keep[w.starts[~gone]] = 1
                np.add.at(keep, w.ends[~gone], -1)
                mask = np.cumsum(keep[:-1], dtype=np.int8) > 0
                first = np.zeros(len(w.data), bool)
                first[w.starts[~gone]] = True
                at = np.flatnonzero(mask)
                size = np.ones(len(at), np.int64) + first[at]
                to = np.cumsum(size) - 1
                out = np.full(int(size.sum()), 32, np.uint8)
                out[to] = w.data[at]
                cut = np.searchsorted(at, w.off)
                begin = np.concatenate((to - size + 1, [len(out)]))
                for k in range(j - i):
                    x, y = begin[cut[k]], begin[cut[k + 1]]
                    sums.append(hashlib.sha256(out[x + 1 : y].tobytes() if y > x else b"").hexdigest())
                yield pa.RecordBatch.from_arrays([b["c0"][i:j], pa.array(w.n_words), pa.array(K.spread(w.at, gone)), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return few(both.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words cut out of `text` (from a removed run's first to its last byte) and n_removed added.

    Nulls, short texts and shared ids as in dedup(). Columns may have any names but n_removed, which is replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop("n_removed")
    names, text = docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    both = _joined(docs, Work(docs.sparkSession, "repeats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, column = b["whole"].fill_null(False).to_numpy(zero_copy_only=False), b[f"c{text}"]
            for i, j in K.texts_in_parts(column, 1 << 20):
                w = K.split(column[i:j])
                gone = removed(w, whole[i:j], b["names"].slice(i, j - i), b["checks"].slice(i, j - i))
                n = K.spread(w.at, gone)
                texts = column[i:j].to_pylist()
                for k in np.flatnonzero(n):
                    a, z = w.at[k], w.at[k + 1]
                    edge = np.diff(np.concatenate(([0], gone[a:z].astype(np.int8), [0])))
                    parts, at = [], w.off[k]
                    for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                        parts.append(w.data[at : w.starts[a + x]].tobytes())
                        at = w.ends[a + y - 1]
                    parts.append(w.data[at : w.off[k + 1]].tobytes())
                    texts[k] = b"".join(parts).decode()
                yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if c == text else b[f"c{c}"][i:j] for c in range(len(names))), pa.array(n)], [*names, "n_removed"])

    return both.mapInArrow(run, f"{schema}, n_removed long")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT seq, min(doc_id) AS first FROM k GROUP BY seq),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN f USING (seq), range(13) r(j) WHERE first < doc_id),
a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w
LEFT JOIN (SELECT a.doc_id, count(g.p) AS n, string_agg(word, ' ' ORDER BY a.p) FILTER (g.p IS NULL) AS kept FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id) x ON x.doc_id = w.doc_id"""
