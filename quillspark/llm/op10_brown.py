"""Language-model scoring by class-based n-grams (Brown): classes from exchange clustering, transitions and emissions.

Every word of the training texts is counted and has a class of its own. Frequent words are exchanged first, on the
driver: a unit is one of the CORE most frequent words or all other words that share a hashed ending, so that the table of
adjacent units has a fixed size whatever the corpus. From there on every word moves alone, in distributed sweeps (as
Uszkoreit and Brants do): the classes to its left and right are counted over the corpus, and it takes the class under
which they are likeliest. All words of a sweep move at once; the sweep of the best likelihood in training is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words as K
from quillspark.llm.store import Work, bytes_of, few, release, tune

#: Units: frequent words, hashed word ends, and the end of a text. Classes; sweeps of the exchange.
CORE, ENDINGS, CLASSES, SWEEPS = 256, 512, 48, 6
UNITS = CORE + ENDINGS + 1
#: Sweep(s) in which every word moves alone. What is counted of a word: classes to its right, to its left, itself beside it.
OWN, CELLS = 1, 2 * CLASSES + 1
#: A count of a word as it is shuffled.
CELL = np.dtype([("cell", "u1"), ("n", "<u4")])
#: Pseudo-counts of emissions and of transitions; weight of the class model against the base model.
ALPHA, BETA, LAMBDA = 0.1, 0.5, 0.9
#: Bytes of text that are scored together, about.
BLOCK = 8 << 20
#: The name of a text's end; no word has it.
END = np.uint64(0x0E5D0FDEADC0FFEE)
_SHIFT = np.uint64(64 - int(math.log2(ENDINGS)))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all tokens, their ending's bucket, and each text's bounds; a text's words are followed by its end."""
    w = K.split(column)
    n, at = len(w.at) - 1, w.at + np.arange(len(w.at))
    name, ending = np.full(len(w.starts) + n, END), np.zeros(len(w.starts) + n, np.int16)
    place = np.arange(len(w.starts)) + w.doc_of_word()
    name[place] = w.hashes(lower=True)
    ending[place] = (K.span_hashes(w.data, np.maximum(w.starts, w.ends - 2), w.ends, lower=True) >> _SHIFT).astype(np.int16)
    return name, ending, at


def units(name: np.ndarray, ending: np.ndarray, core: np.ndarray) -> np.ndarray:
    """core: the frequent words' names, ascending."""
    out = CORE + ending.astype(np.int64)
    if len(core):
        at = np.minimum(np.searchsorted(core, name), len(core) - 1)
        out = np.where(core[at] == name, at, out)
    return np.where(name == END, UNITS - 1, out)


def exchange(table: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """table: how often unit a precedes unit b. Each unit's class, by moving single units while the likelihood grows."""
    n = len(table)
    order = np.argsort(-(table.sum(0) + table.sum(1)), kind="stable")
    label = np.zeros(n, np.int64)
    label[order] = np.minimum(np.arange(n), classes - 1)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    one = np.eye(classes)[label]
    c = one.T @ table @ one
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not table[u].any() and not table[:, u].any():
                continue
            old, own = label[u], table[u, u]
            right = np.bincount(label, table[u], classes)
            left = np.bincount(label, table[:, u], classes)
            right[old] -= own
            left[old] -= own
            c[old] -= right
            c[:, old] -= left
            c[old, old] -= own
            rows, cols = c.sum(1) + left, c.sum(0) + right  # what goes beside u counts in its margins wherever u goes
            gain = (f(c + right) - f(c)).sum(1) + (f(c + left[:, None]) - f(c)).sum(0)
            d = np.diag(c)
            gain += f(d + right + left + own) - f(d + right) - f(d + left) + f(d)
            gain -= f(rows + right.sum() + own) - f(rows) + f(cols + left.sum() + own) - f(cols)
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else int(old)
            label[u] = new
            moved += new != old
            c[new] += right
            c[:, new] += left
            c[new, new] += own
        if not moved:
            break
    return label


def better(word: np.ndarray, cell: np.ndarray, n: np.ndarray, old: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each word's likeliest class, given n of its cells (words ascend) and c, the adjacent classes; it counts as taken out."""
    c = c + BETA
    rows, cols = c.sum(1), c.sum(0)
    cells = np.concatenate((c.T, c, c.diagonal()[None]))
    gain = np.log(cells)
    gain[:CLASSES] -= np.log(rows)
    gain[CLASSES:-1] -= np.log(cols)
    gain[-1] -= np.log(rows) + np.log(cols)
    out = old.astype(np.int64)
    for k in range(0, len(old), 1 << 14):
        o = out[k : k + (1 << 14)]
        i, j = np.searchsorted(word, (k, k + len(o)))
        d = np.bincount((word[i:j] - k) * CELLS + cell[i:j], n[i:j], len(o) * CELLS).reshape(len(o), CELLS)
        each, all_of = np.arange(len(o)), d[:, :CLASSES].sum(1) + d[:, -1]
        own = d.copy()
        own[each, o] = own[each, CLASSES + o] = own[:, -1] = d[each, o] + d[each, CLASSES + o] + d[:, -1]
        s = d @ gain
        stay = (d * np.log(np.maximum(cells.T[o] - own, BETA))).sum(1)
        s[each, o] = stay - all_of * (np.log(np.maximum(rows[o] - all_of, BETA)) + np.log(np.maximum(cols[o] - all_of, BETA)))
        new = s.argmax(1)
        out[k : k + (1 << 14)] = np.where(s[each, new] > s[each, o] + 1e-9, new, o)
    return out


def likelihood(c: np.ndarray) -> float:
    """Log likelihood of training by adjacent classes c, but for what doesn't depend on classes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(c) - f(c.sum(1)) - f(c.sum(0))


class Tokens:
    """A block's tokens: listed names, each token's place in them, which tokens train, how often each name trains."""

    def __init__(self, t: pa.Table, core: np.ndarray, seed: np.ndarray, words: pa.Table) -> None:
        held, parts = t["held"].to_numpy(), []
        for i, j in K.texts_in_parts(t["text"], 1 << 20):
            parts.append((i, j, *tokens(t["text"].slice(i, j - i))))
        self.bounds = [(i, j, at) for i, j, _, _, at in parts]
        self.train = np.concatenate([np.repeat(~held[i:j], np.diff(at)) for i, j, at in self.bounds])
        self.listed, one, back = np.unique(np.concatenate([x[2] for x in parts]), return_index=True, return_inverse=True)
        self.back = back.astype(np.int32)
        self.label = seed[units(self.listed, np.concatenate([x[3] for x in parts])[one], core)]
        self.n = np.bincount(self.back, self.train, len(self.listed)).astype(np.int64)
        self.end = int(np.searchsorted(self.listed, END))
        self.words, self.at = words, np.searchsorted(self.listed, words["name"].to_numpy().view(np.uint64))
        self.past = np.frombuffer(b"".join(words["past"].to_pylist()), np.uint8).reshape(words.num_rows, -1) if words.num_rows else None
        self.single = self.n > 0  # a word that isn't shared trains in this block only
        self.single[self.at] = self.single[self.end] = False

    def cells(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and cells around training tokens of the names that `of` marks."""
        cls, back = self.label.astype(np.uint8)[self.back], self.back
        at = np.flatnonzero(of[back] & self.train)  # an end is never among them, so a token follows
        w = back[at]
        self_left, self_right = (at > 0) & (back[at - 1] == w), back[at + 1] == w
        left = np.where(at > 0, cls[at - 1], self.label[self.end])
        right = cls[at + 1].astype(np.int64)
        return np.concatenate((w[~self_right], w[~self_left], w[self_right])), np.concatenate((right[~self_right], CLASSES + left[~self_left], np.full(self_right.sum(), CELLS - 1)))

    def sweep(self, k: int, c: np.ndarray) -> None:
        """Classes after sweep k, c being the adjacent classes before it."""
        label = self.label.copy()
        word, cell = self.cells(self.single & (self.n == 1))
        right, left = cell[: len(word) // 2], cell[len(word) // 2 :]  # one of each for a word that occurs once
        word = word[: len(word) // 2]
        kind, back = np.unique((right * CELLS + left) * CLASSES + self.label[word], return_inverse=True)
        two = np.stack((kind // CLASSES // CELLS, kind // CLASSES % CELLS), 1).ravel()
        label[word] = better(np.repeat(np.arange(len(kind)), 2), two, np.ones(len(two)), kind % CLASSES, c)[back]
        word, cell = self.cells(self.single & (self.n > 1))
        code, n = np.unique(word.astype(np.int64) * CELLS + cell, return_counts=True)
        word, back = np.unique(code // CELLS, return_inverse=True)
        label[word] = better(back, code % CELLS, n, self.label[word], c)
        if len(self.at):
            label[self.at] = self.past[:, k]
        self.label = label

    def adjacent(self) -> np.ndarray:
        """How often a class precedes a class in training, and how many single words a class has."""
        cls = self.label[self.back]
        before = np.concatenate(([self.label[self.end]], cls[:-1]))  # a text begins after an end
        return np.concatenate((np.bincount((before * CLASSES + cls)[self.train], minlength=CLASSES**2), np.bincount(self.label[self.single], minlength=CLASSES)))


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out: crc32 of the id as text, mod 10, is 0 (a null id is not held out); the rest trains. base_score is the
    add-0.1 unigram log10 probability. score mixes, token by token, the class model P(class | class before) P(word |
    class) with the base model. A word seen in training has a class of its own; one that isn't has its unit's class and
    that class's share for unseen words. Null or empty text: its end alone. No training text: base_score and score are those of one unseen token type.
    Repeated rows are scored alike and each counts in training.
    """
    spark = docs.sparkSession
    tune(spark)
    work = Work(spark, "brown")
    blocks = max(1, bytes_of(docs) // BLOCK + 1)
    docs = docs.select("doc_id", "text").withColumns({"held": F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)), "block": F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")})

    def count(t: pa.Table) -> pa.Table:
        name, ending, n = [], [], []
        for i, j in K.texts_in_parts(t["text"], 1 << 20):
            part = t.slice(i, j - i)
            a, e, at = tokens(part["text"])
            train = np.repeat(~part["held"].to_numpy(), np.diff(at))
            u, one, back = np.unique(a, return_index=True, return_inverse=True)
            name.append(u)
            ending.append(e[one])
            n.append(np.bincount(back, train, len(u)).astype(np.int64))
        name, ending, n = np.concatenate(name), np.concatenate(ending), np.concatenate(n)
        u, one, back = np.unique(name, return_index=True, return_inverse=True)
        return pa.table({"block": pa.array(np.full(len(u), t["block"][0].as_py(), np.int32)), "name": pa.array(u.view(np.int64)), "ending": pa.array(ending[one]), "n": pa.array(np.bincount(back, n, len(u)).astype(np.int64))})

    seen = work.put(docs.groupBy("block").applyInArrow(count, "block int, name long, ending short, n long"))
    release(spark)
    counts = work.put(seen.groupBy("name").agg(F.sum("n").alias("c"), F.min("ending").alias("ending"), F.count("*").alias("blocks")))
    total, distinct = counts.agg(F.sum("c"), F.sum(F.expr("int(c > 0)"))).first()
    total, distinct = int(total or 0), int(distinct or 0)
    end = int(END.view(np.int64))
    core = np.sort(np.array([r[0] for r in counts.where((F.col("c") > 0) & (F.col("name") != end)).orderBy(F.desc("c"), "name").limit(CORE).select("name").collect()], np.int64).view(np.uint64))
    vocabulary = counts.where("c > 0").withColumn("unit", F.when(F.col("name") == end, -1).when(F.col("name").isin(core.view(np.int64).tolist()), -2).otherwise(F.col("ending"))).groupBy("unit").agg(F.count("*").alias("v"), F.sum("c").alias("c"))
    sizes = {r.unit: (r.v, r.c) for r in vocabulary.collect()}  # at most ENDINGS + 2 rows

    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(UNITS * UNITS, np.int64)
        for b in batches:
            for i, j in K.texts_in_parts(b["text"], 1 << 20):
                name, ending, at = tokens(b["text"][i:j])
                u = units(name, ending, core)
                before = np.concatenate(([UNITS - 1], u[:-1]))  # a text begins after an end
                train = np.repeat(~b["held"][i:j].to_numpy(zero_copy_only=False), np.diff(at))
                code, n = np.unique((before * UNITS + u)[train], return_counts=True)
                sums[code] += n
        at = np.flatnonzero(sums)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)].astype(np.int32)), pa.array(sums[at[k : k + (1 << 16)]])], ["code", "n"])

    got = docs.select("text", "held").mapInArrow(adjacent, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most UNITS squared rows
    table = np.zeros(UNITS * UNITS)
    if got.num_rows:
        table[got["code"].to_numpy()] = got["n"].to_numpy()
    table = table.reshape(UNITS, UNITS)
    label = exchange(table)
    one = np.eye(CLASSES)[label]
    types = np.zeros(UNITS)
    for unit, (v, _) in sizes.items():
        if unit >= 0:
            types[CORE + unit] = v
    types[: len(core)] = 1
    types[UNITS - 1] = 1
    # adjacent classes and words of each class, after each sweep
    steps, kinds = [one.T @ table @ one], [np.bincount(label, types, CLASSES)]
    shared = work.put(seen.select("block", "name").join(counts.where((F.col("blocks") > 1) & (F.col("c") > 0) & (F.col("name") != end)).select("name", "c"), "name"))
    work.drop(seen, counts)
    release(spark)
    lists = shared.withColumn("past", F.lit(b""))
    by_block = docs.groupBy("block")

    def walk(t: pa.Table, words: pa.Table) -> pa.Table:
        binary = ("names", "past", "sizes", "cells")
        none = pa.table({"bucket": pa.array([], pa.int32()), "name": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in binary}})
        if not t.num_rows:
            return none
        b, done = Tokens(t, core, label, words), len(steps) - 1 + ahead
        for k in range(done):
            b.sweep(k, steps[k])
        sums = b.adjacent()
        at = np.flatnonzero(sums)
        out = pa.table({"bucket": pa.array(np.full(len(at), -1, np.int32)), "name": pa.array(at), "n": pa.array(sums[at]), **{c: pa.nulls(len(at), pa.binary()) for c in binary}})
        if done == OWN or not words.num_rows:
            return out
        of = np.zeros(len(b.listed), bool)
        of[b.at] = True
        word, cell = b.cells(of)
        code, n = np.unique(word.astype(np.int64) * CELLS + cell, return_counts=True)
        data = np.empty(len(code), CELL)
        data["cell"], data["n"] = code % CELLS, n
        word, first, size = np.unique(code // CELLS, return_index=True, return_counts=True)
        # a row for each bucket: its words' names, what they were before, how many cells each has, and the cells
        bucket = (b.listed[word] % np.uint64(blocks)).astype(np.int32)
        if done:
            row = np.empty(len(b.listed), np.int64)
            row[b.at] = np.arange(len(b.at))
            past = b.past[row[word]]
        else:
            past = b.label[word].astype(np.uint8)[:, None]
        rows = []
        for part in np.split(order := np.argsort(bucket, kind="stable"), np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                inside = np.repeat(first[part], size[part]) + np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                rows.append((int(bucket[part[0]]), b.listed[word[part]].tobytes(), past[part].tobytes(), size[part].astype("<u2").tobytes(), data[inside].tobytes()))
        cols = list(zip(*rows)) or [()] * 5
        nulls = {"name": pa.nulls(len(rows), pa.int64()), "n": pa.nulls(len(rows), pa.int64())}
        packed = pa.table({"bucket": pa.array(cols[0], pa.int32()), **nulls, **{c: pa.array(v, pa.binary()) for c, v in zip(("names", "past", "sizes", "cells"), cols[1:])}})
        return pa.concat_tables([out, packed])

    def move(t: pa.Table) -> pa.Table:
        names, sizes, cells = (b"".join(t[c].to_pylist()) for c in ("names", "sizes", "cells"))
        name, one, back = np.unique(np.frombuffer(names, np.uint64), return_index=True, return_inverse=True)
        word, data = np.repeat(back, np.frombuffer(sizes, "<u2")), np.frombuffer(cells, CELL)
        order = np.argsort(word, kind="stable")
        past = np.frombuffer(b"".join(t["past"].to_pylist()), np.uint8).reshape(len(back), -1)[one]
        new = better(word[order], data["cell"][order].astype(np.int64), data["n"][order], past[:, -1].astype(np.int64), steps[-1])
        kept = past if len(steps) > 1 else past[:, :0]  # before the first sweep it is the seed's class
        both = np.concatenate((kept, new.astype(np.uint8)[:, None]), 1)
        return pa.table({"name": pa.array(name.view(np.int64)), "past": pa.array([x.tobytes() for x in both], pa.binary())})

    for k in range(OWN + 1):
        ahead = int(k > 0)  # the sweep whose adjacent classes are not known yet
        seen_of = by_block.cogroup(lists.groupBy("block")).applyInArrow(walk, "bucket int, name long, n long, names binary, past binary, sizes binary, cells binary")
        if k:  # the first sweep's adjacent classes are known, so its cells needn't be written
            seen_of = work.put(seen_of)
            sums = np.zeros(CLASSES**2 + CLASSES)
            for r in seen_of.where("bucket < 0").groupBy("name").agg(F.sum("n").alias("n")).collect():
                sums[r.name] = r.n
            for r in classes.groupBy(F.conv(F.hex(F.substring("past", k, 1)), 16, 10).cast("int").alias("cls")).agg(F.count("*").alias("v")).collect():
                sums[CLASSES**2 + r.cls] += r.v
            sums[CLASSES**2 + label[UNITS - 1]] += 1
            steps.append(sums[: CLASSES**2].reshape(CLASSES, CLASSES))
            kinds.append(sums[CLASSES**2 :])
        if k < OWN:
            classes = work.put(seen_of.where("bucket >= 0").groupBy("bucket").applyInArrow(move, "name long, past binary"))
            lists = work.put(shared.join(classes, "name"))
            work.drop(shared)
        if k:
            work.drop(seen_of)
        release(spark)
    best = int(np.argmax([likelihood(c) for c in steps]))
    moves = steps[best] + BETA
    moves /= moves.sum(1, keepdims=True)
    mass = steps[best].sum(0) + ALPHA * (kinds[best] + 1)
    ends = sizes[-1][1] if -1 in sizes else 0
    base_of = total + 0.1 * (distinct + 1)

    def rate(t: pa.Table, words: pa.Table) -> pa.Table:
        held = t["held"].to_numpy()
        if not t.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), (t["doc_id"].type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2))})
        cols: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        b = Tokens(t, core, label, words)
        for k in range(best):
            b.sweep(k, steps[k])
        known = b.n.copy()
        known[b.at] = words["c"].to_numpy()
        known[b.end] = ends
        first = 0
        for i, j, at in b.bounds:
            back = b.back[first : first + at[-1]]
            first += at[-1]
            c = known[back]
            base = (c + 0.1) / base_of
            cls = b.label[back]
            before = np.concatenate(([label[UNITS - 1]], cls[:-1]))
            fine = moves[before, cls] * (c + ALPHA) / mass[cls]
            both = LAMBDA * fine + (1 - LAMBDA) * np.where(c > 0, base, base / CLASSES)
            cols["n_tokens"].append(np.diff(at))
            cols["n_known"].append(np.add.reduceat((c > 0).astype(np.int64), at[:-1]))
            cols["base_score"].append(np.add.reduceat(np.log10(base), at[:-1]))
            cols["score"].append(np.add.reduceat(np.log10(both), at[:-1]))
        n = t.num_rows
        return pa.table({"doc_id": t["doc_id"], "held_out": pa.array(held), **{k: pa.array(np.concatenate(v) if v else np.empty(0)) for k, v in cols.items()}, "train_tokens": pa.array(np.full(n, total, np.int64))}).select(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return few(by_block.cogroup(lists.groupBy("block")).applyInArrow(rate, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
