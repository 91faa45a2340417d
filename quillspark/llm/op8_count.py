"""Edit-aware token counts: a segment tree of piece counts per document; an edit re-encodes only what it touches.

A document's state is one row: its text and its tree's leaves (tokens and characters of each). States are a table, built
once; edits are applied to states and give new ones, without a look at the rest of the text's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import tokens
from quillspark.llm.store import Work, few, tune

#: Pieces under one leaf of a tree: leaves stay a small part of the text's size.
LEAF = 32


def leaves_of(text: str, enc: tokens.Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and characters of each run of LEAF pieces; all but the first begin with the space that they are cut at."""
    parts = tokens.pieces(text)
    count = np.fromiter(map(len, map(enc.__getitem__, parts)), np.int64, len(parts)) // 4
    count[0] = len(enc.encode(parts[0]))
    chars = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    chars[0] -= 1
    at = np.arange(0, len(parts), LEAF)
    return np.add.reduceat(count, at), np.add.reduceat(chars, at)


class Tree:
    """Sums of token and character counts over leaves, in heap order: node i has children 2i and 2i + 1.

    Every leaf has an empty one after it. An edit re-encodes the leaves that it overlaps and their neighbours (an edit can
    change where pieces end, but no further than the next safe space) and cuts what it makes of them into leaves of LEAF
    pieces again. These take the places of the old ones and of the empty ones between, and the sums above them are
    updated; if they are too many, all leaves are spread anew, without encoding anything.
    """

    def __init__(self, enc: tokens.Pieces, n_tokens: np.ndarray, n_chars: np.ndarray) -> None:
        self.enc = enc
        self._spread(np.stack((n_tokens, n_chars)).astype(np.int64))

    @staticmethod
    def of(text: str, enc: tokens.Pieces) -> Tree:
        return Tree(enc, *leaves_of(text, enc))

    def _spread(self, leaves: np.ndarray) -> None:
        self.slots = 2 * leaves.shape[1]
        self.width = w = 1 << (self.slots - 1).bit_length()
        self.sums = np.zeros((2, 2 * w), np.int64)
        self.sums[:, w : w + self.slots : 2] = leaves
        while w > 1:
            self.sums[:, w // 2 : w] = self.sums[:, w : 2 * w : 2] + self.sums[:, w + 1 : 2 * w : 2]
            w //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[0, 1])

    def leaves(self) -> np.ndarray:
        """Tokens and characters of the leaves that have characters; of an empty text, one leaf without."""
        all_of = self.sums[:, self.width : self.width + self.slots]
        some = all_of[:, all_of[1] > 0]
        return some if some.shape[1] else np.zeros((2, 1), np.int64)

    def _leaf_at(self, char: int) -> int:
        """The leaf that holds a character; the last one with characters beyond the end."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char - start >= self.sums[1, node] and self.sums[1, node + 1] > 0:
                start += int(self.sums[1, node])
                node += 1
        return node - self.width

    def _beside(self, leaf: int, step: int) -> int:
        """The next leaf with characters in a direction; itself if there is none."""
        i = leaf + step
        while 0 <= i < self.slots and self.sums[1, self.width + i] == 0:
            i += step
        return i if 0 <= i < self.slots else leaf

    def _start_of(self, leaf: int) -> int:
        node, start = leaf + self.width, 0
        while node > 1:
            if node & 1:
                start += int(self.sums[1, node - 1])
            node //= 2
        return start

    def edit(self, text: str, start: int, stop: int, new: str) -> tuple[str, int]:
        """Replaces text[start:stop] by new; returns the new text and the characters that were encoded again."""
        a = self._beside(self._leaf_at(max(start - 1, 0)), -1)
        b = self._beside(self._leaf_at(min(stop, max(len(text) - 1, 0))), 1)
        begin, end = self._start_of(a), self._start_of(b) + int(self.sums[1, self.width + b])
        region = text[begin:start] + new + text[stop:end]
        fresh = np.stack(leaves_of(region, self.enc))
        n = fresh.shape[1]
        while b + 1 < self.slots and self.sums[1, self.width + b + 1] == 0:
            b += 1
        if n > b - a + 1:
            at = self.width
            self._spread(np.concatenate((self.sums[:, at : at + a], fresh, self.sums[:, at + b + 1 : at + self.slots]), 1))
            if self.slots > 4 * self.leaves().shape[1]:
                self._spread(self.leaves())
        else:
            low, high = self.width + a, self.width + b
            self.sums[:, low : high + 1] = 0
            self.sums[:, low + (np.arange(n) * (b - a + 1)) // n] = fresh
            while low > 1:
                low, high = low // 2, high // 2
                k = np.arange(low, high + 1)
                self.sums[:, k] = self.sums[:, 2 * k] + self.sums[:, 2 * k + 1]
        return text[:start] + new + text[stop:], len(region)


def script(text: str) -> list[tuple[int, int, str]]:
    """The query's edits, by place in the text as edited so far: delete a third on, insert half way, replace near the end."""
    n = len(text)
    return [(n // 3, min(n, n // 3 + 7), ""), (n // 2, n // 2, " edited here"), (max(0, n * 3 // 4 - 5), max(0, n * 3 // 4 - 2), "New")]


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows or [np.empty(0)]).astype(np.int64)))


def states(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Each document's state: doc_id, text, leaf_tokens, leaf_chars, other columns of docs. Null text counts as empty."""
    path = ranks_path or tokens.default_ranks()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            texts = [x or "" for x in b["text"].to_pylist()]
            each = [leaves_of(t, enc) for t in texts]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string()), _lists([x for x, _ in each]), _lists([x for _, x in each]), *(b[c] for c in others)], ["doc_id", "text", "leaf_tokens", "leaf_chars", *others])

    return docs.mapInArrow(build, ", ".join([f"doc_id {_kind(docs, 'doc_id')}, text string, leaf_tokens array<long>, leaf_chars array<long>", *(f"`{c}` {_kind(docs, c)}" for c in others)]))


def edited(state: DataFrame, edits: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The states after their edits, with n_tokens (before), n_edits, n_tokens_edited and n_chars_encoded."""
    path = ranks_path or tokens.default_ranks()
    state = state.select("doc_id", "text", "leaf_tokens", "leaf_chars", *([F.col(edits).alias("edits")] if edits else []))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            given = b["edits"].to_pylist() if edits else None
            texts, leaves, rows = [], [], []
            for i, (text, n, c) in enumerate(zip(b["text"].to_pylist(), b["leaf_tokens"], b["leaf_chars"])):
                tree = Tree(enc, n.values.to_numpy(), c.values.to_numpy())
                todo = script(text) if given is None else [(e["start"], e["stop"], e["new"]) for e in given[i] or [] if e]
                before, again = tree.tokens, 0
                for start, stop, new in todo:
                    start = min(max(start or 0, 0), len(text))
                    text, k = tree.edit(text, start, min(max(stop or 0, start), len(text)), new or "")
                    again += k
                texts.append(text)
                leaves.append(tree.leaves())
                rows.append((before, len(todo), tree.tokens, again))
            sums = (pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string()), _lists([x[0] for x in leaves]), _lists([x[1] for x in leaves]), *sums], ["doc_id", "text", "leaf_tokens", "leaf_chars", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"])

    return state.mapInArrow(apply, f"doc_id {_kind(state, 'doc_id')}, text string, leaf_tokens array<long>, leaf_chars array<long>, n_tokens long, n_edits long, n_tokens_edited long, n_chars_encoded long")


def counts(docs: DataFrame, edits: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_encoded.

    edits: a column array<struct<start int, stop int, new string>> in characters (code points) of the text as the edits
    before have left it, or None for the query's script. n_tokens counts the whole text, n_tokens_edited the edited one by
    the tree, n_chars_encoded what the edits had encoded again. States are written as a table and edits read it. The string
    of the vocabulary's special token is one token. Null text counts as empty; null edits as none; places beyond the text
    are moved to its end. Rows that share a doc_id, or are equal, are documents of their own.
    """
    spark = docs.sparkSession
    tune(spark)
    kept = Work(spark, "counts").put(states(docs.select("doc_id", "text", *([F.col(edits).alias("edits")] if edits else [])), ranks_path))
    return few(edited(kept, "edits" if edits else None, ranks_path).select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's tokens before and after three edits, the latter by its tree."""
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
