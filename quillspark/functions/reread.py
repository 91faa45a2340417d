"""Lines whose font map is broken, repaired from a second reading of the same line.

Readings are rows (doc, line, reading); texts are rows (doc, text) and any other columns. Null counts as empty.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from difflib import Match, SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from quillspark.functions.text import foreign_glyphs, strip

# Characters that no right text holds, characters that a broken font shifts, limits of trust.
FOREIGN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\u0460-\u0dff\ue000-\uf8ff]")
SHIFTED = re.compile("[A-Za-z0-9]")
LEAST_AGREEMENT, LEAST_TRUSTED, LENGTHS = 0.5, 4, (0.5, 2)


class Matched(SequenceMatcher):
    """difflib's matching blocks, found by grams instead of by single characters, with the same choice among equally long ones.

    A stretch of n characters is a run of n - k + 1 common grams of k, so the longest run of the longest grams that two
    stretches share is the longest match; most characters share no long gram and are passed over.
    """

    WIDTHS = (16, 8, 4, 2, 1)

    def __init__(self, line: str, reading: str):
        self._grams = {}
        super().__init__(None, line, reading, autojunk=False)

    def _hits(self, k: int) -> tuple[list[int], list[list[int]]]:
        """Places of grams of k in the line that the reading has too, and where it has them."""
        if k not in self._grams:
            at = defaultdict(list)
            for j in range(len(self.b) - k + 1):
                at[self.b[j : j + k]].append(j)
            found = [(i, at[g]) for i in range(len(self.a) - k + 1) if (g := self.a[i : i + k]) in at]
            self._grams[k] = [i for i, _ in found], [js for _, js in found]
        return self._grams[k]

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        short = min(ahi - alo, bhi - blo)
        if short == 1:
            i, j = (alo, self.b.find(self.a[alo], blo, bhi)) if ahi - alo == 1 else (self.a.find(self.b[blo], alo, ahi), blo)
            return Match(alo, blo, 0) if min(i, j) < 0 else Match(i, j, 1)
        for k in self.WIDTHS:
            if k > short:
                continue
            places, lists = self._hits(k)
            best, best_i, best_j, last, before = 0, alo, blo, -2, {}
            for p in range(bisect_left(places, alo), len(places)):
                i, js = places[p], lists[p]
                if i > ahi - k:
                    break
                old, before = before if last == i - 1 else {}, {}
                last = i
                for q in range(bisect_left(js, blo), len(js)):
                    j = js[q]
                    if j > bhi - k:
                        break
                    n = before[j] = old.get(j - 1, 0) + 1
                    if n > best:
                        best, best_i, best_j = n, i - n + 1, j - n + 1
            if best:
                return Match(best_i, best_j, best + k - 1)
        return Match(alo, blo, 0)


def _trusted(s: str) -> int:
    return len("".join(SHIFTED.sub("", FOREIGN.sub("", s)).split()))


def _agreeing(line: str, match: SequenceMatcher) -> int:
    return sum(_trusted(line[a : a + n]) for a, _, n in match.get_matching_blocks())


def merged(line: str, reading: str, match: SequenceMatcher | None = None) -> tuple[str, bool]:
    """The line with its broken stretches from the reading, if the reading agrees with what is sound; else without its broken characters."""
    match = match or Matched(line, reading)
    solid, again = len("".join(line.split())), len("".join(reading.split()))
    sound = _trusted(line)
    if sound < LEAST_TRUSTED:
        agrees = bool(reading) and (not solid or LENGTHS[0] * solid <= again <= LENGTHS[1] * solid)
    else:
        agrees = _agreeing(line, match) >= LEAST_AGREEMENT * sound
    if not agrees:
        return FOREIGN.sub("", line), False
    out = []
    for op, a, b, c, d in match.get_opcodes():
        old, new = line[a:b], reading[c:d]
        if op == "insert":
            beside = FOREIGN.search(line[max(0, a - 1) : a + 1])
            out.append(new if beside and new.strip() else "")
        else:
            out.append(new if op != "equal" and (FOREIGN.search(old) or SHIFTED.search(old)) else old)
    return "".join(out), True


def agreement(line: str, reading: str, match: SequenceMatcher | None = None) -> float:
    """Share of what is sound in the line that the reading has too; 0 where nothing is sound."""
    sound = _trusted(line)
    return _agreeing(line, match or Matched(line, reading)) / sound if sound else 0.0


_MERGED = StructType().add("fixed", StringType()).add("trusted", BooleanType())


@F.pandas_udf(_MERGED)
def _merge(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([merged(x, y) for x, y in zip(a, b)], columns=["fixed", "trusted"])


def merge(line: Column, reading: Column) -> Column:
    """struct<fixed, trusted>."""
    return _merge(F.coalesce(line, F.lit("")), F.coalesce(reading, F.lit("")))


@F.pandas_udf(StructType().add("share", DoubleType()).add("fixed", StringType()).add("trusted", BooleanType()))
def _compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pairs = [(x, y, Matched(x, y)) for x, y in zip(a, b)]
    return pd.DataFrame([(agreement(*p), *merged(*p)) for p in pairs], columns=["share", "fixed", "trusted"])


def fixes(readings: DataFrame) -> DataFrame:
    """doc, line, fixed, trusted: one row per stripped line. Of several readings that which agrees best counts, then the longest, then the largest."""
    bare = readings.select("doc", strip(F.coalesce("line", F.lit(""))).alias("line"), strip(F.coalesce("reading", F.lit(""))).alias("reading")).where("line <> ''")
    each = bare.distinct().withColumn("m", _compared("line", "reading"))
    best = F.struct("m.share", F.length("reading").alias("n"), "reading", "m.fixed", "m.trusted")
    one = each.withColumn("best", best).groupBy("doc", "line").agg(F.max("best").alias("best"))
    return one.select("doc", "line", strip(F.col("best.fixed")).alias("fixed"), "best.trusted")


def repaired(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Texts with every fixed line replaced, longest first, and broken characters that are left deleted; sound texts unchanged."""
    order = F.array_sort(F.collect_list(F.struct((-F.length("line")).alias("n"), "line", "fixed")))
    out = texts.join(found.groupBy("doc").agg(order.alias("_fixes")), "doc", "left")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<n:int,line:string,fixed:string>>")
    # only the fixes whose line the text holds are folded over it
    mine = F.filter(F.coalesce("_fixes", none), lambda f: F.contains(text, f["line"]))
    done = F.aggregate(mine, text, lambda x, f: F.replace(x, f["line"], f["fixed"]))
    clean = F.regexp_replace(done, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{460}-\x{dff}\x{e000}-\x{f8ff}]", "")
    return out.withColumn("text", F.when(foreign_glyphs(text), clean).otherwise(text)).drop("_fixes")
