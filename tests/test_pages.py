"""Page and entry rules against small cases and brute force."""

import random

from pyspark.sql import functions as F

from quillspark.functions import entries, text
from quillspark.operators import pages


def brute_chain(values):
    best = [1] * len(values)
    for j in range(len(values)):
        for i in range(max(0, j - entries.BACK), j):
            if 1 <= values[j] - values[i] <= entries.GAP:
                best[j] = max(best[j], best[i] + 1)
    return max(best, default=0)


def test_chain_is_as_long_as_brute_force():
    rng = random.Random(7)
    for n in (0, 1, 5, 300, 900):
        values = [rng.randrange(1, 1 + n // 2 + 3) for _ in range(n)]
        got = entries.chain(" ; ".join(map(str, values)))
        assert len(got) == brute_chain(values)
        assert all(1 <= b[1] - a[1] <= entries.GAP and a[0] < b[0] for a, b in zip(got, got[1:]))


def test_numbered_book(spark):
    book = "\n".join(f"{i:04} entry text" for i in range(1, 41))
    df = spark.createDataFrame([(1, book), (2, "only 3 numbers, 4 of them"), (3, ""), (4, None)], "k int, text string")
    assert {r.k: r.n for r in df.select("k", entries.numbered_book(F.col("text")).alias("n")).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_contents_pages(spark):
    rows = [(1, "\n".join(f"Chapter {i}" for i in range(12))), (2, "\n".join(f"Chapter {i}" for i in range(11))), (3, "\n".join("a line of words " * 3 + str(i) for i in range(20))), (4, None), (5, "Part 3\n#가 #나 #다")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: (r.a, r.b) for r in df.select("k", pages.contents_page(F.col("text")).alias("a"), pages.part_contents_page(F.col("text")).alias("b")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, False), 5: (False, True)}


def test_joined_pages(spark):
    df = spark.createDataFrame([(1, 2, "second. "), (1, 1, "first"), (1, 3, "  "), (1, 4, None), (1, 5, "third"), (2, 1, None)], "doc int, page int, text string")
    assert [tuple(r) for r in pages.joined_pages(df).collect()] == [(1, "first second.\n\nthird")]


def test_bands_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, [float(rng.randrange(800)) for _ in range(rng.randrange(12))]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, e array<double>")
    got = {r.k: r.c for r in df.select("k", pages.cuts(F.col("e"), F.lit(800.0)).alias("c")).collect()}
    for k, e in rows:
        want = []
        for y in sorted(set(e)):
            if 60 < y < 680 and (not want or y - want[-1] >= 20):
                want.append(y)
        assert got[k] == want


def test_word_lines(spark):
    rows = [(1, "자다가\n일어날\n정도로\n두근거리는 일"), (2, "하나\n둘\n긴 줄"), (3, "Our\nsuccess\nhas\n한글 줄"), (4, None)]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: (r.a, r.b) for r in df.select("k", text.word_per_line(F.coalesce("text", F.lit(""))).alias("a"), text.latin_word_lines(F.coalesce("text", F.lit(""))).alias("b")).collect()}
    assert got[1][0] == "자다가 일어날 정도로\n두근거리는 일" and got[2][0] == rows[1][1]
    assert got[3][1] == "Our success has\n한글 줄" and got[4] == ("", "")
