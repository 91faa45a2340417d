"""Block paragraphs and scan rows on small cases and against brute force."""

import random

from pyspark.sql import functions as F

from quillspark.operators import blocks

FULL = "이 문장은 한 단의 폭을 가득 채우는 긴 본문 줄이고 다음 줄로"


def joined(spark, texts, gap=2.0):
    rows = [(1, i, t, i * (10 + gap), i * (10 + gap) + 10, t is not None and t.startswith("|")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page int, n int, text string, y0 double, y1 double, is_table boolean")
    return [r.text for r in blocks.paragraphs(df, ["page"], "n").orderBy("run").collect()]


def test_paragraphs(spark):
    assert joined(spark, [FULL, FULL, FULL]) == [" ".join([FULL] * 3)]
    assert joined(spark, [FULL + ".", "짧은 제목", FULL, FULL]) == [FULL + ".", "짧은 제목", f"{FULL} {FULL}"]
    assert joined(spark, ["teams, 141, 157-158", "Ten Goal Exercise, 68, 180"]) == ["teams, 141, 157-158", "Ten Goal Exercise, 68, 180"]
    assert joined(spark, [FULL, "를 확보했다 " + FULL]) == [FULL + "를 확보했다 " + FULL]
    assert joined(spark, [FULL, "| a |", FULL]) == [FULL, "| a |", FULL]
    assert joined(spark, [FULL, None, "", FULL]) == [FULL, FULL]  # the blank ones leave a gap of over 16
    assert joined(spark, [FULL, "- " + FULL]) == [FULL, "- " + FULL]
    assert joined(spark, [None, ""]) == []


def brute_rows(lines):
    rows = []
    for text, x0, y0, x1, y1 in sorted(lines, key=lambda v: (v[2], v[1], v[4])):
        if rows and abs((y0 + y1) / 2 - rows[-1][0][0]) < max(12, 0.5 * sum(v[4] - v[3] for v in rows[-1]) / len(rows[-1])):
            rows[-1].append(((y0 + y1) / 2, x0, text, y0, y1))
        else:
            rows.append([((y0 + y1) / 2, x0, text, y0, y1)])
    return [(" ".join(v[2] for v in sorted(r, key=lambda v: (v[1], v[3], v[2]))), min(v[3] for v in r), max(v[4] for v in r), max(v[4] - v[3] for v in r)) for r in rows]


def test_scan_rows_against_brute_force(spark):
    rng = random.Random(5)
    pages = []
    for k in range(50):
        lines = []
        for i in range(rng.randrange(15)):
            y, h = float(rng.randrange(300)), float(rng.randrange(5, 60))
            lines.append((f"t{i}", float(rng.randrange(500)), y, 600.0, y + h))
        pages.append((k, lines))
    df = spark.createDataFrame(pages + [(99, None)], "k int, lines array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")
    got = {r.k: r.r for r in df.select("k", blocks.scan_rows(F.col("lines")).alias("r")).collect()}
    assert got[99] is None
    for k, lines in pages:
        assert [tuple(r) for r in got[k]] == brute_rows(lines)
