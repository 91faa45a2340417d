"""Chains over a whole text in one call against the same rules as Columns, one after the other; plans of converted documents."""

import random

from pyspark.sql import functions as F

from quillspark.functions import korean, prose
from quillspark.functions import metadata as M
from quillspark.functions import text as X
from quillspark.functions.unicode import nfkc
from quillspark.sources import documents, readers, sinks
from tests.test_korean import FIX, KEEP

PARTS = [
    *KEEP, *FIX, "", "", " ", "- 12 -", "3 페이지", "[페이지 5]", "## 제목", "* a  b", "| a | b |", "~ * 글이 시작된다", "1. 첫째", "Ｆｕｌｌ ﬁne -> (tm)…", "infor-", "mation ( a ) [ b ] , c .", "12", "에게 주었다.", "을 보았다", "는 말",
    "Plain words of a line that goes on", "café ᆞᆞ x", "수량이 5개", "( 주 ) 가나 .그리고", "99 66말이다99", "주식회사 가나다 한국무역협회 ABC-DEF NASA", "> 📌 **핵심 요약**: 짧은 말 [1].", "# 한줄 요약", "- 첫 줄", "번 역", ": 가", "저 녁 저녁 저녁", "글 자", "\r", "x\x07y",
]


def texts():
    rng = random.Random(7)
    return ["\n".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(400)] + [*PARTS, "가\n\n", "\n\n나\n"]


def columns(c):
    c = X.page_labels(X.artifacts(X.hyphens(X.symbols(nfkc(X.text(c))))))
    c = F.array_join(F.transform(X.lines(F.regexp_replace(c, r"\n\z", "")), X.margin_noise), "\n")
    c = X.joined_paragraphs(X.split_particles(X.noise_lines(c)))
    return F.regexp_replace(X.punctuation(korean.refined(c)), r"(?U)(?<=\S) {2,}", " ")


def test_prose_is_refined_as_by_columns(spark):
    rows = spark.createDataFrame([(x,) for x in texts()], "x string").repartition(8).select("x", columns(F.col("x")).alias("y")).collect()
    assert [(r.x, prose.refine(r.x)) for r in rows if prose.refine(r.x) != r.y] == [(r.x, r.y) for r in rows if prose.refine(r.x) != r.y]


def test_metadata_of_one_text_is_that_of_columns(spark):
    x, n = F.col("x"), F.lit("Sample_20240101_회화_v2.txt")
    found = {"title": M.title(x, n), "summary": M.summary(x), "category": M.category(x, n, F.lit("/in/책")), "language": X.language(x), "entities": M.entities(x), "study": X.study_material(x, x), "tidy": X.tidy(x), "quoted": sinks.quoted(F.concat(F.lit('"\\\x1f'), F.replace(x, F.lit(" "), F.lit(""))))}
    for r in spark.createDataFrame([(t,) for t in texts()], "x string").repartition(8).select("x", *(c.alias(k) for k, c in found.items())).collect():
        t, name = r.x, "Sample_20240101_회화_v2.txt"
        assert (r.title, r.summary, r.category, r.language) == (M.title_of(t, name), M.summary_of(t), M.category_of(t, name, "/in/책"), M.language_of(t)), t
        assert (r.entities, r.study, r.tidy, r.quoted) == (M.entities_of(t), M.study_of(t, t), prose.tidy(t), sinks.quoted_text('"\\\x1f' + t.replace(" ", ""))), t


def test_files_are_converted_in_one_call_each(spark):
    files = spark.createDataFrame([("/in/a.txt", b"First file.", 1)], "path string, content binary, t int").selectExpr("path", "content", "timestamp_seconds(t) AS modificationTime")
    plan = documents.converted(files, "2026-01-01T00:00:00Z", "/in")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") <= 2 and len(plan) < 50_000


def test_long_runs_of_letters_take_no_longer_than_their_length():
    f = {"source": "/in/a.txt", "name": "a.txt", "rel_path": None, "stem": "a", "ext": "txt", "suffix": "txt", "target": "a.md", "doc": "d"}
    for text in ("a" * 300_000, "1" * 300_000, "x" + " " * 200_000 + "y"):  # the first took minutes by its square
        assert documents.document(f, text.encode(), "2026-01-01T00:00:00Z", readers.READERS["txt"])[0] == "success"
