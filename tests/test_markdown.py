"""Markdown cleaning, page ends, re-read lines and study material against fixed cases."""

from pyspark.sql import functions as F

from quillspark.functions import reread as R
from quillspark.functions import text as X
from quillspark.operators import markdown as M
from quillspark.operators import pages as P


def test_structure_stays(spark):
    code, data = "```py\nx  =  1\n\n\n\ny\n```", "| a | b |\n| --- | --- |\n| 1  2 | 3 |"
    md = f"---\ntitle: x  y\n---\n첫  문장을\n이어서 쓴다.\n\n{data}\n\n{code}\n\n끝났다 ."
    rows = [(1, md), (2, None), (3, ""), (4, "| " + "x" * 61 + " | 짧은 칸 내용 |"), (5, "|" + "긴 문장이 든 칸이다. " * 12 + "<br>둘째 줄이 여기에 있다.|")]
    out = {r.doc_id: r.text for r in M.refined_markdown(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out[1] == f"---\ntitle: x  y\n---\n첫 문장을 이어서 쓴다.\n{data}\n{code}\n\n끝났다.\n"
    assert out[2] == out[3] == "" and "|" not in out[4] and "x" * 61 in out[4]
    assert "|" not in out[5] and "<br>" not in out[5]


def test_margins_and_particles(spark):
    rows = {"~ 1 본문이다|": "본문이다", "~ 본문": "본문", "- 항목 |": "- 항목 |", "  ": "", "1 . ,": "", "그는 ᆞᆞ 갔다": "그는 갔다"}
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in rows], "x string").select("x", X.margin_noise(F.col("x")).alias("y")).collect()}
    assert got == rows
    rows = {"맞을 수\n\n도 있고": "맞을 수 도 있고", "직접 읽\n\n으며 고치는": "직접 읽 으며 고치는", "a\n나라": "a\n나라", "": ""}
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in rows], "x string").select("x", X.split_particles(F.col("x")).alias("y")).collect()}
    assert got == rows


def test_page_ends(spark):
    rows = [(1, 1, "그는 길을 걸었"), (1, 2, "으며 노래했다."), (1, 3, "다음 단락"), (1, 4, " "), (2, 1, "성"), (2, 2, "찰의 시간"), (2, 3, "# 제목"), (3, 1, None)]
    got = {r.doc: r.body for r in P.rejoined_pages(spark.createDataFrame(rows, "doc int, page int, text string")).collect()}
    assert got == {1: "그는 길을 걸었으며 노래했다.\n\n다음 단락", 2: "성찰의 시간\n\n# 제목"}


def test_re_read_lines(spark):
    assert R.merged("전통੶ ߏ식의 회계৪ 57A ߏ식의 ம이", "전통적 방식의 회계와 TVA 방식의 차이") == ("전통적 방식의 회계와 TVA 방식의 차이", True)
    assert R.merged("߃기ர 교수는 서울대 경영대학", "박기찬 교수는 서울대 경엉대학") == ("박기찬 교수는 서울대 경영대학", True)
    new, ok = R.merged("회계를 ࢚܀게 ࠠਞѵ다는 아이디어는 어ઊ게 나ৱ나.", "룸를 콩저 그을 극이의")
    assert not ok and "아이디어는" in new
    reads = spark.createDataFrame([(1, "  전통੶ 회계", "전통적 회계"), (1, "(전통੶ 회계 기૱)", "(전통적 회계 기준)"), (1, None, "x"), (1, "", "y")], "doc int, line string, reading string")
    texts = spark.createDataFrame([(1, "57੶ (전통੶ 회계 기૱)"), (1, "멀쩡한 본문"), (2, None), (3, "기૱")], "doc int, text string")
    got = [r.text for r in R.repaired(texts, R.fixes(reads)).orderBy("doc", "text").collect()]
    assert got == ["57 (전통적 회계 기준)", "멀쩡한 본문", "", "기"]


def test_study_material(spark):
    rows = [("영어회화 claude", "", True), ("claude guide", "영어", False), ("english.txt", "", True), ("englishman", "", False), ("x", "Idiom ... dialogue", True), ("x", "idiom", False), (None, None, False)]
    df = spark.createDataFrame(rows, "name string, text string, want boolean")
    assert all(r.got == r.want for r in df.select("want", X.study_material(F.col("text"), F.col("name")).alias("got")).collect())
