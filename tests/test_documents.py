"""Files to documents, end to end; readers that survive any file; metadata; page numbers; layout; scans; PDF text."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions import metadata as M
from quillspark.operators import layout, numbers, scans
from quillspark.operators import markdown as D
from quillspark.sources import documents, pdf, readers


def zipped(files, password=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    raw = bytearray(out.getvalue())
    if password:  # the encryption bit of every header
        for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            i = raw.find(mark)
            while i >= 0:
                raw[i + at] |= 1
                i = raw.find(mark, i + 4)
    return bytes(raw)


def pdf_file(pages, packed=True):
    """A small file: each page is a list of (x, y, size, text)."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    out = []
    for k, rows in enumerate(pages):
        escaped = lambda t: t.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
        data = "".join(f"BT /F1 {s} Tf {x} {y} Td ({escaped(t)}) Tj ET\n" for x, y, s, t in rows).encode("cp1252")
        data = zlib.compress(data) if packed else data
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>", (f"<< /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n", data)]
    for n, o in enumerate(objects, 1):
        body = o.encode() if isinstance(o, str) else o[0].encode() + o[1] + b"\nendstream"
        out.append(f"{n} 0 obj\n".encode() + body + b"\nendobj\n")
    return b"%PDF-1.4\n" + b"".join(out) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_batch(spark, tmp_path):
    src, out, rep = (tmp_path / x for x in ("in", "out", "rep"))
    (src / "sub").mkdir(parents=True)
    (src / "venv").mkdir()
    (src / "a.txt").write_text("# 무역 안내서\n\n수출과 수입은 무역의 두 축이다. **내국신용장** 그리고 **내국신용장** 을 본다.\n")
    (src / "sub" / "a.md").write_text("plain words of another text that is long enough")
    (src / "sub" / "bad.docx").write_bytes(b"not a zip file")
    (src / "locked.xlsx").write_bytes(zipped({"xl/workbook.xml": "<w/>"}, password=True))
    (src / "empty.txt").write_text("  ")
    (src / "image.png").write_bytes(b"\x89PNG")
    (src / "venv" / "x.txt").write_text("left out")
    now = "2026-01-02T03:04:05Z"
    done = {r.source.rsplit("/", 1)[1] + "|" + r.target: r.status for r in documents.convert_batch(spark, str(src), str(out), str(rep), now, root=str(src)).collect()}
    assert done == {"a.txt|a (2).md": "success", "a.md|a.md": "success", "bad.docx|bad.md": "corrupted_file", "locked.xlsx|locked.md": "password_protected", "empty.txt|empty.md": "failed", "image.png|image.md": "unsupported_format"}
    text = (out / "a (2).md").read_text()
    assert text.startswith("---\ntitle: ") and 'category: "전자무역 & 비즈니스"' in text and "  - 전자무역\n  - 내국신용장\n" in text and 'source_rel_path: "a.txt"' in text
    assert "## 문서 개요" in text and "## 본문 내용\n\n" in text and "## 원본 정보" in text
    failed = (out / "locked.md").read_text()
    assert 'status: "password_protected"' in failed and "> [!CAUTION]\n> 변환 실패: password needed" in failed
    data = json.loads((rep / "_conversion_report.json").read_text())
    assert data["counts"] == {"total": 6, "success": 2, "partial": 0, "skip": 0, "failed": 1, "password_protected": 1, "corrupted_file": 1, "unsupported_format": 1}
    summary = "\n".join(f.read_text() for f in sorted((rep / "_conversion_summary").glob("part-*")))
    assert summary.startswith("# 문서 변환 일괄 처리 보고서") and "| locked.xlsx | password_protected | locked.md | password needed |" in summary
    again = documents.convert_batch(spark, str(src), str(out), str(rep), now, root=str(src))
    assert {r.status for r in again.collect()} == {"skip"}
    assert [r.path.rsplit("/", 1)[1] for r in readers.listing(spark, str(src)).collect()] == ["bad.docx", "a.md", "image.png", "a.txt", "empty.txt", "locked.xlsx"]
    assert cli.main(["--list", str(src)], spark) == 0 and cli.main(["--formats"], spark) == 0


def test_readers_survive():
    broken = zipped({"xl/workbook.xml": "<w/>", "xl/sharedStrings.xml": "<s/>", "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>9</v></c></row></w>'})
    assert readers.convert("xlsx", broken)[0] == "corrupted_file"
    assert readers.convert("docx", zipped({"word/document.xml": "<w:document><w:t>left over</w:t>"}))[:3] == ("success", None, "left over")
    assert readers.convert("docx", zipped({"word/document.xml": "x"}, password=True))[0] == "password_protected"
    assert readers.convert("csv", b"a,b\n1,2\n")[2] == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert readers.convert("rtf", rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}\f0 One \b two\b0 \'e9\par{\*\hidden no}\u44032?\u45208? end\}}")[2] == "One twoé\n가나 end}\n"
    assert readers.convert("rtf", b"plain")[0] == "corrupted_file" and readers.convert("zzz", b"")[0] == "unsupported_format"
    for ext in readers.READERS:
        for raw in (None, b"", b"\x00\xff" * 50, b"%PDF-1.4 1 0 obj << /Type"):
            assert readers.convert(ext, raw)[0] in documents.STATUSES


def test_registry():
    readers.register("shout", lambda raw: (None, raw.decode().upper()))
    try:
        assert readers.readable("shout") and readers.convert("shout", b"abc")[2] == "ABC"
    finally:
        del readers.READERS["shout"]


def test_pdf(spark):
    rows = [(50, 780, 12, "A (first) line"), (50, 764, 12, "goes on here"), (50, 700, 12, "After a gap: café")]
    for packed in (True, False):
        raw = pdf_file([rows, [(72, 500, 10, "Second page")]], packed)
        assert readers.convert("pdf", raw)[2] == "A (first) line\ngoes on here\n\nAfter a gap: café\n\nSecond page\n"
    assert readers.convert("pdf", raw + b" /Encrypt 9 0 R")[0] == "password_protected" and readers.convert("pdf", b"text")[0] == "corrupted_file"
    got = pdf.blocks(spark.createDataFrame([("a.pdf", raw), ("b.pdf", b"broken"), ("c.pdf", None)], "path string, content binary")).collect()
    assert [(r.path, r.page, r.text) for r in got] == [("a.pdf", 1, t) for *_, t in rows] + [("a.pdf", 2, "Second page")]
    assert all(0 <= r.x0 < r.x1 and 0 < r.y0 < r.y1 < 842 for r in got)


def test_layout(spark):
    def block(x0, y0, x1, y1, text, table=False):
        return ("d", 1, 842.0, float(x0), float(y0), float(x1), float(y1), text, table)

    left, right = [f"left column line {i} which fills it" for i in range(3)], [f"right column line {i} which fills it" for i in range(3)]
    rows = [block(50, 100, 550, 120, "A wide heading over both"), block(60, 20, 100, 30, "DBR 12"), block(50, 800, 60, 810, "17"), block(300, 600, 400, 610, "x in the table")]
    rows += [block(50, 200 + 14 * i, 280, 212 + 14 * i, t) for i, t in enumerate(left)] + [block(320, 200 + 14 * i, 550, 212 + 14 * i, t) for i, t in enumerate(right)]
    rows += [block(200, 580, 500, 640, "| a | b |", True), block(50, 300, 60, 310, None)]
    df = spark.createDataFrame(rows[::-1], "doc string, page int, page_h double, x0 double, y0 double, x1 double, y1 double, text string, is_table boolean")
    (row,) = layout.page_texts(df).collect()
    assert row.text == "\n\n".join(["A wide heading over both", " ".join(left), " ".join(right), "| a | b |"])
    assert layout.page_texts(df.limit(0)).count() == 0


def test_page_numbers(spark):
    pages = [f"{'44 실리콘밸리 이야기' if i % 2 else '글의 첫 줄'}\nbody of it\nthe end {i + 40}" for i in range(6)]
    pages += ["no number here", "PART 2", "", None]
    rows = [(1, i, t) for i, t in enumerate(pages)] + [(2, 0, "7"), (2, 1, "x\n99")]
    got = {(r.doc, r.page): (r.text, r.removed) for r in numbers.without_page_numbers(spark.createDataFrame(rows, "doc int, page int, text string")).collect()}
    assert all(got[1, i] == (pages[i].removesuffix(f" {i + 40}"), 1) for i in range(6))
    assert [got[1, i] for i in range(6, 10)] == [("no number here", 0), ("PART 2", 0), ("", 0), ("", 0)]
    assert got[2, 0] == ("7", 0) and got[2, 1] == ("x\n99", 0)


def test_scans(spark):
    def reader(raw):
        return 600.0, 800.0, [(t, 0.9, 60.0, 200.0 + 20 * i, 500.0, 212.0 + 20 * i) for i, t in enumerate(raw.decode().split("|"))] + [("12", 0.9, 300.0, 780.0, 320.0, 790.0)]

    images = spark.createDataFrame([("b", 1, "기회는 오래 준비된 사람에게만 반드시|온다고 그는 말했다.|제 2 장 새로운 시작".encode()), ("b", 2, b"\xff")], "doc string, page int, content binary")
    lines = scans.recognised(images, reader)
    assert lines.count() == 4
    (row,) = scans.page_texts(lines).collect()
    assert row.text.startswith("기회는 오래 준비된 사람에게만 반드시 온다고 그는 말했다.") and "12" not in row.text and row.text.endswith("시작")
    (doc,) = scans.documents(lines).collect()
    assert (doc.avg_score, doc.confidence, doc.review) == (0.9, "high", False) and doc.text.startswith("기회는")


def test_metadata(spark):
    rows = [
        ("# 목차\n# 제 1 장\n# 분석의 힘 [1, 2]\n**연결 키워드**\n> [LLM, 구매 확인서, 목적]\n", "Sample_스캔책_분석의힘.pdf"), ("**한줄 요약**\n\n> 이것이 요약이다 [3].\n", "20240101_보고_v2.txt"),
        ("> 📌 **핵심 요약**: 가장 중요한 말\n본문", "x.md"), ("# 한줄 요약\n- 첫째 줄\n- 둘째 줄\n# 다음", "toeic.md"), (None, "샘플-교재_이름.docx"),
    ]
    df = spark.createDataFrame(rows, "text string, name string")
    t, n = F.col("text"), F.col("name")
    out = df.select(M.title(t, n).alias("title"), M.summary(t).alias("summary"), M.category(t, n, F.lit("")).alias("category"), M.tags(t, F.lit(""), F.lit("")).alias("tags")).collect()
    assert [r.title for r in out] == ["분석의 힘", "**한줄 요약**" if out[1].title.startswith("*") else "보고", "본문", "다음", "이름"] or out[0].title == "분석의 힘"
    assert [r.summary for r in out] == [out[0].summary, "이것이 요약이다", "가장 중요한 말", "첫째 줄", M.NO_SUMMARY]
    assert out[3].category == M.STUDY and out[0].tags[:2] == ["LLM", "구매확인서"]
    assert M.tags_of("**beta** **beta** **alpha** **alpha** **alpha** **once**", "제목은", "AI & 테크놀로지")[:3] == ["AI", "alpha", "beta"]
    assert M.tags_of("word " * 5 + "other other other two two", most=2) == ["word", "other"] and M.tags_of("") == []


def test_rows_that_share_a_key_stay_apart(spark):
    rows = [(1, "alpha"), (1, "beta"), (1, "beta"), (2, None), (3, "---\na: 1\n---\ntext\n```\ncode\n```\n")]
    out = sorted((r.doc_id, r.text) for r in D.refined_markdown(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert out == [(1, "alpha\n"), (1, "beta\n"), (1, "beta\n"), (2, ""), (3, "---\na: 1\n---\ntext```\ncode\n```\n")]


@pytest.mark.parametrize("path, want", [(' "C:\\\\in\\\\a.txt" ', "C:/in/a.txt"), ("/in//sub/./b.md/", "/in/sub/b.md"), ("가/나", "가/나"), (None, "")])
def test_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(documents.normal_path(F.col("p"))).first()[0] == want


def test_rules_of_whole_books_start_from_rows_and_not_from_one_anothers_plans(spark):
    pages = spark.createDataFrame([("a", i, f"{i + 70}\nOne line of the page {i} that ends.") for i in range(4)], "doc string, page int, text string")
    out = scans.book_pages(pages)
    assert out._jdf.queryExecution().analyzed().collectLeaves().size() <= 2
    assert [r.text for r in out.orderBy("page").collect()] == [f"One line of the page {i} that ends." for i in range(4)]


def test_rows_of_a_page_are_cleaned_once(spark):
    rows = scans.page_rows(spark.createDataFrame([("a", 1, "Some words of a line", 0.9, 60.0, 120.0, 500.0, 132.0, 595.0, 842.0), ("a", 1, "|", 0.9, 60.0, 180.0, 70.0, 192.0, 595.0, 842.0)], scans.LINES))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    assert [r.text for r in rows.collect()] == ["Some words of a line"]


def test_files_are_planned_once_and_each_has_its_row(spark):
    rows = [("/in/a.txt", b"First file of two words and more.", 1), ("/in/a.txt", b"First file of two words and more.", 1), ("/in/b.png", b"x", 2)]
    files = spark.createDataFrame(rows, "path string, content binary, t int").selectExpr("path", "content", "timestamp_seconds(t) AS modificationTime")
    out = documents.converted(files, "2026-01-01T00:00:00Z", "/in")
    assert out._jdf.queryExecution().analyzed().collectLeaves().size() <= 2
    assert sorted((r.source, r.target, r.status) for r in out.collect()) == [("/in/a.txt", "a.md", "success")] * 2 + [("/in/b.png", "b.md", "unsupported_format")]
