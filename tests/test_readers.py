import io
import zipfile

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.unicode import decode, nfkc
from quillspark.operators import corpus as O
from quillspark.sources import readers, sinks


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_formats():
    w = 'xmlns:w="urn:w"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    docx = zipped({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("c")}{cell("d")}</w:tr></w:tbl></w:body></w:document>'})
    assert readers.convert("docx", docx)[2] == "# Head\n\nBody\n\n| a | b |\n| --- | --- |\n| c | d |"
    shape = lambda y, t: f'<p:sp xmlns:p="p" xmlns:a="a"><a:off x="0" y="{y}"/><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>'
    pptx = zipped({f"ppt/slides/slide{n}.xml": f"<s>{shape(9, 'low')}{shape(1, f'top{n}')}</s>" for n in (10, 2)})
    assert readers.convert("pptx", pptx)[2] == "### 슬라이드 1\n\ntop2\n\nlow\n\n### 슬라이드 2\n\ntop10\n\nlow"
    xlsx = zipped({"xl/workbook.xml": '<w><sheet name="S"/></w>', "xl/sharedStrings.xml": "<s><si><t>k</t></si></s>", "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2"><v>6</v></c><c r="C2"><v>7</v></c></row></w>'})
    assert readers.convert("xlsx", xlsx)[2] == "### 시트: S (총 2행)\n\n• **k**: 5\n• **6**: 7"
    hwpx = zipped({f"Contents/section{n}.xml": f"<s><p><t>part</t><t>{n}</t></p></s>" for n in (10, 2)})
    assert readers.convert("hwpx", hwpx)[2] == "part2\n\npart10"
    epub = zipped({"META-INF/container.xml": '<c><rootfile full-path="o/c.opf"/></c>', "o/c.opf": '<p><item id="b" href="b.html"/><item id="a" href="a.html"/><itemref idref="a"/><itemref idref="b"/><itemref idref="z"/></p>', "o/a.html": "<h1>A</h1>", "o/b.html": "<p>B</p>"})
    assert readers.convert("epub", epub)[2] == "# A\n\n---\n\nB"
    assert readers.convert("docx", b"junk")[0] == "corrupted_file" and readers.convert("hwp", b"x")[0] == "unsupported_format" and readers.convert("txt", b" ")[0] == "failed"
    assert readers.html_to_markdown("<h2>T</h2><script>x</script><ul><li>a<li>b</ul>") == "## T\n\n- a\n- b\n"


def test_encodings():
    assert decode("가".encode())[0] == "utf-8" and decode(b"\xef\xbb\xbfx") == ("utf-8-sig", "x") and decode(None)[1] == ""


def test_encodings_without_a_mark():
    text = "한글로 쓴 긴 문장을 바이트로 바꾸어 다시 읽는다. 모든 낱말이 그대로 돌아와야 한다.\n" * 5
    assert decode(text.encode("cp949"))[1] == text


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "venv").mkdir()
    for name in ("a.txt", "b.md", "c.bin", "venv/d.txt"):
        (tmp_path / name).write_text("hello")
    out = readers.parse(readers.scan(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.ext, r.status, r.body) for r in out) == [("md", "success", "hello"), ("txt", "success", "hello")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_korean_lines(spark):
    s = lambda t: F.lit(t)
    assert one(spark, X.joined_paragraphs(s("한국무역정보통신은\n전자무역 인프라 혁신을\n지속적으로 추진하고 있습니다.\n\n새로운 문단입니다."))) == "한국무역정보통신은 전자무역 인프라 혁신을 지속적으로 추진하고 있습니다.\n\n새로운 문단입니다."
    assert one(spark, X.hyphens(s("스마트 정보통-\n신망 인프라"))) == "스마트 정보통신망 인프라"
    for a, b in (("끝났다 .", "끝났다."), ("( 괄호 )", "(괄호)"), ("했다.그리고", "했다. 그리고"), ("www.naver.com", "www.naver.com"), ("U.S.의 정책", "U.S.의 정책"), ("No, there is no failure", "No, there is no failure")):
        assert one(spark, X.punctuation(s(a))) == b
    assert one(spark, X.tidy(s("a  \n\n\n\nb\n```\nx\n\n\ny  \n```\n"))) == "a\n\nb\n```\nx\n\n\ny  \n```\n"
    assert one(spark, X.language(s("가나다라 ab"))) == "mixed" and one(spark, X.language(s("12"))) == "ko" and one(spark, X.language(s("가나다라마 a"))) == "ko"
    assert one(spark, X.category(s("출장보고 자료"))) == "보고서"
    assert one(spark, nfkc(s("ｆｕｌｌ ①"))) == "full 1"
    assert one(spark, X.table(F.array(F.array(s("헤더1"), s("헤더2")), F.array(s("데이터A"), s("데이터B|파이프"))))) == "| 헤더1 | 헤더2 |\n| --- | --- |\n| 데이터A | 데이터B\\|파이프 |"
    assert "|" not in one(spark, X.table(F.array(F.array(s("x" * 41), s("y")))))
    assert one(spark, X.foreign_glyphs(s("가"))) and not one(spark, X.foreign_glyphs(s("가 abc é")))


def test_front_matter(spark):
    front, body = sinks.split_front_matter(F.lit("---\na: 1\n---\n# T\n"))
    assert one(spark, front) == "a: 1" and one(spark, body) == "# T\n"
    assert one(spark, sinks.split_front_matter(F.lit("plain"))[0]) is None


def test_page_numbers(spark):
    rows = spark.createDataFrame([(1, p, p + 10) for p in (1, 2, 3)] + [(1, 9, 19), (1, 2, 2)], "doc int, page int, value int")
    assert {(r.page, r.value) for r in O.page_numbers(rows).collect()} == {(1, 11), (2, 12), (3, 13)}


def test_stream_equals_batch(spark, tmp_path):
    from quillspark.streaming.incremental import enriched, run_available

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/in")
    run_available(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(enriched(docs).collect())


def test_forms_of_sheets():
    assert readers.sheet("S", [["단어", "뜻"], ["apple", "사과"], ["pear", ""], ["", "배"]]).split("\n\n", 1)[1] == "**[분류 헤더: 단어 - 뜻]**\n\n• **apple**: 사과\n• pear\n  배"
    long = readers.sheet("S", [["단어", "뜻", "예문"], ["apple", "사과", "x" * 31], ["", "배", ""]]).split("\n\n", 1)[1]
    assert long == f"#### 1. apple\n- **뜻**: 사과\n- **예문**: {'x' * 31}\n\n#### 2. 항목 2\n- **뜻**: 배\n"
    assert readers.sheet("S", [["a", "", "c|d"], ["1", "", "2"], ["", "x", "3"]]).endswith("| a | 열 2 | c\\|d |\n| --- | --- | --- |\n| 1 |  | 2 |\n|  | x | 3 |")
    assert readers.sheet("S", [["a" * 26, "b", "c"], ["1", "", "3"]]).endswith(f"{'a' * 26}  |  b  |  c\n1  |  3")
    assert readers.sheet("S", []) == readers.sheet("S", [["", " "]]) == ""
