"""Readers of document files: one row per file, from Spark's binaryFile source, parsed with the standard library."""

from __future__ import annotations

import csv
import html
import html.parser
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillspark.functions.unicode import decode

#: Suffixes and their kinds; images; those that need a desktop application or a recogniser.
TYPES = {
    "docx": "docx", "doc": "doc", "rtf": "rtf", "pptx": "pptx", "ppt": "ppt", "xlsx": "xlsx", "xlsm": "xlsx", "xls": "xls", "hwp": "hwp", "hwpx": "hwpx", "pdf": "pdf",
    "epub": "epub", "txt": "txt", "md": "md", "markdown": "md", "html": "html", "htm": "html", "csv": "csv", "json": "json", "xml": "xml",
    "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "tiff": "image", "tif": "image", "webp": "image",
}
IMAGES = tuple(k for k, v in TYPES.items() if v == "image")
UNREADABLE = ("doc", "ppt", "xls", "hwp", *IMAGES)
#: Folders that a scan leaves out.
PRUNED = ("venv", "__pycache__", ".git", "output_md", "결과_MD", "변환리포트", "node_modules")
#: Bytes of markup that one archive may unpack to.
MOST_XML = 1 << 28
Reader = Callable[[bytes], tuple[str | None, str]]
SCHEMA = "path string, ext string, status string, encoding string, body string, error string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == name)


def _natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def _grid(rows: list[list[str]]) -> str:
    rows = [r for r in rows if any(v.strip() for v in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [[v.replace("\n", "<br>").replace("|", "\\|").strip() for v in r] + [""] * (width - len(r)) for r in rows]
    if width == 1 or any(len(v) > 40 for r in rows for v in r):
        return "\n".join("  \t  ".join(v for v in r if v) for r in rows)
    head, rest = rows[0], rows[1:]
    return "\n".join("| " + " | ".join(r) + " |" for r in (head, ["---"] * width, *rest))


# Words of a glossary's header and of a table of examples, lengths and rows of the forms of a sheet.
GLOSSARY, EXAMPLES = "표현 단어 english korean phrase word".split(), "뜻 의미 예문 해석 meaning example keyword 단어 표현 구분 설명".split()
LONG, LONG_ROWS, GRID_ROWS, GRID_CHARS = 30, 20, 30, 25


def sheet(name: str, rows: list[list[str]]) -> str:
    """A sheet by its form: glossary (two columns), examples under their headwords, short grid, or rows of cells. Without cells: empty."""
    rows = [[" ".join(re.split("\r\n|\r|\n", (v or "").strip())) for v in r] for r in rows]
    used = [i for i in range(max(map(len, rows), default=0)) if any(r[i] for r in rows if i < len(r))]
    rows = [x for r in rows if any(x := [r[i] if i < len(r) else "" for i in used])]
    if not rows:
        return ""
    title, head = f"### 시트: {name} (총 {len(rows)}행)\n\n", rows[0]
    if len(used) == 2:
        forms = {(True, True): "• **{0}**: {1}", (True, False): "• {0}", (False, True): "  {1}"}
        lines = [forms[bool(a), bool(b)].format(a, b) for a, b in rows]
        if any(w in head[0].lower() for w in GLOSSARY):
            lines[0] = f"**[분류 헤더: {head[0]} - {head[1]}]**\n"
        return title + "\n".join(lines)
    if any(w in " ".join(head).lower() for w in EXAMPLES) and len(rows) > 1 and any(len(v) > LONG for r in rows[:LONG_ROWS] for v in r):
        lines = []
        for n, r in enumerate(rows[1:], 1):
            lines.append(f"#### {n}. {r[0] or f'항목 {n}'}")
            lines += [f"- **{h or f'항목 {i}'}**: {v}" for i, (h, v) in enumerate(zip(head[1:], r[1:]), 2) if v] + [""]
        return title + "\n".join(lines)
    if len(rows) <= GRID_ROWS and all(len(v) <= GRID_CHARS for r in rows for v in r):
        cells = [[v.replace("|", "\\|") for v in r] for r in rows]
        cells[0] = [v or f"열 {i}" for i, v in enumerate(cells[0], 1)]
        return title + "\n".join(f"| {' | '.join(r)} |" for r in (cells[0], ["---"] * len(used), *cells[1:]))
    return title + "\n".join("  |  ".join(filter(None, r)) for r in rows)


@F.pandas_udf(StringType())
def _sheet(name: pd.Series, rows: pd.Series) -> pd.Series:
    return pd.Series([sheet(n or "", [list(r) for r in x if r is not None] if x is not None else []) for n, x in zip(name, rows)], dtype=object)


def sheet_text(name: Column, rows: Column) -> Column:
    """sheet() of an array of rows of cells."""
    return _sheet(name, rows)


def _docx(z: zipfile.ZipFile) -> str:
    body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body")

    def blocks(parent: ElementTree.Element) -> Iterator[str]:
        for x in parent:
            if _local(x.tag) == "p":
                style = next((v for y in x.iter() if _local(y.tag) == "pStyle" for k, v in y.attrib.items() if _local(k) == "val"), "")
                level = re.fullmatch(r"(?i)heading\s*(\d+)", style)
                line = _text(x)
                yield ("#" * min(int(level[1]), 3) + " " if level and line else "") + line
            elif _local(x.tag) == "tbl":
                cells = [[c for c in r if _local(c.tag) == "tc"] for r in x if _local(r.tag) == "tr"]
                flat = [c for r in cells for c in r]
                inner = [p for c in flat for p in c.iter() if _local(p.tag) == "p"]
                nested = any(_local(y.tag) == "tbl" for c in flat for y in c.iter())
                mean = sum(len(_text(c)) for c in flat) / max(len(flat), 1)
                if max(map(len, cells), default=0) <= 1 or nested or len(inner) > len(flat) or mean > 50:
                    for c in flat:
                        yield from blocks(c)
                else:
                    yield _grid([["\n".join(_text(p) for p in c if _local(p.tag) == "p") for c in r] for r in cells])

    return "\n\n".join(b for b in blocks(body) if b.strip())


def _pptx(z: zipfile.ZipFile) -> str:
    out = []
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_natural)
    for i, name in enumerate(slides, 1):
        shapes = []
        for x in ElementTree.fromstring(z.read(name)).iter():
            if _local(x.tag) in ("sp", "graphicFrame"):
                off = next((y for y in x.iter() if _local(y.tag) == "off"), None)
                at = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)
                rows = [[_text(c) for c in r if _local(c.tag) == "tc"] for r in x.iter() if _local(r.tag) == "tr"]
                if rows:
                    two = max(map(len, rows)) == 2
                    shapes.append((at, "\n".join(f"• {r[0]}: {r[1]}" if two and len(r) == 2 else " | ".join(r) for r in rows)))
                else:
                    shapes.append((at, "\n".join(t for p in x.iter() if _local(p.tag) == "p" and (t := _text(p)).strip())))
        out.append(f"### 슬라이드 {i}\n\n" + "\n\n".join(t for _, t in sorted(shapes, key=lambda s: s[0]) if t.strip()))
    return "\n\n".join(out)


def _xlsx(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"] if "xl/sharedStrings.xml" in names else []
    titles = [x.get("name", "") for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
    out = []
    for k, name in enumerate(sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_natural)):
        rows = []
        for r in ElementTree.fromstring(z.read(name)).iter():
            if _local(r.tag) == "row":
                row: dict[int, str] = {}
                for c in r:
                    if _local(c.tag) == "c":
                        letters = re.match("[A-Z]*", c.get("r", ""))[0]
                        at = 0
                        for ch in letters:
                            at = at * 26 + ord(ch) - 64
                        raw = _text(c, "v")
                        row[at - 1 if letters else len(row)] = shared[int(raw)] if c.get("t") == "s" and raw else raw or _text(c)
                if any(v.strip() for v in row.values()):
                    rows.append([row.get(i, "") for i in range(max(row) + 1)])
        used = [i for i in range(max(map(len, rows), default=0)) if any(i < len(r) and r[i].strip() for r in rows)]
        rows = [[r[i] if i < len(r) else "" for i in used] for r in rows]
        if rows:
            out.append(sheet(titles[k] if k < len(titles) else name, rows))
    return "\n\n".join(out)


def _hwpx(z: zipfile.ZipFile) -> str:
    """Sections in natural order, so that the tenth follows the ninth."""
    out = []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=_natural):
        out += [t for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "p" and (t := _text(x)).strip()]
    return "\n\n".join(out)


class _Markdown(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("p", "div", "article", "section", "nav", "footer", "header", "ul", "ol", "table", "tr"):
            self.out.append("\n\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(page: str | None) -> str:
    """Headings, bullets and paragraphs; scripts and styles dropped with what they hold."""
    m = _Markdown()
    m.feed(page or "")
    m.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(m.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


def _epub(z: zipfile.ZipFile) -> str:
    root = next(x.get("full-path") for x in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(x.tag) == "rootfile")
    opf, at = ElementTree.fromstring(z.read(root)), posixpath.dirname(root)
    items = {x.get("id"): x.get("href") for x in opf.iter() if _local(x.tag) == "item"}
    spine = [items.get(x.get("idref")) for x in opf.iter() if _local(x.tag) == "itemref"]
    names = set(z.namelist())
    files = [n for h in spine if h and (n := posixpath.normpath(posixpath.join(at, h))) in names]
    return "\n\n---\n\n".join(html_to_markdown(decode(z.read(n))[1]).strip() for n in files)


def _csv(raw: bytes) -> tuple[str, str]:
    encoding, text = decode(raw)
    return encoding, _grid([list(r) for r in csv.reader(io.StringIO(text))])


def _html(raw: bytes) -> tuple[str, str]:
    encoding, text = decode(raw)
    return encoding, html_to_markdown(text)


def _rtf(raw: bytes) -> tuple[str, str]:
    """The text of a rich-text file: paragraphs and tabs; groups that hold no text (fonts, colours, pictures, fields' codes) dropped."""
    text = raw.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        raise ValueError("not a rich-text file")
    page = re.search(r"\\ansicpg(\d+)", text)
    encoding = f"cp{page[1]}" if page else "cp1252"
    out, pending, depth, hidden, skip = [], bytearray(), 0, 0, 0

    def flush() -> None:
        out.append(pending.decode(encoding, "replace"))
        pending.clear()

    for m in re.finditer(r"\\u(-?\d+) ?|\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|([^\\{}\r\n]+)", text):
        code, byte, word, _, sign, brace, plain = m.groups()
        if brace:
            depth += 1 if brace == "{" else -1
            hidden = 0 if hidden > depth else hidden
        elif not hidden and (word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "fldinst") or sign == "*"):
            hidden = depth
        elif hidden:
            continue
        elif byte or (plain and skip):
            if skip:  # what stands for a character that was given by its number
                skip, plain = 0, (plain or "")[1:]
                pending.extend(plain.encode("latin-1"))
            elif byte:
                pending.append(int(byte, 16))
        elif plain:
            pending.extend(plain.encode("latin-1"))
        else:
            flush()
            skip = 1 if code else 0
            out.append(chr(int(code) % 65536) if code else {"par": "\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n"}.get(word, "") if word else sign if sign in "\\{}" else {"~": " "}.get(sign, ""))
    flush()
    return encoding, re.sub(r"\n{3,}", "\n\n", "".join(out)).strip() + "\n"


def _zip(read: Callable[[zipfile.ZipFile], str]) -> Reader:
    def run(raw: bytes) -> tuple[None, str]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if any(x.flag_bits & 1 for x in z.infolist()):
                raise PermissionError("password needed")
            if sum(x.file_size for x in z.infolist() if x.filename.endswith((".xml", ".html", ".xhtml", ".opf"))) > MOST_XML:
                raise ValueError("more text than a file may hold")
            return None, read(z)

    return run


def _any_text(tag: str) -> Callable[[zipfile.ZipFile], str]:
    """What is left of a damaged file: the text of its tags, without its structure."""
    def read(z: zipfile.ZipFile) -> str:
        parts = [z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist(), key=_natural) if n.endswith(".xml")]
        return "\n\n".join(html.unescape("".join(re.findall(rf"<(?:\w+:)?{tag}(?: [^>]*)?>([^<]*)<", p))) for p in parts).strip()

    return read


def _pdf(raw: bytes) -> tuple[None, str]:
    from quillspark.sources import pdf

    return None, pdf.text(raw)


#: Readers of a suffix, in the order in which they are tried: a later one takes what an earlier one can't read.
READERS: dict[str, list[Reader]] = {
    **{k: [decode] for k in ("txt", "md", "markdown", "json", "xml")}, **{k: [_html] for k in ("html", "htm")}, "csv": [_csv, decode], "rtf": [_rtf], "pdf": [_pdf],
    "docx": [_zip(_docx), _zip(_any_text("t"))], "pptx": [_zip(_pptx), _zip(_any_text("t"))], **{k: [_zip(_xlsx)] for k in ("xlsx", "xlsm")}, "hwpx": [_zip(_hwpx), _zip(_any_text("t"))], "epub": [_zip(_epub)],
}


def register(suffix: str, reader: Reader, first: bool = True) -> None:
    """Adds a reader of bytes (encoding or None, text) for a suffix, before or after those that there are.

    Readers go to executors with the functions that use them, so register before a query is made.
    """
    READERS.setdefault(suffix, []).insert(0 if first else len(READERS.get(suffix, [])), reader)


def readable(suffix: str) -> bool:
    return bool(READERS.get(suffix))


def availability(spark: SparkSession) -> DataFrame:
    """suffix, kind, readable, reason: which formats can be read, and why others can't."""
    kinds = {**TYPES, **{k: TYPES.get(k, k) for k in READERS}}
    reason = lambda k: None if readable(k) else "needs a recogniser: see operators.scans" if k in IMAGES else "needs the application that wrote it"
    return spark.createDataFrame([(k, v, readable(k), reason(k)) for k, v in kinds.items()], "suffix string, kind string, readable boolean, reason string")


def convert(ext: str, raw: bytes | None, chain: list[Reader] | None = None) -> tuple[str, str | None, str, str | None]:
    """status, encoding, body, error of one file. Whatever a file does to a reader, it costs that file only."""
    status, encoding, error = "unsupported_format", None, f"no reader for .{ext}"
    for reader in READERS.get(ext, []) if chain is None else chain:
        try:
            encoding, body = reader(raw or b"")
        except PermissionError as e:
            return "password_protected", None, "", str(e)
        except Exception as e:  # noqa: BLE001
            status, error = "corrupted_file", f"{type(e).__name__}: {e}"
            continue
        if body.strip():
            return "success", encoding, body, None
        status, error = "failed", "empty document"
    return status, encoding, "", error


def parse(files: DataFrame, *keep: str) -> DataFrame:
    """files: path, content. A row per file; one that can't be read keeps its row, with a status and an error. keep: further columns to carry along."""
    chains = dict(READERS)
    files = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "content", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exts = [x or "" for x in b["ext"].to_pylist()]
            done = [convert(ext, None if raw is None else raw.as_py(), chains.get(ext, [])) for ext, raw in zip(exts, b["content"])]
            cols = list(zip(*done)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b["path"], *(pa.array(c, pa.string()) for c in (exts, *cols)), *(b[k] for k in keep)], ["path", "ext", "status", "encoding", "body", "error", *keep])

    return files.mapInArrow(run, StructType([*StructType.fromDDL(SCHEMA), *(files.schema[k] for k in keep)]))


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Supported files below a folder, without pruned folders: path, modificationTime, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    inside = "/(?:" + "|".join(re.escape(p) for p in PRUNED) + ")/"
    return files.where(ext.isin(*TYPES, *READERS) & ~F.col("path").rlike(inside)).dropDuplicates(["path"])


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """The files of scan() without their content, by suffix and name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return scan(spark, path, recursive).select("path", "modificationTime", "length").orderBy(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)), F.lower(name), "path")
