"""The text layer of PDF files with the standard library: lines of text and where they stand on their pages.

Objects are found by their marks, so damaged cross-reference tables don't matter. Text is what content streams show; codes
become characters by a font's ToUnicode map, else by Windows' Latin code page. Encrypted files need a password.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of the size of type that parts words on a line, and lines of a block; width of a character of unknown width.
WORD_GAP, LINE_GAP, WIDTH = 0.2, 0.6, 500.0
KINDS = "path string, page int, page_w double, page_h double, x0 double, y0 double, x1 double, y1 double, text string"

_token = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/{}%]*|\d+\s+\d+\s+R\b|[-+]?\d*\.?\d+|[^\s<>\[\]()/{}%]+|\()", re.S)
_object = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)(?=\bendobj\b|(?<!\d)\d+\s+\d+\s+obj\b|\Z)", re.S)
_escape = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The number of another object."""


def _string(raw: bytes) -> bytes:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r", b"\r\n") else _escape.get(m[1], m[1]), raw[1:-1], flags=re.S)


def _strings_with_brackets(data: bytes, at: int) -> int:
    """Where a string that holds balanced brackets ends."""
    depth = 0
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            at += 1
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
    return at


def tokens(data: bytes, at: int = 0) -> Iterator[object]:
    """Values and operators of a stretch of a file; names as str, strings as bytes, operators and brackets as (operator,)."""
    while m := _token.match(data, at):
        t, at = m[1], m.end()
        if t[:1] == b"(":
            start = m.start(1)
            at = max(at, _strings_with_brackets(data, start)) if t == b"(" or not t.endswith(b")") else at
            yield _string(data[start:at])
        elif t[:1] == b"<" and t != b"<<":
            yield _string(t)
        elif t[:1] == b"/":
            yield re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), t[1:].decode("latin-1"))
        elif t.endswith(b"R") and b" " in t or re.fullmatch(rb"\d+\s+\d+\s+R", t):
            yield Ref(int(t.split()[0]))
        else:
            try:
                yield float(t)
            except ValueError:
                yield (t.decode("latin-1"),)


def value(stream: Iterator[object], first: object = None) -> object:
    """One value: dictionaries and arrays are gathered to their ends."""
    t = next(stream) if first is None else first
    if t == ("<<",):
        out, key = {}, None
        for t in stream:
            if t == (">>",):
                break
            if key is None:
                key = t
            else:
                out[key], key = value(stream, t), None
        return out
    if t == ("[",):
        out = []
        for t in stream:
            if t == ("]",):
                break
            out.append(value(stream, t))
        return out
    return t


class File:
    def __init__(self, raw: bytes) -> None:
        if b"%PDF-" not in raw[:1024]:
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
            raise PermissionError("password needed")
        self.raw = {int(m[1]): m[2] for m in _object.finditer(raw)}
        self.read: dict[int, object] = {}
        for n in list(self.raw):
            d = self.at(n)
            if isinstance(d, dict) and d.get("Type") == "ObjStm":
                data, first = self.stream(n), int(d.get("First", 0))
                head = [int(x) for x in data[:first].split()]
                for k, (number, at) in enumerate(zip(head[::2], head[1::2])):
                    end = head[2 * k + 3] if 2 * k + 3 < len(head) else len(data) - first
                    self.raw.setdefault(number, data[first + at : first + end])

    def at(self, n: int) -> object:
        if n not in self.read:
            body = self.raw.get(n, b"")
            try:
                self.read[n] = value(tokens(body.split(b"stream", 1)[0] if b"stream" in body else body))
            except StopIteration:
                self.read[n] = None
        return self.read[n]

    def get(self, x: object) -> object:
        return self.at(x) if isinstance(x, Ref) else x

    def stream(self, n: int) -> bytes:
        d, body = self.at(n), self.raw.get(n, b"")
        m = re.search(rb"stream\r?\n", body)
        if not isinstance(d, dict) or not m:
            return b""
        size = self.get(d.get("Length"))
        data = body[m.end() : m.end() + int(size)] if isinstance(size, float) and int(size) else body[m.end() :].rsplit(b"endstream", 1)[0]
        filters = self.get(d.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "FlateDecode":
                data = zlib.decompressobj().decompress(data)
            elif f == "ASCIIHexDecode":
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0]).decode())
            else:
                return b""
        return data

    def pages(self) -> Iterator[dict]:
        """Pages in their order, with what they inherit."""
        roots = [d for d in map(self.at, list(self.raw)) if isinstance(d, dict) and d.get("Type") == "Catalog"]
        todo = [(roots[-1].get("Pages"), {})] if roots else []
        seen: set[int] = set()
        while todo:
            ref, above = todo.pop()
            d = self.get(ref)
            if not isinstance(d, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            seen.add(int(ref) if isinstance(ref, Ref) else -1 - len(seen))
            own = above | {k: d[k] for k in ("Resources", "MediaBox") if k in d}
            if "Kids" in d:
                todo += [(k, own) for k in reversed(self.get(d["Kids"]) or [])]
            else:
                yield own | d

    def content(self, page: dict) -> bytes:
        c = page.get("Contents")
        parts = self.get(c) if isinstance(self.get(c), list) else [c]
        return b"\n".join(self.stream(int(p)) for p in parts if isinstance(p, Ref))


class Font:
    def __init__(self, file: File, d: dict) -> None:
        self.wide = d.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        first, widths = file.get(d.get("FirstChar")), file.get(d.get("Widths"))
        self.widths = {int(first or 0) + k: float(file.get(w)) for k, w in enumerate(widths)} if isinstance(widths, list) else {}
        self.default = 1000.0 if self.wide else WIDTH
        if isinstance(d.get("ToUnicode"), Ref):
            self._read(file.stream(int(d["ToUnicode"])))

    def _read(self, data: bytes) -> None:
        text = lambda x: x.decode("utf-16-be", "replace")
        code = lambda x: int.from_bytes(x, "big")
        for kind, part in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
            items = list(tokens(part))
            if kind == b"char":
                self.map.update({code(a): text(b) for a, b in zip(items[::2], items[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)})
                continue
            stream = iter(items)
            for a in stream:
                b, to = next(stream, None), value(stream)
                if not isinstance(a, bytes) or not isinstance(b, bytes):
                    break
                for k in range(min(code(b) - code(a) + 1, 1 << 16)):
                    self.map[code(a) + k] = text(to[k]) if isinstance(to, list) and k < len(to) else text(to[:-2] + (code(to[-2:]) + k).to_bytes(2, "big")) if isinstance(to, bytes) else ""

    def shown(self, raw: bytes) -> tuple[str, float]:
        """Characters, and their width in thousandths of the size."""
        n = 2 if self.wide else 1
        codes = [int.from_bytes(raw[k : k + n], "big") for k in range(0, len(raw), n)]
        plain = lambda c: "" if self.wide else bytes([c]).decode("cp1252", "ignore")
        return "".join(self.map.get(c) or plain(c) for c in codes), sum(self.widths.get(c, self.default) for c in codes)


def _times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def spans(file: File, page: dict) -> Iterator[tuple[float, float, float, float, str]]:
    """(x0, baseline, x1, size, text) of what a page shows, in the order of its content."""
    resources = file.get(page.get("Resources")) or {}
    named = {k: file.get(v) for k, v in (file.get(resources.get("Font")) or {}).items()}
    fonts = {k: Font(file, d) for k, d in named.items() if isinstance(d, dict)}
    one = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    ctm, saved, line, place = one, [], one, one
    font, size, leading, args = None, 1.0, 0.0, []
    stream = tokens(file.content(page))
    for t in stream:
        if not isinstance(t, tuple) or t in (("[",), ("<<",)):
            args.append(value(stream, t))
            continue
        op, numbers = t[0], [x for x in args if isinstance(x, float)]
        if op == "q":
            saved.append(ctm)
        elif op == "Q" and saved:
            ctm = saved.pop()
        elif op == "cm" and len(numbers) == 6:
            ctm = _times(numbers, ctm)
        elif op == "BT":
            line = place = one
        elif op == "Tf" and args:
            font, size = fonts.get(args[0]) if isinstance(args[0], str) else None, numbers[-1] if numbers else size
        elif op == "TL" and numbers:
            leading = numbers[0]
        elif op == "Tm" and len(numbers) == 6:
            line = place = numbers
        elif op in ("Td", "TD") and len(numbers) == 2:
            leading = -numbers[1] if op == "TD" else leading
            line = place = _times([1, 0, 0, 1, *numbers], line)
        elif op in ("T*", "'", '"'):
            line = place = _times([1, 0, 0, 1, 0, -leading], line)
        if op in ("Tj", "TJ", "'", '"') and args and font:
            parts = args[-1] if isinstance(args[-1], list) else [args[-1]]
            text, wide = [], 0.0
            for p in parts:
                if isinstance(p, bytes):
                    shown, w = font.shown(p)
                    text.append(shown)
                    wide += w
                elif isinstance(p, float):
                    if -p > 1000 * WORD_GAP and text and not text[-1].endswith(" "):
                        text.append(" ")
                    wide -= p
            at, step = _times(place, ctm), wide / 1000 * size
            end = _times(_times([1, 0, 0, 1, step, 0], place), ctm)
            yield at[4], at[5], end[4], abs(size * (at[3] or at[1])), "".join(text)
            place = _times([1, 0, 0, 1, step, 0], place)
        args = []


def lines(raw: bytes) -> list[list[tuple[float, float, float, float, float, float, str]]]:
    """Of each page (width, height, x0, y0, x1, y1, text) of its lines, measured from the top, in the order of the content."""
    file, out = File(raw), []
    for page in file.pages():
        box = [float(x) for x in (file.get(page.get("MediaBox")) or [0, 0, 595, 842])]
        rows: list[list] = []
        for x0, y, x1, size, text in spans(file, page):
            last = rows[-1] if rows else None
            if last and abs(last[1] - y) < 0.3 * max(size, last[3]) and -size < x0 - last[2] < 2 * size:
                gap = x0 - last[2] > WORD_GAP * size and not last[4].endswith(" ") and not text.startswith(" ")
                last[2], last[3], last[4] = x1, max(size, last[3]), last[4] + (" " if gap else "") + text
            else:
                rows.append([x0, y, x1, size, text])
        w, h, top = box[2] - box[0], box[3] - box[1], box[3]
        out.append([(w, h, x0 - box[0], top - y - s, x1 - box[0], top - y + 0.2 * s, t.strip()) for x0, y, x1, s, t in rows if t.strip()])
    return out


def text(raw: bytes) -> str:
    """Pages in order, a blank line between them; lines from the top down, a blank line where the gap is wide."""
    pages = []
    for rows in lines(raw):
        rows, parts = sorted(rows, key=lambda r: (round(r[3]), r[2])), []
        for before, r in zip([None, *rows], rows):
            wide = before and r[3] - before[5] > LINE_GAP * (r[5] - r[3])
            parts.append(("\n\n" if wide else "\n" if before else "") + r[6])
        pages.append("".join(parts))
    return "\n\n".join(p for p in pages if p) + "\n"


def blocks(files: DataFrame) -> DataFrame:
    """files: path, content. A row for each line of each page; files that can't be read have none (see readers.parse)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in KINDS.split(", ")]
        for b in batches:
            for path, raw in zip(b["path"].to_pylist(), b["content"]):
                try:
                    pages = lines(raw.as_py() or b"")
                except Exception:  # noqa: BLE001
                    continue
                rows = [(path, k, *r) for k, page in enumerate(pages, 1) for r in page]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (0, 8) else pa.int32() if i == 1 else pa.float64()) for i, c in enumerate(zip(*rows))], names)

    return files.select("path", "content").mapInArrow(run, KINDS)
