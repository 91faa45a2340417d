"""The chain for prose over a whole text, in plain Python: one call for each text instead of one expression for each rule.

The rules are those of functions.text and functions.korean, from the same tables. A rule is tried only where the letters that it
needs occur, and rules for Hangul see only the lines around it, so a text without Hangul costs a few scans. Lines end at \\n.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from quillspark.functions import korean as K
from quillspark.functions import text as X

#: White space as Java's Unicode patterns have it.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LEAD, _TAIL = SPACE + "*|~^@、。", SPACE + "ᆞ~_|@#^*、。"
_MARKS = ".,!?。！？、"
_STOPPED = [blank + mark for mark in _MARKS for blank in " \t"]
_controls = bytes(x for x in (*range(32), 127) if x not in b"\t\n\r")
_line_start, _line_end = "(?<![^\n\r\x85\u2028\u2029])", "(?![^\n\r\x85\u2028\u2029])"
_labels = [re.compile(rf"{_line_start}{p}{_line_end}\n?", re.ASCII) for p in (r"\s*#{1,6}\s*페이지\s*\d+\s*", r"\s*\[페이지\s*\d+\]\s*", r"\s*\d+\s*페이지\s*", r"\s*-\s*\d+\s*-\s*")]
_dashed = re.compile(r"-\s*\d+\s*-", re.ASCII).search
_hyphens = [re.compile(rf"([{c}])-\n\s*([{c}])") for c in ("가-힣", "a-zA-Z")]
_dots = re.compile(r"(?<!\s)\s+ᆞ+\s*|ᆞ+\s*")
_ends = re.compile("\n{3,}")
_spaces = re.compile(r"(?<=\S) {2,}")
_letter = re.compile("[가-힣A-Za-z]").search
_marked = re.compile("[^ 가-힣A-Za-z]* ").match
_block = re.compile(X.BLOCK_START.removeprefix("(?U)")).match
_two = re.compile(r"\w\W*\w").search
_blanks = re.compile(f"(?<![ \t])[ \t]+([{_MARKS}])")
_brackets = [(a, re.compile(p), b) for a, p, b in (("(", r"\(\s+", "("), (")", r"(?<!\s)\s+\)", ")"), ("[", r"\[\s+", "["), ("]", r"(?<!\s)\s+\]", "]"), ("…", "…+", "..."))]
_hangul = re.compile("[가-힣]").search
_particles = [
    (re.compile(rf"([가-힣A-Za-z0-9])\n{{1,2}}\s*((?:{X.PARTICLES})(?:\s|[.,!?]|$))"), r"\1 \2"),
    (re.compile(rf"([가-힣])\n{{1,2}}\s*((?:{X.ENDINGS})(?:\s|[.,!?]|$))"), r"\1\2"),
]
_particle = re.compile(rf"\n\s*(?:{X.PARTICLES}|{X.ENDINGS})").search
_counted = re.compile("[가-힣][0-9]").search
_stuck = re.compile("[.,!?。！？][가-힣]").search
_korean_stops = [(re.compile(r"(?<![A-Za-z])\.([가-힣])"), r". \1"), (re.compile("([,!?。！？])([가-힣])"), r"\1 \2")]

# For each pattern of a table, letters of which it needs one; "" where no letters are needed.
_NEED = {
    "QUOTES": ["66", ""],
    "SPELLING_PATTERNS": ["않되", "않돼", "않", "돼", "디", "다-."],
    "AUXILIARY": ["않", "못", "수", "줄", "것", "것", "때", "때문", "해", "", "해", "몰라", "오늘|내일|어제|지금", "빛내|위로하|다독이|풍요롭게|살아가|느낄|담았|만날|읽|이끌", "필요|부족|충분|가능|어렵|쉽", "깊이|담았|읽|나누|보낼"],
    "WORD_BOUNDS": [
        "에게|에서", "들에게", "초보|선배|고객|사람|세일즈|성공|해법|매뉴얼|입문|무엇|어디|누구|어떻게|위로|다독|희망|사랑|마음|생각|노력|인생|세상|그림|명언|하루", "는|던", "하루|매일|오늘|내일|삶|사랑",
        "세일즈|마케팅|개발자|엔지니어|디자이너", "감사의글", "부록|목차|참고", "를|을|는|에|의|로|과|와", "및", "있는", "한", "할|하는|해야", "해야", "  ",
    ],
}


def _compiled(name: str) -> list[tuple[list[str], re.Pattern[str], str]]:
    return [(need.split("|"), re.compile(p), re.sub(r"\$(\d)", r"\\\1", new)) for need, (p, new) in zip(_NEED[name], getattr(K, name), strict=True)]


_QUOTES, _SPELLING, _AUXILIARY, _BOUNDS = map(_compiled, _NEED)


def _substituted(text: str, rules: list[tuple[list[str], re.Pattern[str], str]]) -> str:
    for need, pattern, new in rules:
        for x in need:
            if x in text:
                text = pattern.sub(new, text)
                break
    return text


def strip(text: str) -> str:
    return text.strip(SPACE)


def tidy(text: str) -> str:
    """Line ends to \\n; outside code fences line tails trimmed and runs of three or more line ends made two; one final line end."""
    parts = text.replace("\r\n", "\n").replace("\r", "\n").split("```")
    parts[::2] = [_ends.sub("\n\n", "\n".join(x.rstrip(SPACE) for x in p.split("\n"))) for p in parts[::2]]
    return strip("```".join(parts)) + "\n"


def symbols(text: str) -> str:
    if not text.isascii():
        text = text.replace("\u00a0", " ")
        for x in X.INVISIBLE:
            text = text.replace(x, "")
        for a, b in X.LIGATURES:
            text = text.replace(a, b)
    for a, b in X.SYMBOLS:
        text = text.replace(a, b)
    return text


def hyphens(text: str) -> str:
    if "-\n" in text:
        for p in _hyphens:
            text = p.sub(r"\1\2", text)
    return text


def artifacts(text: str) -> str:
    if "ᆞ" in text:
        text = _dots.sub(" ", text)
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(out := raw.translate(None, _controls)) == len(raw) else out.decode("utf-8", "surrogatepass")


def page_labels(text: str) -> str:
    for p in _labels[:3] if "페이지" in text else ():
        text = p.sub("", text)
    if _dashed(text):
        text = _labels[3].sub("", text)
    return _ends.sub("\n\n", text) if "\n\n\n" in text else text


def margin_noise(line: str) -> str:
    """A line without the two or more short marks before its text, and without stray marks at its ends; block lines stay."""
    if not line.strip(SPACE):
        return ""
    if _block(line):
        return line
    one = line
    if _marked(line):  # else the first word is no mark
        words = line.split(" ")
        lead = next((i for i, w in enumerate(words) if (bare := w.strip(SPACE)) and (len(bare) > 3 or _letter(w))), None)
        if lead is None:
            one = line if len(words) == 1 else ""
        elif lead >= 2:
            one = " ".join(words[lead:])
    one = one.lstrip(_LEAD).rstrip(_TAIL)
    return (_dots.sub(" ", one) if "ᆞ" in one else one).strip(SPACE)


def _kept(line: str) -> bool:
    return line[:2].isalpha() and len(line) > 1 or not line.strip(" ") or bool(_two(line))


def _blocks(text: str) -> list[tuple[bool, str]]:
    """The text in pieces of whole lines: those with Hangul, with blank lines and one other line around them, and the rest.

    No rule for Hangul matches or looks further than over white space to the letters beside it.
    """
    lines = text.split("\n")
    near = bytearray(len(lines))
    blank = [not x.strip(SPACE) for x in lines]
    for i, line in enumerate(lines):
        if not line.isascii() and _hangul(line):
            near[i] = 1
            for step, end in ((-1, -1), (1, len(lines))):
                k = i + step
                while k != end and not near[k]:
                    near[k] = 1
                    if not blank[k]:
                        break
                    k += step
    out: list[tuple[bool, str]] = []
    a = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or near[i] != near[a]:
            out.append((bool(near[a]), "\n".join(lines[a:i])))
            a = i
    return out


def _all(text: str, rules: list[tuple[re.Pattern[str], str]]) -> str:
    for pattern, new in rules:
        text = pattern.sub(new, text)
    return text


_run = re.compile("[가-힣](?:[가-힣 ]*[가-힣])?")


@lru_cache(4096)
def _spelled(run: str) -> str:
    for a, b in K.SPELLING:
        run = run.replace(a, b)
    return run


def _spelling(text: str) -> str:
    """Misspellings are Hangul and spaces, so each run of these is looked at by itself."""
    return _substituted(_run.sub(lambda m: _spelled(m[0]), text), _SPELLING)


def korean(text: str) -> str:
    """korean.refined of one text: quotes, spelling, split words, run-together words, word bounds."""
    if "66" in text and "99" in text:
        text = _substituted(text, _QUOTES[:1])
    if not text.isascii() and _hangul(text):
        pieces = [(near, K.rejoined_parts(_spelling(_substituted(x, _QUOTES[1:]) if _counted(x) else x)) if near else x) for near, x in _blocks("\n".join(text.splitlines()))]
        joins = K.Joins("\n".join(x for near, x in pieces if near))
        text = "\n".join(_spaced("\n".join(map(joins.line, x.split("\n")))) if near else x for near, x in pieces).removesuffix("\n")
    return _spaces.sub(" ", text) if "  " in text else text


def _spaced(text: str) -> str:
    lines = _substituted(text, _AUXILIARY).split("\n")
    return _substituted("\n".join(K._segmented(x) if not x.isascii() and K._core.search(x) else x for x in lines), _BOUNDS[:-1])


def punctuation(text: str, hangul: bool) -> str:
    for x in _STOPPED:
        if x in text:
            text = _blanks.sub(r"\1", text)
            break
    if hangul and _stuck(text):
        text = _all(text, _korean_stops)
    for need, p, new in _brackets:
        if need in text:
            text = p.sub(new, text)
    return text


def refine(text: str) -> str:
    """The chain for prose: characters, line ends, margins, noise lines, particles, paragraphs, Korean, punctuation, spaces. A last line end goes."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = page_labels(artifacts(hyphens(symbols(text)))).removesuffix("\n")
    text = "\n".join(x for x in map(margin_noise, text.split("\n")) if _kept(x))
    hangul = not text.isascii() and bool(_hangul(text))
    if hangul and _particle(text):
        text = _all(text, _particles)
    text = punctuation(korean(X.join_lines(text)), hangul)
    return _spaces.sub(" ", text) if "  " in text else text
