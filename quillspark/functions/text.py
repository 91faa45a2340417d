"""Text rules as Column expressions. Null counts as empty text; patterns treat letters and spaces as Unicode has them."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Categories in order, the first whose keyword occurs wins.
CATEGORIES = [
    ("글로벌 어학 & 영어", ["영어", "회화", "english", "speaking", "grammar", "voca", "토익", "toeic", "오픽", "이디엄"]),
    ("보고서", ["보고서", "결과보고", "현황보고", "출장보고", "동향", "점검결과"]),
    ("기획서", ["기획서", "제안서", "사업계획", "추진계획", "마스터플랜"]),
    ("매뉴얼", ["매뉴얼", "가이드", "지침", "규정", "절차서", "사용설명서", "이용안내"]),
    ("회의록", ["회의록", "의사록", "간담회", "토의", "의결"]),
    ("전자무역 & 비즈니스", ["무역", "trade", "bpr", "isp", "peppol", "내국신용장", "구매확인서", "수출", "수입", "통관", "선적", "운송", "ktnet", "utradehub", "인코텀즈"]),
    ("경영 & 전략 기획", ["경영", "전략", "분석", "마케팅", "세일즈", "기획", "사업계획", "컨설팅", "dbr", "조직", "성과", "맥킨지", "리더십"]),
    ("AI & 테크놀로지", ["ai", "llm", "인공지능", "코딩", "파이썬", "개발", "아키텍처", "api", "mcp", "에이전트", "클라우드", "데이터베이스"]),
    ("인문·신앙 & 라이프", ["인문", "철학", "신앙", "성경", "교회", "명언", "인생", "자기계발", "독서", "서평", "에세이"]),
    ("기술문서", ["기술명세", "시스템설계", "규격서", "api명세", "인프라"]),
]
DEFAULT_CATEGORY = "일반 지식 & 도구"
# Symbols, applied in order.
SYMBOLS = [("(tm)", "™"), ("(TM)", "™"), ("+-", "±"), ("->", "→"), ("<-", "←"), (">=", "≥"), ("<=", "≤"), ("!=", "≠"), ("deg C", "℃")]
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("æ", "ae"), ("œ", "oe")]
INVISIBLE = "\ufeff\u200b\u200c\u200d\u2060"
# Digits misread as letters.
CONFUSIONS = [("I", "1"), ("l", "1"), ("S", "5"), ("B", "8"), ("G", "6"), ("O", "0")]
# A line that opens a Markdown block.
BLOCK_START = r"(?U)^(?:\s*#{1,6}\s|\s*[-*+•◦▪▫※▶▷]\s|\s*\d+[.)]\s|\s*>\s|\s*\||\s*```|\s*[-*_]{3,}\s*$)"
# Tag variants and their standard form.
SYNONYMS = {
    "노트북lm": "NotebookLM", "notebooklm": "NotebookLM", "노트북-lm": "NotebookLM", "로컬lc": "내국신용장", "로컬-lc": "내국신용장",
    "local-lc": "내국신용장", "로컬-l-c": "내국신용장", "내국-신용장": "내국신용장", "구매-확인서": "구매확인서", "mro-대행사": "MRO-대행사",
    "mro대행사": "MRO-대행사", "mcp": "모델-컨텍스트-프로토콜", "모델-컨텍스트-프로토콜": "모델-컨텍스트-프로토콜", "vibe-coding": "바이브-코딩",
    "바이브코딩": "바이브-코딩", "ktnet": "KTNET", "uth": "uTradeHub", "utradehub": "uTradeHub", "stl": "스마트무역원장",
    "smart-trade-ledger": "스마트무역원장", "llm": "LLM", "ocr": "OCR", "agent": "AI에이전트", "ai-agent": "AI에이전트", "에이전트": "AI에이전트",
    "dbr": "동아비즈니스리뷰", "분석의힘": "분석의-힘", "세일즈입문": "세일즈-입문",
}

# Particles and endings that can't open a line.
PARTICLES = "은|는|이|가|을|를|에|의|로|으로|와|과|도|만|서|에서|에게|고|며|면|으며|어|아|지|거나|어서|아서|는데|지만|면서|도록|으면|습니다|입니다|합니다"
ENDINGS = "거나|으며|어서|아서|는데|지만|면서|도록|으면"
# Words of names and texts of material for learning English, and of technical texts that aren't.
STUDY_WORDS = [
    "영어", "회화", "구동사", "영작", "패턴회화", "생활영어", "영문법", "영어교재", "원어민", "미국인", "외국인", "쉐도잉", "이디엄", "숙어", "영어단어", "영어표현", "이보영", "오성식", "토마토", "해커스", "시나공",
    "능률", "넥서스", "길벗", "english materials",
]
STUDY_PATTERN = "english|speaking|grammar|toeic|toefl|opic|vocabulary|voca|idioms?|phrasal|conversation"
STUDY_TITLES = [
    "영어회화", "영어단어", "영어문법", "패턴회화", "생활영어", "영어교재", "toeic", "toefl", "03_english materials",
]
STUDY_CUES = ["phrasal verb", "dialogue", "idiom", "grammar in use", "speaking drill", "pronunciation tip"]
TECH_WORDS = [
    "anthropic", "openai", "claude", "chatgpt", "gemini", "llm", "coding", "프롬프트", "엔지니어링", "바이브코딩", "software", "api", "agentic", "개발자", "스타트업", "erp",
    "무역원장", "notebooklm", "노트북lm", "google", "구글", "sdlc", "context engineering", "boris cherny",
]


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def tidy(c: Column) -> Column:
    """Line ends to \\n; outside code fences line tails trimmed and runs of three or more line ends made two; one final line end."""
    plain = F.regexp_replace(F.regexp_replace(text(c), "\r\n", "\n"), "\r", "\n")
    part = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)[^\S\n]+(?=\n|$)", ""), "\n{3,}", "\n\n")
    done = F.array_join(F.transform(F.split(plain, "```", -1), lambda x, i: F.when(i % 2 == 0, part(x)).otherwise(x)), "```")
    return F.concat(strip(done), F.lit("\n"))


def language(c: Column) -> Column:
    """ko, en or mixed by the share of Hangul among Hangul and ASCII letters; ko where there is neither."""
    ko, latin = F.regexp_count(c, F.lit("[가-힣]")), F.regexp_count(c, F.lit("[a-zA-Z]"))
    share = ko / F.nullif(ko + latin, F.lit(0))
    return F.when(share.isNull() | (share > 0.7), "ko").when(share < 0.2, "en").otherwise("mixed")


def category(c: Column, name: Column | None = None, whole_words: bool = False) -> Column:
    """The first category one of whose keywords occurs in the name or the first 3,000 characters, lower-cased."""
    x = F.lower(F.concat(name if name is not None else F.lit(""), F.lit(" "), F.substring(text(c), 1, 3000)))
    out = None
    for label, words in CATEGORIES:
        pattern = "|".join(w.lower() for w in words)
        hit = x.rlike(rf"(?U)\b(?:{pattern})\b" if whole_words else pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(DEFAULT_CATEGORY)


def title(c: Column, fallback: Column) -> Column:
    """The first heading or short plain line of over two characters that isn't a structural label; else the fallback."""
    stripped = F.transform(lines(text(c)), lambda x: F.trim(x))
    bare = F.filter(stripped, lambda x: x.startswith("#") | (F.length(x).between(2, 60) & ~x.rlike(r"^(?:[-*|>\[]|```|http|값)")))
    named = F.transform(bare, lambda x: F.trim(F.regexp_replace(x, "^#+", "")))
    good = F.filter(named, lambda x: (F.length(x) > 2) & ~x.rlike(r"(?i)^(?:PART|CHAPTER|SECTION|제\s*\d+\s*[장절편]|부록|페이지|슬라이드|시트)"))
    return F.coalesce(F.get(good, F.lit(0)), fallback)


def summary(c: Column, most: int = 220) -> Column:
    """A marked summary quote, else the first two plain lines, cut at `most` characters."""
    quote = F.nullif(F.trim(F.regexp_extract(text(c), r">\s*(?:📌|🎯)\s*(?:\*\*[^*\n]+\*\*:?\s*)?([^\n]+)", 1)), F.lit(""))
    plain = F.filter(F.transform(lines(text(c)), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(?:[#\-*|>\[]|```|http|값|ISBN|PART|CHAPTER|SECTION|부록|감사의)"))
    first = F.nullif(F.array_join(F.slice(plain, 1, 2), " "), F.lit(""))
    return F.substring(F.coalesce(quote, first, F.lit("문서 내용 요약 정보가 없습니다.")), 1, most)


def entities(c: Column, most: int = 6, none: list[str] | None = None) -> Column:
    """Companies, organisations, then acronyms; the first `most` distinct ones of two or more characters and not in `none`, sorted."""
    found = F.concat(
        F.regexp_extract_all(c, F.lit(r"(?:주식회사\s+|㈜|\(주\))([가-힣A-Za-z0-9]+)"), 1),
        F.regexp_extract_all(c, F.lit(r"([가-힣A-Za-z0-9]+(?:위원회|공사|진흥원|협회|재단|연구원|은행|대학|본부|센터))"), 1),
        F.regexp_extract_all(c, F.lit(r"([A-Z]{2,}(?:[-_][A-Z0-9]+)*)"), 1),
    )
    good = lambda x: (F.length(x) >= 2) & ~x.isin(*none) if none else F.length(x) >= 2
    return F.array_sort(F.slice(F.array_distinct(F.filter(found, good)), 1, most))


def doc_id(path: Column, changed: Column, day: str) -> Column:
    """doc_<day>_<first 8 digits of sha256(path:changed)>."""
    return F.concat(F.lit(f"doc_{day}_"), F.substring(F.sha2(F.concat_ws(":", path, changed.cast("string")), 256), 1, 8))


def symbols(c: Column) -> Column:
    """Invisible characters out, ligatures and ASCII symbols replaced. (NFKC isn't a built-in: see functions.unicode.)"""
    c = F.translate(F.translate(c, "\u00a0", " "), INVISIBLE, "")
    for a, b in [*LIGATURES, *SYMBOLS]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def confusion(c: Column) -> Column:
    """Letters between digits that stand for digits, and I or 1 between small letters."""
    for wrong, right in CONFUSIONS:
        c = F.regexp_replace(c, f"(?<=[0-9]){wrong}(?=[0-9])", right)
    return F.regexp_replace(c, "(?<=[a-z])[I1](?=[a-z])", "l")


def hyphens(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)([가-힣])-\n\s*([가-힣])", "$1$2"), r"(?U)([a-zA-Z])-\n\s*([a-zA-Z])", "$1$2")


def artifacts(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "(?U)\\s*ᆞ+\\s*", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def page_labels(c: Column) -> Column:
    """Lines that are only a page label or a number between dashes go; runs of three or more line ends become two."""
    for p in (r"\s*#{1,6}\s*페이지\s*\d+\s*", r"\s*\[페이지\s*\d+\]\s*", r"\s*\d+\s*페이지\s*", r"\s*-\s*\d+\s*-\s*"):
        c = F.regexp_replace(c, rf"(?m)^{p}$\n?", "")
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def punctuation(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]+([.,!?。！？、])", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"(?<![A-Za-z])\.([가-힣])", ". $1"), r"([,!?。！？])([가-힣])", "$1 $2")
    for a, b in ((r"\(\s+", "("), (r"\s+\)", ")"), (r"\[\s+", "["), (r"\s+\]", "]"), ("…+", "...")):
        c = F.regexp_replace(c, f"(?U){a}", b)
    return c


def noise_lines(c: Column) -> Column:
    """Lines that aren't blank but hold fewer than two letters or digits go."""
    kept = F.filter(lines(c), lambda x: (F.trim(x) == "") | (F.length(F.regexp_replace(x, r"(?U)[^\w가-힣]", "")) >= 2))
    return F.array_join(kept, "\n")


def margin_noise(c: Column) -> Column:
    """A line without the two or more short marks before its text, and without stray marks at its ends; block lines stay."""
    words = F.split(c, " ", -1)
    mark = lambda w: (strip(w) == "") | ((F.length(strip(w)) <= 3) & ~w.rlike("[가-힣A-Za-z]"))
    lead = F.array_position(F.transform(words, mark), False)
    bare = F.when(lead == 0, F.when(F.size(words) == 1, c).otherwise("")).when(lead > 2, F.array_join(F.slice(words, lead, F.size(words)), " ")).otherwise(c)
    one = F.when(c.rlike("^[^ 가-힣A-Za-z]* "), bare).otherwise(c)  # else the first word is no mark
    for pattern, new in ((r"(?U)^[\s*|~^@、。]+", ""), (r"(?U)[\sᆞ~_|@#^*、。]+$", ""), (r"(?U)\s*ᆞ+\s*", " ")):
        one = F.regexp_replace(one, pattern, new)
    return F.when(strip(c) == "", "").when(c.rlike(BLOCK_START), c).otherwise(strip(one))


def split_particles(c: Column) -> Column:
    """A particle or ending that opens a line goes back to its word: with a space, or none if it can only be an ending."""
    c = F.regexp_replace(c, rf"(?U)([가-힣A-Za-z0-9])\n{{1,2}}\s*((?:{PARTICLES})(?:\s|[.,!?]|$))", "$1 $2")
    return F.regexp_replace(c, rf"(?U)([가-힣])\n{{1,2}}\s*((?:{ENDINGS})(?:\s|[.,!?]|$))", "$1$2")


def study_material(c: Column, name: Column) -> Column:
    """Material for learning English, by its name (path and title), or by two cues in the first 3,000 characters."""
    name, head = F.lower(text(name)), F.lower(F.substring(text(c), 1, 3000))
    has = lambda x, words: F.array_contains(F.array(*[x.contains(w) for w in words]), True)
    cues = sum((head.contains(w).cast("int") for w in STUDY_CUES), F.lit(0))
    named = has(name, STUDY_WORDS) | name.rlike(rf"(?U)\b(?:{STUDY_PATTERN})\b")
    tech = has(name, TECH_WORDS)
    return F.when(tech & ~has(name, STUDY_TITLES), False).otherwise(named | (~tech & (cues >= 2)))


def latin_word_lines(c: Column) -> Column:
    """A line that is one Latin word goes on the end of the line before, if that ends in Latin text."""
    return F.regexp_replace(c, r"(?<=[A-Za-z’'.,;:-])[ \t]*\n[ \t]*(?=[A-Za-z’'.,;:!?-]{1,20}[ \t]*(?:\n|\z))", " ")


_one_word = re.compile("\\s*[“\"'‘(]?[가-힣]{1,8}[.,!?”\"'’)…]*\\s*")


@F.pandas_udf(StringType())
def _word_per_line(x: pd.Series) -> pd.Series:
    def one(t: str) -> str:
        out: list[str] = []
        for single, run in groupby(t.split("\n"), lambda line: bool(_one_word.fullmatch(line))):
            run = [line.strip() for line in run] if single else list(run)
            out += [" ".join(run)] if single and len(run) >= 3 else run
        return "\n".join(out)

    return x.map(one, na_action="ignore")


def word_per_line(c: Column) -> Column:
    """Three or more lines in a row of one Hangul word of up to eight letters each become one line."""
    return _word_per_line(c)


def canonical(slug: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(slug)), slug)


def slug(c: Column) -> Column:
    x = F.regexp_replace(F.translate(F.regexp_replace(c, r"\(.*?\)", ""), "/·", "  "), r"(?U)\s+", " ")
    x = F.regexp_replace(F.regexp_replace(F.trim(x), " ", "-"), r"[^0-9A-Za-z가-힣_\-]", "")
    return F.regexp_replace(F.regexp_replace(x, "-{2,}", "-"), "^-+|-+$", "")


def foreign_glyphs(c: Column) -> Column:
    """Control, extended Cyrillic, Hebrew, Arabic, Indic or private-use characters: signs of a broken font map."""
    return c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{460}-\x{dff}\x{e000}-\x{f8ff}]")


def table(rows: Column) -> Column:
    """array<array<string>> to a Markdown grid, or tab-separated lines where a cell is long or there is one column."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda v: F.trim(F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|")))))
    full = F.filter(clean, lambda r: F.exists(r, lambda v: v != ""))
    width = F.array_max(F.transform(full, lambda r: F.size(r)))
    wide = F.exists(full, lambda r: F.exists(r, lambda v: (F.length(v) > 40) | v.contains("<br>")))
    padded = F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = F.transform(F.get(padded, F.lit(0)), lambda v, i: F.when(v == "", F.concat(F.lit("열 "), (i + 1).cast("string"))).otherwise(v))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width.cast("int")))
    grid = F.array_join(F.concat(F.array(line(head), rule), F.transform(F.slice(padded, F.lit(2), F.greatest(F.size(padded), F.lit(1))), line)), "\n")
    flat = F.array_join(F.transform(full, lambda r: F.array_join(F.filter(r, lambda v: v != ""), "  \t  ")), "\n")
    return F.when(F.size(full) == 0, "").when(wide | (width == 1), flat).otherwise(grid)


_block = re.compile(BLOCK_START.removeprefix("(?U)")).match
_short_goes_on = re.compile("(?:은|는|이|가|을|를|에|의|로|으로|와|과|도|만|고|며|면|서|등|,)$").search
_chapter = re.compile(r"(?i)(?:PART|CHAPTER|SECTION|제\s*\d+\s*[장절편]|부록|감사의\s*글|\d+[.．]\s|\|)").match


def join_lines(text: str) -> str:
    """Lines broken inside a sentence joined by a space. What decides of the line joined so far is how it begins, ends and how long it is."""
    out: list[list[str]] = []
    size = 0
    for line in text.split("\n"):
        bare = line.strip()
        if out and out[-1][0].strip() and bare:
            first, end = out[-1][0].lstrip(), out[-1][-1].rstrip()
            short = size < 10 and not _short_goes_on(end)
            ended = end[-1] in ".!?。！？…:;" and not (first[0] in "“\"‘'" and end[-1] not in "”\"’'")
            if not (short or ended or _chapter(bare) or _block(out[-1][0]) or _block(line) or line.startswith(("  ", "\t", "　"))):
                out[-1][-1] = out[-1][-1].rstrip()
                out[-1].append(line.lstrip())
                size += 1 + len(bare)
                continue
        out.append([line])
        size = len(bare)
    return "\n".join(map(" ".join, out))


@F.pandas_udf(StringType())
def _join_lines(x: pd.Series) -> pd.Series:
    return x.map(join_lines, na_action="ignore")


def joined_paragraphs(c: Column) -> Column:
    """Lines broken inside a sentence joined by a space, in one pass over each text."""
    return _join_lines(c)
