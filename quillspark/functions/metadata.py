"""What a document's front matter says of it: title, summary, tags, entities, category. Null counts as empty."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.functions import prose
from quillspark.functions import text as X

# Labels of structure that are no titles, and words that are no tags.
LABELS = [
    "문서 메타", "한줄 요약", "핵심 지식", "요약", "개요", "목차", "위키화", "확인 필요", "문서 제목", "본문 내용", "문서 개요", "표 및 데이터",
    "추출 품질 및 검토 사항", "원본 정보", "부록", "감사의 글", "참고 문헌", "색인", "일러두기", "머리말", "프롤로그", "에필로그",
    "rainbow series", "rainbow series no.1", "rainbow series no", "no.1", "no.2", "no.3",
]
NO_TAGS = [
    "목적", "배경", "구성", "명칭", "개요", "요약", "결론", "서론", "정의", "특징", "핵심", "내용", "방법", "절차", "흐름", "개념", "용어", "주요 개념", "핵심 문장",
    "프로젝트 문서셋 명칭", "대상 독자 및 소비 시스템", "문서셋 구성", "프로젝트 명칭", "대상 독자", "작성 목적", "한줄 요약", "핵심 지식", "문서 메타", "문서", "사항",
    "기준", "현황", "추진", "계획", "작성", "검토", "보고", "확인", "진행", "관리", "시스템", "업무", "경우", "이후", "포함", "대한", "통해", "위한", "등",
    "블록명", "근거 문장", "위키 연결어", "우선순위", "출력 형식", "작성 지침", "주의", "예시", "규칙", "단계", "항목", "필드", "값",
    "핵심 논지", "핵심논지", "근거 및 데이터", "주요 인용", "핵심 주장", "개념용어", "상세 분해", "세부 분해", "주요 슬라이드", "슬라이드 목차", "실행 방안", "기대 효과",
    "검토 의견", "본문 내용", "문서 개요", "한다", "했다", "된다", "됐다", "있다", "없다", "하는", "되는", "있는", "없는",
    "확인한다", "살핀다", "울린다", "깨운다", "나선다", "살펴본다", "탑승했다", "달랜다", "이용해", "시작됐다", "만들고", "확산하라", "공급하라", "짜다", "집어넣어야",
    "part", "chapter", "section", "rainbow", "series", "driving", "salesman", "power", "skill", "the", "and", "for", "with", "that", "this", "from", "are", "have",
]
# Tags that a category brings, lengths of a tag, how often and where terms must occur, endings of words that are no tags.
OWN_TAGS = {"글로벌 어학 & 영어": ["영어학습", "영어회화"], "전자무역 & 비즈니스": ["전자무역"], "경영 & 전략 기획": ["경영전략"], "AI & 테크놀로지": ["AI"]}
STUDY = "글로벌 어학 & 영어"
SHORTEST, LONGEST, BOLD, OFTEN, HEAD, ENOUGH, MOST_TERMS = 2, 25, 2, 3, 4000, 4, 20
INFLECTED = re.compile("(?:한다|했다|이다|였다|있다|없다|하고|되고|하며|되며|은|는|이|가|을|를|에|의|로|으로)$")
CITE = r"\s*\[\d+(?:\s*[-,]\s*\d+)*\]"
STEM = [r"^(?:Sample|sample|샘플)[_\s-]*", r"^(?:스캔책|스캔|교재|자료)[_\s-]*", r"^\d{4,8}[-_]?", r"[-_]v?\d+(\.\d+)*$", "_소스분석$", "_정리본$"]
NO_SUMMARY = "문서 내용 요약 정보가 없습니다."

_stop = frozenset(NO_TAGS)
_cite = re.compile(CITE)


def strip_cite(c: Column) -> Column:
    """Without citation marks such as [1] or [3-5], and without the stop and blanks at its ends."""
    return X.strip(F.regexp_replace(X.strip(F.regexp_replace(X.text(c), f"(?U){CITE}", "")), r"\.+$", ""))


def file_title(name: Column) -> Column:
    """A file's name without its suffix and the marks of samples, scans, dates and versions; the bare name if nothing is left."""
    stem = F.regexp_replace(X.text(name), r"(?<=.)\.[^.]*$", "")
    out = stem
    for pattern in STEM:
        out = F.regexp_replace(out, f"(?U){pattern}", "")
    return F.coalesce(F.nullif(X.strip(out), F.lit("")), stem)


def title(c: Column, name: Column) -> Column:
    """The first heading or short plain line that names the document; else its file's title."""
    labels = "|".join(re.escape(x) for x in LABELS)
    lines = F.transform(F.split(X.text(c), "\r\n|\r|\n", -1), X.strip)
    bare = F.filter(lines, lambda x: x.startswith("#") | (F.length(x).between(2, 60) & ~x.rlike(r"^(?:[-*|>\[]|```|http|값)")))
    named = F.transform(bare, lambda x: strip_cite(F.regexp_replace(x, "^#+", "")))
    good = F.filter(named, lambda x: (F.length(x) > 2) & ~F.lower(x).rlike(f"^(?:{labels})") & ~x.rlike(r"(?i)^(?:PART|CHAPTER|SECTION|제\s*\d+\s*[장절편]|부록|페이지|슬라이드|시트)"))
    return F.coalesce(F.get(good, F.lit(0)), file_title(name))


def summary(c: Column, most: int = 220) -> Column:
    """What is marked as the summary, by the first of four marks; else the first two plain lines. At most `most` characters."""
    c = X.text(c)
    found = lambda pattern: F.nullif(X.strip(F.regexp_extract(c, pattern, 1)), F.lit(""))
    section = F.regexp_replace(found(r"(?ms)^#\s*한줄\s*요약\s*\n(.*?)(?=^#\s|\z)"), r"(?m)^\s*[-*]\s*", "")
    plain = F.filter(F.transform(X.lines(c), X.strip), lambda x: (x != "") & ~x.rlike(r"^(?:[#\-*|>\[]|```|http|값|ISBN|PART|CHAPTER|SECTION|부록|감사의)"))
    marks = [
        found(r"(?i)>\s*(?:📌|🎯)\s*\*\*(?:핵심\s*요약|Executive\s*Summary|AI[^\*:]*요약)[^\*:]*\*\*:?\s*(.+)"),
        F.nullif(X.strip(F.regexp_extract(section, r"\A[^\n]*", 0)), F.lit("")),
        found(r"\*\*한줄\s*요약\*\*\s*\n+>\s*(.+)"),
        found(r">\s*📌\s*(?:\*\*[^*]+(?::\*\*|\*\*:)\s*|\[[^\]\n]+\]:\s*)?([^\n]+)"),
        F.nullif(F.array_join(F.slice(plain, 1, 2), " "), F.lit("")),
    ]
    return F.coalesce(F.nullif(F.substring(strip_cite(F.coalesce(*marks)), 1, most), F.lit("")), F.lit(NO_SUMMARY))


def category(c: Column, name: Column, path: Column) -> Column:
    """Material for learning English first, then the first category of which path, name or the first 3,000 characters have a word."""
    study = X.study_material(c, F.concat_ws(" ", path, name))
    return F.when(study, STUDY).otherwise(X.category(c, F.concat_ws(" ", path, name)))


def entities(c: Column, most: int = 6) -> Column:
    """Companies, organisations, acronyms; the first `most` distinct ones that are no stop words, sorted."""
    return X.entities(c, most, NO_TAGS)


def _slug(term: str) -> str:
    """A term as a tag, or nothing if it can't be one."""
    term = _cite.sub("", term).strip().rstrip(".").strip()
    term = " ".join(re.sub(r"\(.*?\)", "", term).replace("/", " ").replace("·", " ").split())
    if not SHORTEST <= len(term) <= LONGEST or term in _stop or (len(term) <= 3 and INFLECTED.search(term)):
        return ""
    slug = re.sub("-{2,}", "-", re.sub(r"[^0-9A-Za-z가-힣_\-]", "", term.replace(" ", "-"))).strip("-")
    slug = X.SYNONYMS.get(slug.lower(), slug)
    return "" if slug in _stop else slug


def _frequent(terms: list[str], least: int) -> Iterator[str]:
    """Terms by falling count, those of one count by first place."""
    return (t for t, n in Counter(terms).most_common() if n >= least)


def _listed(text: str) -> list[str]:
    """The document's own list of key words."""
    m = re.search(r"연결\s*키워드[^\n]*\n([^\n]+)", text)
    if m:
        line = re.sub(r"^\*{0,2}\s*연결\s*키워드\s*\*{0,2}\s*[:：]\s*", "", re.sub(r"^[>\s*-]+", "", m[1].strip()).strip("[]"))
    else:
        m = re.search(r"\*\*키워드\*\*[:：]\s*([^\n]+)", text)
        line = m[1] if m else ""
    return [w.strip(" *`\"'") for w in re.split("[,，、]", line)]


def tags_of(text: str, title: str = "", category: str = "", study: bool = False, most: int = 10) -> list[str]:
    """Tags from the strongest source to the weakest: category, listed key words, bold terms, title, and frequent words if there are few."""
    own = [*(OWN_TAGS[STUDY] if study or category == STUDY else []), *(OWN_TAGS.get(category, []) if category != STUDY else [])]
    bold = _frequent([" ".join(re.sub(r"\(.*?\)", "", _cite.sub("", t).strip().rstrip(".").strip()).replace("/", " ").replace("·", " ").split()) for t in re.findall(r"\*\*(.+?)\*\*", text)], BOLD)
    seen: dict[str, str] = {}
    for term in [*own, *_listed(text), *bold, *re.findall("[가-힣A-Za-z0-9]{2,}", title)]:
        if slug := _slug(term):
            seen.setdefault(slug.lower(), slug)
    if len(seen) < ENOUGH:
        words = Counter(re.findall("[가-힣A-Za-z]{2,8}", text[:HEAD])).most_common(MOST_TERMS)
        for slug in (_slug(w) for w, n in words if n >= OFTEN):
            if len(seen) >= most:
                break
            if slug:
                seen.setdefault(slug.lower(), slug)
    return list(seen.values())[:most]


@F.pandas_udf(ArrayType(StringType()))
def _tags(text: pd.Series, title: pd.Series, category: pd.Series, study: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([tags_of(a, b, c, bool(d), int(n)) for a, b, c, d, n in zip(text, title, category, study, most)], dtype=object)


def tags(c: Column, title: Column, category: Column, study: Column | None = None, most: int = 10) -> Column:
    """At most `most` tags, distinct without regard to case; topics and key words are their first ones."""
    study = F.coalesce(study, F.lit(False)) if study is not None else F.lit(False)
    return _tags(X.text(c), X.text(title), X.text(category), study, F.lit(most))


# The same of one text, in plain Python, for whole documents in one call.
_labels = tuple(LABELS)
_no_title = re.compile(r"[-*|>\[]|```|http|값").match
_structural = re.compile(r"PART|CHAPTER|SECTION|제\s*\d+\s*[장절편]|부록|페이지|슬라이드|시트", re.IGNORECASE | re.ASCII).match
_not_plain = re.compile(r"[#\-*|>\[]|```|http|값|ISBN|PART|CHAPTER|SECTION|부록|감사의").match
_stem = [re.compile(p) for p in STEM]
_rest = "[^\n\r\x85\u2028\u2029]+"
_signed = re.compile(rf">\s*(?:📌|🎯)\s*\*\*(?:핵심\s*요약|Executive\s*Summary|AI[^*:]*요약)[^*:]*\*\*:?\s*({_rest})", re.IGNORECASE | re.ASCII)
_section = re.compile(r"^#\s*한줄\s*요약\s*\n(.*?)(?=^#\s|\Z)", re.MULTILINE | re.DOTALL | re.ASCII)
_bullet = re.compile(r"^\s*[-*]\s*", re.MULTILINE | re.ASCII)
_one_line = re.compile(rf"\*\*한줄\s*요약\*\*\s*\n+>\s*({_rest})", re.ASCII)
_pinned = re.compile(r">\s*📌\s*(?:\*\*[^*]+(?::\*\*|\*\*:)\s*|\[[^\]\n]+\]:\s*)?([^\n]+)", re.ASCII)
_study = re.compile(rf"\b(?:{X.STUDY_PATTERN})\b").search
_companies = re.compile(r"(?:주식회사\s+|㈜|\(주\))([가-힣A-Za-z0-9]+)", re.ASCII)
_suffixes = ["위원회", "공사", "진흥원", "협회", "재단", "연구원", "은행", "대학", "본부", "센터"]
_words = re.compile("[가-힣A-Za-z0-9]{3,}")
_acronyms = re.compile("[A-Z]{2,}(?:[-_][A-Z0-9]+)*")
_not_latin = bytes(x for x in range(256) if not chr(x).isalpha() or x > 127)


def strip_cite_of(text: str) -> str:
    text = prose.strip(text)
    return prose.strip(prose.strip(_cite.sub("", text) if "[" in text else text).rstrip("."))


def file_title_of(name: str) -> str:
    out = stem = re.sub(r"(?<=.)\.[^.]*$", "", name)
    for p in _stem:
        out = p.sub("", out)
    return prose.strip(out) or stem


def title_of(text: str, name: str) -> str:
    for line in re.split("\r\n|\r|\n", text) if "\r" in text else text.split("\n"):
        x = prose.strip(line)
        if x.startswith("#") or (2 <= len(x) <= 60 and not _no_title(x)):
            x = strip_cite_of(x.lstrip("#"))
            if len(x) > 2 and not x.lower().startswith(_labels) and not _structural(x):
                return x
    return file_title_of(name)


def _marked_summaries(text: str) -> Iterator[str]:
    """What is marked as the summary, then the first two plain lines."""
    found = lambda p: prose.strip(m[1]) if (m := p.search(text)) else ""
    pin = "📌" in text
    if pin or "🎯" in text:
        yield found(_signed)
    if "한줄" in text:
        yield prose.strip(_bullet.sub("", found(_section)).partition("\n")[0])
        yield found(_one_line)
    if pin:
        yield found(_pinned)
    plain = (x for x in map(prose.strip, text.split("\n")) if x and not _not_plain(x))
    yield " ".join(islice(plain, 2))


def summary_of(text: str, most: int = 220) -> str:
    return strip_cite_of(next(filter(None, _marked_summaries(text)), ""))[:most] or NO_SUMMARY


def study_of(text: str, name: str) -> bool:
    name, head = name.lower(), text[:3000].lower()
    has = lambda words: any(w in name for w in words)
    tech = has(X.TECH_WORDS)
    if tech and not has(X.STUDY_TITLES):
        return False
    return has(X.STUDY_WORDS) or bool(_study(name)) or (not tech and sum(w in head for w in X.STUDY_CUES) >= 2)


def category_of(text: str, name: str, path: str) -> str:
    both = f"{path} {name}"
    if study_of(text, both):
        return STUDY
    x = f"{both} {text[:3000]}".lower()
    return next((label for label, words in X.CATEGORIES if any(w in x for w in words)), X.DEFAULT_CATEGORY)


def language_of(text: str) -> str:
    latin = len(text.encode("utf-8", "surrogatepass").translate(None, _not_latin))
    ko = 0 if text.isascii() else sum(map(len, re.findall("[가-힣]+", text)))
    share = ko / (ko + latin) if ko + latin else 1.0
    return "ko" if share > 0.7 else "en" if share < 0.2 else "mixed"


def _names(text: str) -> Iterator[str]:
    """Companies, organisations, acronyms; an organisation's name ends where its word has a suffix last."""
    if "주식회사" in text or "㈜" in text or "(주)" in text:
        yield from _companies.findall(text)
    if any(x in text for x in _suffixes):
        for word in _words.findall(text):
            at, n = max((word.rfind(x, 1), len(x)) for x in _suffixes)
            if at > 0:
                yield word[: at + n]
    yield from (m[0] for m in _acronyms.finditer(text))


def entities_of(text: str, most: int = 6) -> list[str]:
    found: dict[str, None] = {}
    for name in _names(text):
        if len(found) == most:
            break
        if len(name) >= 2 and name not in _stop:
            found[name] = None
    return sorted(found)
