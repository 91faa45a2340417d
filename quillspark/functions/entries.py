"""Books of numbered entries: the longest chain of rising entry numbers in a text, its paragraphs, numbers read apart from their entries."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from quillspark.functions.roles import encoded, having

# An entry number, how far two neighbours may be apart, how many numbers back one is sought, the least chain.
NUMBER = re.compile(r"(?<![\w(\-:.,/])(\d{1,4})(?![\w%)\-:.,/~])")
GAP, BACK, LEAST = 4, 400, 30
# Page numbers left among entries, and how far below the entry before they are; a short title before an entry.
LONE_NUMBER = re.compile(r"(?m)(?<=[^\d\s]\n)[ \t]*(\d{1,3})[ \t]*(?=\n\s*\n|\Z)")
PAGE_SHARE = 0.6
GLUED_NUMBER = re.compile(r"(^|\n)[^\S\n]*[•·|I]?\s*\d{1,3}[^\S\n]+$")
TITLE = re.compile(r"\n(?:\d{1,3}\s+)?([가-힣][가-힣 ]{0,11})\n?$")
# Lines of stacked numbers and what surrounds them; how far their entries may be, and a stack from the number before it.
NUMBER_LINE = re.compile(r"\s*(?:\d{1,3}\s+)?(\d{1,4})\s*")
#: A line read backwards: its numbers, and after them letters or marks of a sentence before any other digit. Nothing is tried twice.
NUMBER_TAIL = re.compile(r"\s*+(?:\d{2,4}+\s++)++(?=[^\d]*?[가-힣A-Za-z.,!?”\"’')])")
MIXED = re.compile(r"([A-Za-z‘'\"].*?[A-Za-z.,!?’'\"])\s+([“\"'‘]?[가-힣]{2,}.*)")
SENTENCE_END = re.compile(r"(?:[.!?”\"’')\]]|[다요죠까니])\s*$")
GOES_ON = re.compile(
    "(?:며|으며|니|으니|지만|면서|도록|거나|는데|은데|으면|는|은|을|를|에|의|에서|에게|으로|로|었다|았다|였다|했다|한다|된다|합니다|입니다|습니다|니다|리는|하는|이다)(?![가-힣])"
)
PART_TITLE = re.compile(r"(?:P ?A ?R ?T|PA.T|P.RT|part|CHAPTER|Chapter)\s?\d")
REACH, NEAR, SENTENCE = 40, 5, 20


def chain(text: str) -> list[tuple[int, int]]:
    """(place, number) of the longest chain whose steps are 1 to GAP; of equal ones, that which ends first.

    Only the latest BACK numbers can precede one. Each value keeps its places by length, so a number looks at GAP values
    instead of at all numbers before it.
    """
    found = [(m.start(), int(m[1])) for m in NUMBER.finditer(text)]
    length, before = [1] * len(found), [-1] * len(found)
    recent: dict[int, list[int]] = {}
    for j, (_, v) in enumerate(found):
        options = []
        for u in range(v - GAP, v):
            places = recent.get(u, [])
            while places and places[0] < j - BACK:
                places.pop(0)
            options += places
        if options:
            at = min(options, key=lambda i: (-length[i], i))
            length[j], before[j] = length[at] + 1, at
        recent.setdefault(v, []).append(j)
    out, k = [], max(range(len(found)), key=lambda i: (length[i], -i), default=-1)
    while k >= 0:
        out.append(found[k])
        k = before[k]
    return out[::-1]


@F.pandas_udf(IntegerType())
def chain_length(text: pd.Series) -> pd.Series:
    """Entries of the longest chain; null text has none."""
    return text.fillna("").map(lambda t: len(chain(t))).astype("int32")


def numbered_book(text: Column) -> Column:
    return chain_length(text) >= LEAST


def paragraphs(text: str) -> str:
    """A numbered book with a blank line before each entry, without page numbers left between entries; other texts unchanged."""
    links = chain(text)
    if len(links) < LEAST:
        return text
    at, in_chain = [p for p, _ in links], dict(links)

    def page_number(m: re.Match) -> str:
        k = bisect_left(at, m.start(1))
        below = k > 0 and int(m[1]) <= PAGE_SHARE * links[k - 1][1]
        return "" if below and m.start(1) not in in_chain else m[0]

    text = LONE_NUMBER.sub(page_number, text)
    starts = [p for p, _ in chain(text)]
    out = []
    for a, b in zip([0, *starts], starts):
        piece = GLUED_NUMBER.sub(r"\1", text[a:b]).rstrip(" \t")
        title = TITLE.search(piece)
        if title and piece[: title.start()].strip():
            out += [piece[: title.start()], "\n\n", title[1], "\n"]
        else:
            out += [piece, "\n\n"]
    text = "".join(out) + text[starts[-1] :]
    return re.sub("\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).lstrip("\n")


def _number(line: str) -> str | None:
    m = NUMBER_LINE.fullmatch(line)
    return m and m[1]


def _tail(line: str) -> int:
    """Where the numbers at the end of a sentence begin, or the line's end."""
    m = NUMBER_TAIL.match(line[::-1])
    return len(line) - (m.end() if m else 0)


def _lines(text: str) -> list[str]:
    """Lines; numbers at the end of a sentence that a stack goes on from, and Hangul after a Latin sentence, as lines of their own."""
    lines, out = text.split("\n"), []
    for line, after in zip(lines, [*lines[1:], ""]):
        at, mixed = _tail(line), MIXED.fullmatch(line)
        found = line[at:].split()
        rising = all(int(b) - int(a) == 1 for a, b in zip(found, found[1:]))
        goes_on = bool(found) and int(_number(after) or -1) == int(found[-1]) + 1
        if rising and (goes_on or (len(found) > 1 and min(map(len, found)) > 2)):
            out += [line[:at].rstrip(), *found]
        elif mixed and len(re.findall("[가-힣]", mixed[2])) >= 6 and len(re.findall("[A-Za-z]{2,}", mixed[1])) >= 3:
            out += mixed.groups()
        else:
            out.append(line)
    return out


#: What a line can be to a stack: a number alone, an entry that has its number.
ALONE, NUMBERED = 1, 2
_run = re.compile("(?P<run>{n}+)(?P<block>{o}{{0,{k}}})".format(n=having(ALONE, width=2), o=having(0, ALONE | NUMBERED, width=2), k=REACH))
_opening, _latin_sentence = re.compile("[“\"'‘(]?[가-힣]"), re.compile(r"\s*[A-Z][a-z]")


def _openers(lines: list[str]) -> list[bool]:
    """Which lines of Hangul open an entry: long ones, and those that a Latin sentence follows."""
    bare = [x.strip() for x in lines]
    return [bool(_opening.match(x)) and (len(x) > 12 or bool(_latin_sentence.match(y))) for x, y in zip(bare, [*lines[1:], ""])]


def _ends_inside(before: list[str]) -> bool:
    """Text ends inside a sentence; a Latin line at its end gives way to the one before it."""
    solid = [x.strip() for x in before[-3:] if x.strip()]
    last = next((x for k, x in enumerate(reversed(solid)) if re.search("[가-힣]", x) or k or len(solid) == 1), "")
    return len(last) >= SENTENCE and not PART_TITLE.match(last) and not SENTENCE_END.search(last)


def _owners(block: list[str], n: int, before: list[str], missed: int) -> list[int]:
    """Which lines of a block its stack of n numbers belongs to; `missed`: entries between the number before the stack and its first."""
    heads = [i for i, opens in enumerate(_openers(block)) if opens]
    tail = heads and (GOES_ON.match(block[heads[0]].strip()) or (not heads[0] and len(heads) > n and _ends_inside(before)))
    heads = heads[1:] if tail else heads
    return heads[max(0, min(missed, len(heads) - n)) :][:n]


def unstacked(text: str) -> tuple[str, int]:
    """Numbers read as a stack before their entries put at the entries' heads, and how many; those left over stay after them."""
    lines = _lines(text)
    numbers = [_number(x) for x in lines]
    roles = encoded(ALONE * bool(n) | NUMBERED * bool(re.match(r"\s*\d{2,4}\s+\S", x)) for n, x in zip(numbers, lines))
    out, moved, last, at = [], 0, None, 0
    for m in _run.finditer(roles):
        first, z = m.span("run")
        a = next((k for k in range(z - 1, first, -1) if int(numbers[k]) - int(numbers[k - 1]) != 1), first)  # the stack: the rising end of the run
        if z - a < 2:
            continue
        plain, stack = lines[at:a], numbers[a:z]
        out += plain
        last = next((int(h[1]) for x in reversed(plain) if (h := re.match(r"\s*(\d{1,4})(?=\s|$)", x))), last)
        # the block ends at a blank line once there are more than enough entries
        opened, end = 0, z
        for opens in _openers(lines[z : m.end() + 1])[: m.end() - z]:
            if not lines[end].strip() and opened > len(stack):
                break
            opened, end = opened + opens, end + 1
        while end > z and not lines[end - 1].strip():
            end -= 1
        block, low = lines[z:end], int(stack[0])
        owners = _owners(block, len(stack), out, low - last - 1 if last is not None and 0 < low - last <= NEAR else 0)
        given = dict(zip(owners, stack))
        out += [f"{given[k]} {x.lstrip()}" if k in given else x for k, x in enumerate(block)] + stack[len(given) :]
        moved, last, at = moved + len(given), int(stack[-1]), end
    return "\n".join(out + lines[at:]), moved


@F.pandas_udf(StringType())
def _entry_paragraphs(text: pd.Series) -> pd.Series:
    return text.map(lambda t: paragraphs(unstacked(t)[0]) if len(chain(t)) >= LEAST else t, na_action="ignore")


def entry_paragraphs(c: Column) -> Column:
    """Numbered books with numbers at their entries and a paragraph for each; other texts unchanged, null as empty."""
    c = F.coalesce(c, F.lit(""))
    return F.coalesce(_entry_paragraphs(F.when(F.regexp_count(c, F.lit("[0-9]")) >= LEAST, c)), c)
