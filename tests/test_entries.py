"""Stacks of numbers at the ends of lines against the pattern as it reads."""

import random
import re
import time

from quillspark.functions import entries as E


def test_number_tails_are_those_of_the_plain_pattern():
    plain, pick = re.compile(r"(.*?[가-힣A-Za-z.,!?”\"’')][^\d]*?)((?:\s+\d{2,4})+)\s*"), random.Random(3)
    for _ in range(20000):
        s = "".join(pick.choices(["a", "가", ".", " ", "\t", "1", "12", "123", "-", "٣", "12345", " 45", " 46"], k=pick.randint(0, 9)))
        m, at = plain.fullmatch(s), E._tail(s)
        assert (s[:at], s[at:].split()) == ((m[1], m[2].split()) if m else (s, [])), s


def test_long_lines_take_no_square_of_their_length():
    text, start = "\n".join(["a line of words without an end " * 400] * 3 + ["긴 문장이다 " + "12 13 14 " * 2000 + "x"]), time.process_time()
    assert E.unstacked(text) == (text, 0)
    assert time.process_time() - start < 2
