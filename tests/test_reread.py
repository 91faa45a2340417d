"""Second readings: matching blocks against difflib."""

import random
import time
from difflib import SequenceMatcher

from quillspark.functions import reread as R


def test_blocks_are_those_of_difflib():
    pick = random.Random(1)
    for t in range(900):
        letters = ("a", "ab", "abcdef ")[t % 3]
        a, b = ("".join(pick.choices(letters, k=pick.randint(0, 50))) for _ in range(2))
        b = b if t % 2 else "".join(pick.choice(letters) if pick.random() < 0.1 else c for c in a)
        assert R.Matched(a, b).get_opcodes() == SequenceMatcher(None, a, b, autojunk=False).get_opcodes(), (a, b)


def test_a_long_broken_line_takes_no_square_of_its_length():
    reading = " ".join(random.Random(2).choices("the and of ing reading water hand station".split(), k=1500))
    line, start = reading.translate(str.maketrans("aeo", "ଁంഃ")), time.process_time()
    assert R.merged(line, reading) == (reading, True)
    assert time.process_time() - start < 3


def test_of_several_readings_the_best_counts(spark):
    rows = [(1, "ଁbcd efgh", x) for x in ("abcd efgh", "zzzz", "abcd efgX", None)] + [(1, "", "x"), (2, "ଁbcd", None)]
    found = R.fixes(spark.createDataFrame(rows, "doc int, line string, reading string")).orderBy("doc").collect()
    assert [tuple(r) for r in found] == [(1, "ଁbcd efgh", "abcd efgh", True), (2, "ଁbcd", "bcd", False)]
