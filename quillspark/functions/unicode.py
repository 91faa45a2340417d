"""What Spark has no built-in for: NFKC, encoding detection."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    return _nfkc(c)  # c stands once: what a Python function reads of an expression twice is evaluated twice


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    return _nfc(c)


def decode(raw: bytes | None) -> tuple[str, str]:
    """Encoding and text: byte-order marks, then UTF-8, then what charset-normalizer finds, then CP949."""
    raw = raw or b""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return name, raw.decode(name, "replace")
    try:
        return "utf-8", raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes
    except ImportError:  # without the detector, CP949 comes next
        return "cp949", raw.decode("cp949", "replace")
    best = from_bytes(raw).best()
    name = best.encoding if best else "cp949"
    return name, raw.decode(name, "replace")
