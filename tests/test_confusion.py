"""Digits and letters misread for each other, where matches overlap."""

from quillspark.functions import text as X


def test_overlapping_matches_and_texts_own_digits(spark):
    rows = spark.createDataFrame([("d1f1f shouId",), ("YXC3B4FS 4G4",), ("1l2l3",)], "text string")
    assert [r[0] for r in rows.select(X.confusion(rows.text)).collect()] == ["dlflf should", "YXC384FS 464", "11213"]
