"""Sending this package to executors that don't have it on their path; long chains cut into plans of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once, unless PYTHONPATH already has them."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_quillspark", False):
        return
    path = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "quillspark").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._quillspark = True


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once, as a plan that starts at them.

    A plan is a tree, so each rule that looks at its input several times multiplies what stands before it, and persist() keeps
    that tree. Rows go to the checkpoint folder if there is one, else they stay with the executors.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()
