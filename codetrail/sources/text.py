"""Text normalisation of landed command output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Remove every carriage return from the given text columns."""
    for c in cols:
        df = df.withColumn(c, F.translate(F.col(c), "\r", ""))
    return df
