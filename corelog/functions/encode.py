"""Encodings of columns as features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    """df with the column, a constant where it is missing."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def finite(*columns: str) -> Column:
    """Whether no column is NULL, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    return out


def one_hot(code: Column, width: int) -> Column:
    """Array of `width` zeros and a one at the code held in range; NULL is the last place."""
    c = F.least(F.lit(width - 1), F.greatest(F.lit(0), F.coalesce(code, F.lit(width - 1))))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == c).cast("int"))


def keyword_flags(text: Column, words: list[str]) -> list[Column]:
    """kw_<word>: 1 where the text holds the word anywhere."""
    return [text.contains(w).cast("int").alias(f"kw_{w}") for w in words]


def fill_flag(name: str, value) -> list[Column]:
    """The column with NULL replaced, and has_<column>."""
    return [F.coalesce(name, F.lit(value)).alias(name), F.col(name).isNotNull().alias(f"has_{name}")]
