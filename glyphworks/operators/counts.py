"""Seven counts of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphworks.functions import text as T
from glyphworks.functions.kernels import grapheme_clusters


def native_counts(text: str = "text") -> list[Column]:
    """All but the clusters, in the JVM."""
    c = F.col(text)
    return [
        T.utf8_bytes(c).alias("utf8_bytes"), T.code_points(c).alias("unicode_code_points"), T.code_points(c).alias("unicode_scalars"),
        T.word_count(c).alias("words"), T.line_count(c).alias("lines"), T.utf16_units(c).alias("javascript_string_units"),
    ]


def counts(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return df.select(key, *native_counts(text), grapheme_clusters(F.col(text)).alias("grapheme_clusters"))


def rollup(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Sums of the native counts over groups; partial sums are made before the shuffle."""
    c = df.select(*by, *native_counts(text))
    return c.groupBy(*by).agg(F.count("*").alias("texts"), *[F.sum(k).alias(k) for k in c.columns if k not in by])
