"""Sinks. Everything stays distributed, except where one sorted file is the feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.operators.corpus import contiguous_parts


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """Nested columns are written as JSON. mark: each file begins with a byte-order mark, which is put before its first header."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    out = df.select(*(F.to_json(c).alias(c) if c in nested else c for c in df.columns))
    out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0]) if mark else out
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_dictionary(words: DataFrame, path: str) -> None:
    """One word a line, sorted over all files."""
    words.select("word").distinct().orderBy("word").write.mode("overwrite").text(path)


def write_by_label(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("label").parquet(path)


def write_parts(df: DataFrame, path: str, parts: int, order: str) -> None:
    contiguous_parts(df, parts, order).write.mode("overwrite").partitionBy("part").parquet(path)
