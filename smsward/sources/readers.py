"""Sources: message exports, dictionaries, whitelists; all lazy DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smsward.functions.text import strip_diacritics

MESSAGE = T.StructType([T.StructField("content", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("has_url", T.IntegerType()), T.StructField("has_phone_number", T.IntegerType()), T.StructField("sender_type", T.StringType())])
RAW_EXPORT = T.StructType([T.StructField(c, T.StringType()) for c in ("Content", "Sender", "Type")])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = MESSAGE) -> DataFrame:
    """Well-formed CSV with a header; quoted messages may span lines."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def load(spark: SparkSession, path: str | list[str], tail: int = 4, standard_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """Messages and rejects of files: read as well-formed CSV where all of it is, else line by line. A missing path is Spark's own error."""
    if standard_first:
        header = spark.read.schema("value string").text(path).filter(F.regexp_replace("value", "^\ufeff", "").startswith(f"{MESSAGE.names[0]},"))
        checked = spark.read.schema(T.StructType([*MESSAGE.fields, T.StructField("_bad", T.StringType())])).csv(path, header=True, multiLine=True, quote='"', escape='"', columnNameOfCorruptRecord="_bad")
        if header.limit(1).count() and not checked.cache().filter("_bad IS NOT NULL").limit(1).count():
            checked.unpersist()
            return read_csv(spark, path), spark.createDataFrame([], "value string")
        checked.unpersist()
    return read_malformed(spark, path, tail)


def load_many(spark: SparkSession, paths: list[str], **how) -> DataFrame:
    """Messages of several files, each read as load() does, with _source_file."""
    return union_all([load(spark, p, **how)[0].withColumn("_source_file", F.lit(p.rstrip("/").rsplit("/", 1)[-1])) for p in paths])


def strict_label(label: Column) -> Column:
    """The label as an integer; a null or another text is an error, as Spark's own cast is."""
    return F.when(label.isNull(), F.raise_error(F.lit("a label is missing"))).otherwise(label.cast("int"))


def parse_malformed(lines: DataFrame, tail: int = 4, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects of text lines (column value): the last `tail` commas split, so a message may hold commas and quotes."""
    names = names or MESSAGE.names
    body = lines.withColumn("value", F.trim(F.regexp_replace("value", "^﻿", ""))).filter("value <> ''")
    pattern = "^(.*)" + ",([^,]*)" * tail + "$"
    good = body.filter(F.col("value").rlike(f"(?s){pattern}"))
    parts = [F.trim(F.regexp_extract("value", f"(?s){pattern}", i + 1)) for i in range(tail + 1)]
    text = F.translate(F.regexp_replace(parts[0], r'(?s)^"(.*)"$', "$1"), '"', "'")
    return good.select(text.alias(names[0]), *(p.alias(n) for p, n in zip(parts[1:], names[1:], strict=True))), body.filter(~F.col("value").rlike(f"(?s){pattern}"))


def read_malformed(spark: SparkSession, path: str | list[str], tail: int = 4) -> tuple[DataFrame, DataFrame]:
    """As parse_malformed, without the header line; labels and flags are integers, null where they aren't numbers."""
    rows, bad = parse_malformed(spark.read.text(path), tail)
    rows = rows.filter(~((F.col("content") == "content") & (F.col("label") == "label")))
    return rows.select(*(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in MESSAGE)), bad


def read_many(spark: SparkSession, paths: list[str], schema: T.StructType = MESSAGE) -> DataFrame:
    """Union of files, with _source_file (base name)."""
    return read_csv(spark, paths, schema).select("*", F.col("_metadata.file_name").alias("_source_file"))


def read_folder(spark: SparkSession, folder: str, schema: T.StructType = RAW_EXPORT, exclude: str | None = None) -> DataFrame:
    """All *.csv of a folder but the excluded name; a byte-order mark is ignored."""
    df = spark.read.schema(schema).csv(folder, header=True, multiLine=True, quote='"', escape='"', pathGlobFilter="*.csv", enforceSchema=True)
    df = df.select("*", F.col("_metadata.file_name").alias("_file"))
    return (df.filter(F.col("_file") != exclude) if exclude else df).drop("_file")


def dictionary_words(lines: DataFrame) -> DataFrame:
    """Distinct words (column word) of lines (column value): the text of JSON objects, other lines as they are."""
    line = F.trim("value")
    as_json = F.get_json_object(line, "$.text")
    is_object = F.try_parse_json(line).isNotNull() & line.startswith("{")
    word = F.lower(F.trim(F.when(is_object, as_json).otherwise(line)))
    return lines.filter(line != "").select(word.alias("word")).filter("word IS NOT NULL AND word <> ''").distinct()


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Full and shadow (no diacritics) word tables."""
    full = dictionary_words(spark.read.text(path))
    return full, full.select(strip_diacritics(F.col("word")).alias("word")).distinct()


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    line = F.lower(F.trim("value"))
    return spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(line.alias("token")).distinct()


def public_suffixes(lines: DataFrame) -> tuple[str, ...]:
    """Suffixes of a public-suffix list (column value): one a line, comments and blank lines apart. Wildcards and exceptions
    are left out. The list reaches the driver: it has some thousand lines."""
    line = F.lower(F.trim("value"))
    return tuple(sorted(r[0] for r in lines.filter((line != "") & ~line.startswith("//") & ~line.startswith("!") & ~line.startswith("*")).select(line).distinct().collect()))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def null_as_text(content: Column) -> Column:
    """Nulls as the literal text that a stringifying loader makes of them."""
    return F.coalesce(content, F.lit("nan"))
