"""Corpus building: dedupe, flags, placeholders, splits, annotation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smsward import constants as K
from smsward.functions.text import any_of, classify_sender, has_phone_number, has_url


def keep_first(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first row, by order, of each value (nulls are a value): an aggregate, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in (column, order)]
    first = df.groupBy(column).agg(F.min_by(F.struct(order, *rest), order).alias("r"))
    return first.select(column, "r.*").select(*df.columns)


def duplicate_counts(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(column).alias("n_distinct"), (F.count("*") - F.countDistinct(column)).alias("n_duplicates"))


def value_counts(df: DataFrame, column: str, least: int = 1) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of equal rows; nulls are equal."""
    return df.groupBy(*columns).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_duplicates"))


def null_profile(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in df.columns), F.count("*").alias("n_rows"))


def structure_export(raw: DataFrame, order: str) -> DataFrame:
    """Messages of a phone export: deduplicated first, then only those received."""
    own = keep_first(raw, "Content", order).filter("Type = 'Received'")
    text = F.translate("Content", "\n", " ")
    return own.select(order, text.alias("content"), F.lit(None).cast("int").alias("label"), has_url(text).alias("has_url"), has_phone_number(text).alias("has_phone_number"), classify_sender(F.col("Sender")).alias("sender_type"))


def has_placeholder(text: Column) -> Column:
    return F.coalesce(text.rlike(any_of(K.PLACEHOLDERS)), F.lit(False))


SMALL = 64 << 20


def map_values(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Exact values replaced by mapping (old, new; old is distinct); others pass through. A mapping of up to SMALL bytes goes to the rows; a larger
    one meets them by shuffle, where Spark's skew handling splits frequent values."""
    size = mapping.agg(F.sum(F.octet_length("old") + F.coalesce(F.octet_length("new"), F.lit(0)) + 32)).first()[0] or 0
    pairs = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    met = df.join(F.broadcast(pairs) if size <= SMALL else pairs, F.col("_old") == F.col(column), "left")
    return met.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def row_numbers(df: DataFrame, order: str, name: str = "rn") -> DataFrame:
    """Numbers from 1 in the order of a column: rows are counted by range, ranges are summed, so no task sees all rows."""
    spark = df.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / ranges) for i in range(1, ranges)])).alias("c")).first().c or []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    ranged = df.withColumn("_r", place)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_r").orderBy(order))
    return ranged.withColumn("_own", own).join(F.broadcast(sizes), "_r").withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)


def contiguous_parts(df: DataFrame, parts: int, order: str) -> DataFrame:
    """Equal contiguous parts from 0; the last takes the remainder."""
    each = max(1, df.count() // parts)
    return row_numbers(df, order).withColumn("part", F.least(F.floor((F.col("rn") - 1) / each), F.lit(parts - 1)).cast("long")).drop("rn")


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last entry of an append-only log for each key."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*").select(*log.columns)


def progress(df: DataFrame, label: str = "label") -> DataFrame:
    done = F.count(label)
    return df.agg(F.count("*").alias("total"), done.alias("labelled"), (F.count("*") - done).alias("unlabelled"), F.round(F.when(F.count("*") > 0, 100.0 * done / F.count("*")).otherwise(0.0), 6).alias("percent"))
