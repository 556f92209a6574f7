"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsward import constants as K


def group_means(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*(F.round(F.avg(c), 6).alias(c) for c in columns))


def mean_ratio(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Mean of label 1 over mean of label 0 for each column; null where the latter is 0."""
    one = [F.avg(F.when(F.col(label) == 1, F.col(c))) / F.nullif(F.avg(F.when(F.col(label) == 0, F.col(c))), F.lit(0)) for c in columns]
    wide = df.agg(*(F.round(x, 6).alias(c) for x, c in zip(one, columns, strict=True)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("ratio")) for c in columns))).alias("r")).select("r.*")


def ratio_of_sums(df: DataFrame, label: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Of each label, the sum of each pair's first column over the sum of its second; null where that is 0."""
    return df.groupBy(label).agg(F.count("*").alias("n"), *(F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 6).alias(f"{a}_per_{b}") for a, b in pairs))


def any_count(columns: list[str]) -> Column:
    """Whether any of the counts is over 0."""
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) > 0


def correlations(df: DataFrame, columns: list[str], others: list[str] | None = None) -> DataFrame:
    """Pearson correlation of each column with each of the others (all, if none are given), in one aggregate; null where a column is constant."""
    others = others if others is not None else columns
    x = {c: F.col(c).cast("double") for c in [*columns, *others]}
    pairs = [(a, b) for a in columns for b in others]
    parts = [F.covar_pop(x[a], x[b]).alias(f"{a}|{b}") for a, b in pairs] + [F.stddev_pop(x[c]).alias(f"{c}|") for c in x]
    r = lambda a, b: F.round(F.col(f"`{a}|{b}`") / F.nullif(F.col(f"`{a}|`") * F.col(f"`{b}|`"), F.lit(0.0)), 6)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in pairs]
    return df.agg(*parts).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def term_frequency(df: DataFrame, label: str, words: Column) -> DataFrame:
    return df.select(label, F.explode(words).alias("word")).groupBy(label, "word").agg(F.count("*").alias("n"))


def distinctive(df: DataFrame, label: str, words: Column, least: int = 10) -> DataFrame:
    """Words of label 1 by their rate a message against label 0's; infinite where label 0 lacks them."""
    counts = df.select(label, F.explode(words).alias("word")).groupBy("word").agg(F.count(F.when(F.col(label) == 1, 1)).alias("spam_count"), F.count(F.when(F.col(label) == 0, 1)).alias("ham_count"))
    totals = df.agg(F.count(F.when(F.col(label) == 1, 1)).alias("_s"), F.count(F.when(F.col(label) == 0, 1)).alias("_h"))
    rate = (F.col("spam_count") / F.col("_s")) / (F.col("ham_count") / F.col("_h"))
    found = counts.filter(F.col("spam_count") >= least).join(F.broadcast(totals))  # one row
    return found.select("word", "spam_count", "ham_count", F.when(F.col("ham_count") > 0, F.round(rate, 6)).otherwise(F.lit(float("inf"))).alias("ratio"))


def most_distinctive(df: DataFrame, label: str, words: Column, most: int = 50, least: int = 10) -> DataFrame:
    """The first `most` words by ratio, infinite ones first, then by count and word."""
    return distinctive(df, label, words, least).orderBy(F.desc("ratio"), F.desc("spam_count"), "word").limit(most)


def frequent_keywords(counts: DataFrame, wanted: dict[str, tuple[str, ...]] = K.THEMES, least: int = 6) -> DataFrame:
    """theme, word, n of the themes' words that occur `least` times or more; counts: word, n."""
    pairs = counts.sparkSession.createDataFrame([(theme, w) for theme, ws in wanted.items() for w in ws], "theme string, word string")
    return pairs.distinct().join(counts.groupBy("word").agg(F.sum("n").alias("n")), "word").filter(F.col("n") >= least).select("theme", "word", "n")


def with_letters(words: Column) -> Column:
    """The words that hold a letter."""
    return F.filter(words, lambda w: w.rlike(r"\p{L}"))


def compounds(words: Column, known: list[str]) -> Column:
    """Words in which two neighbours that make a known compound ("a b") become one, from left to right."""
    if not known:
        return words
    together = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
    fits = lambda i: F.coalesce(together(i).isin(known), F.lit(False))
    # one pass over places: the state is the words so far and whether the present one was taken by the one before
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("taken"))

    def step(state: Column, i: Column) -> Column:
        whole = F.when(fits(i), together(i)).otherwise(F.get(words, i))
        return F.when(state["taken"], F.struct(state["out"].alias("out"), F.lit(False).alias("taken"))).otherwise(F.struct(F.concat(state["out"], F.array(whole)).alias("out"), fits(i).alias("taken")))

    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)["out"]


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column: its type, how many values it has and lacks, and least and greatest as text."""
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count(c).alias("present"), (F.count("*") - F.count(c)).alias("missing"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in columns]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def themes(counts: DataFrame, wanted: dict[str, tuple[str, ...]] = K.THEMES) -> DataFrame:
    """Total occurrences of each theme's words; counts: word, n."""
    rows = [(theme, w) for theme, ws in wanted.items() for w in ws]
    pairs = counts.sparkSession.createDataFrame(rows, "theme string, word string")
    return pairs.join(counts.groupBy("word").agg(F.sum("n").alias("n")), "word", "left").groupBy("theme").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = lambda c: F.struct(F.lit(c).alias("feature"), F.sum(c).cast("double").alias("total"), F.round(F.avg(c), 6).alias("mean"), F.max(c).cast("double").alias("top"), F.round(F.avg((F.col(c) > 0).cast("int")), 6).alias("share"))
    return df.agg(F.array(*(cells(c) for c in columns)).alias("a")).select(F.explode("a").alias("r")).select("r.*")
