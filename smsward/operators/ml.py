"""Training, tuning and metrics: models of `trees` on features and the sender's type, splits, and exact figures of scores."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smsward import constants as K
from smsward.operators import trees as T
from smsward.scratch import written


def bucket(key: str, seed: str = "42") -> Column:
    """A portable pseudo-random place in [0, 1) of a row, by its key."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def ranked(df: DataFrame, key: str, label: str) -> DataFrame:
    """df with _rank (from 1, by bucket, then key) and _n (rows) within its label. Buckets are even, so ranges of them are the tasks' work,
    and the rows before each range come from a table of a row a range and label."""
    spark = df.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.withColumn("_b", bucket(key)).withColumn("_r", F.coalesce(F.floor(F.col("_b") * ranges), F.lit(-1)))
    sizes = placed.groupBy(label, "_r").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(label)
    before = F.sum("_c").over(whole.orderBy("_r")) - F.col("_c")
    sizes = sizes.select(F.col(label).alias("_l"), F.col("_r").alias("_q"), before.alias("_before"), F.sum("_c").over(whole).alias("_n"))
    own = F.row_number().over(Window.partitionBy(label, "_r").orderBy("_b", key))
    met = placed.withColumn("_own", own).join(sizes, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_r") == F.col("_q")))
    return met.withColumn("_rank", F.col("_before") + F.col("_own")).select(*df.columns, "_rank", "_n")


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2) -> DataFrame:
    """df with is_test: within each label, the share of rows that comes first by bucket."""
    return ranked(df, key, label).withColumn("is_test", F.col("_rank") <= F.round(F.col("_n") * test)).drop("_rank", "_n")


def folds(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """df with fold: within each label k runs of ranks, equal but for the first ones, which take the remainder."""
    each, more, at = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_rank") - 1
    long = more * (each + 1)  # rows of the runs that have one more
    fold = F.when(at < long, F.floor(at / (each + 1))).otherwise(more + F.floor((at - long) / F.greatest(each, F.lit(1))))
    return ranked(df, key, label).withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def class_weight(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.round(F.sum((F.col(label) == 0).cast("int")) / F.nullif(F.sum((F.col(label) == 1).cast("int")), F.lit(0)), 6).alias("scale_pos_weight"))


def encode_labels(df: DataFrame, column: str, known: list[str] = ("brandname", "personal_number", "shortcode", "unknown")) -> DataFrame:
    """Codes of the sorted categories; unseen values are 0."""
    code = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in sorted(known)]), F.col(column)), F.lit(0)) - 1, F.lit(0))
    return df.withColumn(f"{column}_code", code)


def _inputs(df: DataFrame, features: list[str], senders: list[str] | None, sender: str) -> tuple[DataFrame, list[str]]:
    """df with the model's inputs as columns; senders that aren't known have the first code, as nulls have."""
    if senders is None:
        return df, list(features)
    code = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in senders]), F.col(sender).cast("string")), F.lit(0)) - 1, F.lit(0)) if senders else F.lit(0)
    return df.withColumn("_sender", code.cast("double")), [*features, "_sender"]


def _narrow(column: pa.Array) -> np.ndarray:
    """The column as the smallest type that holds all its values as they are; nulls are nan."""
    x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(x) and (x == np.round(x)).all() and np.abs(x).max() < 1 << 31:
        return x.astype(np.promote_types(np.min_scalar_type(int(x.min())), np.min_scalar_type(int(x.max()))))
    return x


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([_narrow(c) for c in batch.columns])], pa.binary())], ["part"])


def training_table(df: DataFrame, features: list[str] = K.FEATURES, sender: str | None = "sender_type", key: str = "doc_id", label: str = "label", most: int | None = None, also: tuple[str, ...] = ()):
    """senders, the inputs' columns, labels, and the further columns, of all labelled rows, in the order of their buckets. Columns come as the smallest types
    that hold their values, some 40 bytes a row in all. most: only for callers that want a sample by hash of the key instead; no model or query does."""
    known = df.filter(F.col(label).isin(0, 1))
    if most is not None and (n := known.count()) > most:
        known = known.filter(F.pmod(F.xxhash64(key, F.lit(31)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    senders = sorted(r[0] for r in known.select(F.coalesce(F.col(sender).cast("string"), F.lit("nan"))).distinct().collect()) if sender else None
    ready, columns = _inputs(known, features, senders, sender)
    rows = ready.orderBy(bucket(key), key).select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), F.col(label).cast("int").alias("y"), *also)
    parts = [pickle.loads(r.part) for r in rows.mapInArrow(_packed, "part binary").collect()]
    x = [np.concatenate([np.zeros(0, np.uint8), *(part[i] for part in parts)]) for i in range(len(rows.columns))]
    n = len(columns)
    return senders, x[:n], x[n].astype(int), pd.DataFrame(dict(zip(also, x[n + 1 :], strict=True)))


def train(df: DataFrame, kind: str = "boosted", trees: int | None = None, features: list[str] = K.FEATURES, sender: str | None = "sender_type", key: str = "doc_id", **changed) -> T.Model:
    """kind: boosted, forest or tree; changed: parameters that differ from the kind's own."""
    p = T.DEFAULTS[kind] | changed | ({"trees": trees} if trees and kind != "tree" else {})
    senders, x, y, _ = training_table(df, features, sender, key)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((x, y))
    step = max(1, p["trees"] // 16) if kind == "forest" else p["trees"]
    jobs = [{"numbers": [i, min(i + step, p["trees"])]} for i in range(0, p["trees"], step)]
    made = T.spread(spark, jobs, lambda job: [t.__dict__ for t in T.fitted(kind, *shared.value, p, range(*job["numbers"]))])
    return T.Model(kind, list(features), senders, [T.Tree(**t) for part in made for t in part], p.get("rate", 1.0))


def predict(model: T.Model, df: DataFrame, threshold: float = K.THRESHOLD, sender: str = "sender_type", strict: bool = False) -> DataFrame:
    """df with p and predicted. strict: a probability equal to the threshold is negative."""
    ready, columns = _inputs(df, model.features, model.senders, sender)
    over = F.col("p") > threshold if strict else F.col("p") >= threshold
    return T.scored(model, ready, columns).drop("_sender").withColumn("predicted", over.cast("int"))


def save(spark: SparkSession, model: T.Model, path: str) -> None:
    """A folder of one text file, written by Spark, so any path that Spark reaches will do."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> T.Model:
    return T.Model.from_json(spark.read.text(path, wholetext=True).first().value)


def metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    hit = lambda y, p: F.sum(((F.col(label) == y) & (F.col(predicted) == p)).cast("long"))
    s = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    over = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return s.select("tp", "fp", "fn", "tn", over(tp + tn, tp + fp + fn + tn).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))


def threshold_counts(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """For each distinct score: rows and positives at and above it. Distinct scores are sorted by ranges, each of which is
    one task's work; what lies above a range comes from a table of a row a range."""
    per = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))
    ranged = written(per.repartitionByRange(F.desc(score)).withColumn("_r", F.spark_partition_id()), "scores")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    sizes = ranged.groupBy("_r").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    sizes = sizes.select("_r", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_pos")))
    w = Window.partitionBy("_r").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({"above": F.sum("n").over(w), "hits": F.sum("pos").over(w)}).join(F.broadcast(sizes), "_r")
    return own.select(F.col(score).alias("threshold"), "n", "pos", (F.col("above") + F.col("_n")).alias("above"), (F.col("hits") + F.col("_pos")).alias("hits"))


def roc_auc(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """Exactly, by pairs: a positive above a negative counts 1, a tie half."""
    c = threshold_counts(df, score, label)
    neg, neg_above = F.col("n") - F.col("pos"), F.col("above") - F.col("hits")
    sums = c.agg(F.sum(neg * (F.col("hits") - F.col("pos")) + 0.5 * neg * F.col("pos")).alias("u"), F.sum("pos").alias("p"), F.sum(neg).alias("n"))
    return sums.select(F.round(F.col("u") / F.nullif(F.col("p") * F.col("n"), F.lit(0)), 6).alias("auc"))


def best_threshold(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """The threshold of the best F1, the highest of equals."""
    total = df.agg(F.sum(label).alias("all_pos"))
    c = threshold_counts(df, score, label).join(F.broadcast(total))  # one row
    f1 = 2.0 * F.col("hits") / F.nullif(F.col("above") + F.col("all_pos"), F.lit(0))
    return c.withColumn("f1", F.round(f1, 6)).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", "threshold")).alias("b")).select("b.threshold", "b.f1")


def cross_validate(df: DataFrame, kind: str = "boosted", grid: dict | None = None, trees: int | None = None, k: int = 5, key: str = "doc_id", sender: str | None = "sender_type", features: list[str] = K.FEATURES) -> DataFrame:
    """fold, auc and the grid's parameters: of each combination of parameters and each fold, a model trained on the other folds.

    Folds are stratified by key, so they're the same each time. Fits are tasks of their own; boosted ones of a fold that differ in gamma and child only
    are one task, as they share their trees until these differ."""
    grid = grid or {}
    senders, x, y, rows = training_table(folds(df.filter(F.col("label").isin(0, 1)), key, "label", k), features, sender, key, also=("fold",))
    fold = rows["fold"].to_numpy(int)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((x, y, fold))
    base = T.DEFAULTS[kind] | ({"trees": trees} if trees and kind != "tree" else {})
    inner = [n for n in grid if kind == "boosted" and n in ("gamma", "child")]
    outer = [n for n in grid if n not in inner]
    jobs = [{"fold": i, "outer": dict(zip(outer, values, strict=True))} for values in itertools.product(*(grid[n] for n in outer)) for i in range(k)]
    jobs.sort(key=lambda job: -job["outer"].get("depth", 0))  # the longest first, as tasks start in this order
    each = [dict(zip(inner, values, strict=True)) for values in itertools.product(*(grid[n] for n in inner))]

    def run(job: dict) -> list[dict]:
        x, y, fold = shared.value
        own, p = fold == job["fold"], base | job["outer"]
        if len(set(y[~own])) < 2:
            found = [None] * len(each)
        elif kind == "boosted":
            order = np.concatenate([np.flatnonzero(~own), np.flatnonzero(own)])
            edges = T.edges_of([c[~own] for c in x])
            bins = T.Bins(T.codes_of([c[order] for c in x], edges), edges)
            made = T.boosted(bins, y[~own], [p | e for e in each])
            found = [T.auc(T.chances(logit[(~own).sum() :]), y[own]) for _, logit in made]
        else:
            found = [T.auc(T.Model(kind, [], None, T.fitted(kind, [c[~own] for c in x], y[~own], p)).probabilities(np.column_stack([c[own] for c in x]).astype(float)), y[own])]
        return [{"fold": job["fold"], "auc": auc, **job["outer"], **e} for e, auc in zip(each, found, strict=True)]

    kinds = {n: "int" if all(isinstance(v, int) for v in values) else "double" for n, values in grid.items()}
    done = [(r["fold"], r["auc"], *(int(r[n]) if kinds[n] == "int" else float(r[n]) for n in grid)) for part in T.spread(spark, jobs, run, 256) for r in part]
    return spark.createDataFrame(done, "fold int, auc double" + "".join(f", `{n}` {t}" for n, t in kinds.items()))


def fold_summary(scores: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation of the folds' AUC, and how many folds have one."""
    return scores.groupBy(*by).agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.stddev_pop("auc"), 6).alias("std_auc"), F.count("auc").alias("folds"))


#: 144 combinations.
GRID = {"depth": [3, 4, 5, 6], "child": [1, 3, 5], "gamma": [0.0, 0.1, 0.2], "subsample": [0.8, 1.0], "columns": [0.8, 1.0]}


def grid_search(df: DataFrame, grid: dict | None = None, **more) -> DataFrame:
    """Each combination's mean and deviation over the folds, the best first by rank; ties go to the earlier values."""
    grid = grid or GRID
    summed = fold_summary(cross_validate(df, grid=grid, **more), *grid)
    return summed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_auc"), *grid)))  # a row a combination


def importances(model: T.Model, most: int | None = None) -> list[tuple[str, float]]:
    return model.importances()[:most]


def compare(df: DataFrame, kinds: tuple[str, ...] = ("boosted", "forest", "tree"), trees: int | None = None, key: str = "doc_id", sender: str | None = "sender_type") -> DataFrame:
    """Metrics and AUC of each model on the same test rows, the gap of accuracy to the training rows, and which is best by F1 (of equals the first by name)."""
    split = written(stratified_split(df, key, "label"), "split")
    fit, test = split.filter(~F.col("is_test")), split.filter("is_test")
    rows = []
    for kind in kinds:
        model = train(fit, kind, trees, sender=sender, key=key)
        cut = K.THRESHOLD if kind == "boosted" else 0.5
        tested = predict(model, test, cut)
        m, own = metrics(tested).first().asDict(), metrics(predict(model, fit, cut)).first().accuracy
        rows.append((kind, m["accuracy"], m["precision"], m["recall"], m["f1"], roc_auc(tested).first().auc, round(own - m["accuracy"], 6), own - m["accuracy"] > 0.05))
    out = df.sparkSession.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, auc double, gap double, overfit boolean")
    best = out.agg(F.min_by("model", F.struct(-F.col("f1"), "model")).alias("_best"))
    return out.join(F.broadcast(best)).withColumn("best", F.col("model") == F.col("_best")).drop("_best")  # one row
