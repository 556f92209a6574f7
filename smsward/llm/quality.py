"""Text quality: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Statistics of the whole text (lengths, shares of kinds of characters, repeated lines and words) are
standardised and mapped by cosines of random projections, which approximates a Gaussian kernel. Each
partition of the training rows sums its normal equations; the sums of the partitions give the ridge
solution. A part of the rows that wasn't fitted on calibrates the scores by pooling adjacent violators.

Training takes at most SAMPLE labelled ids in expectation, by hash, one text of each (where rows share an id, that of the
least statistics), from a number of partitions that doesn't grow with the input, so the summed equations that reach the driver are bounded.

Cases: null and empty texts have zero statistics and are scored like any; long texts are measured whole;
repeated rows and null doc_ids are scored as any; ids labelled both ways count as good; of equal scores the calibration pools all; further
columns pass through, but for one named quality, which is replaced; without labels of both classes, every text scores 0.5; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.llm.common import SPACES, U64, blocks, mix, rolling

SAMPLE = 40_000
FEATURES = 256
PARTITIONS = 16
THRESHOLD = 0.3
GAMMA = 0.15
RIDGE = 1.0

_CLASS = np.full(256, 4, np.uint8)  # others, marks of ASCII
_CLASS[[b for b in range(256) if chr(b).isascii() and chr(b).islower()]] = 0
_CLASS[[b for b in range(256) if chr(b).isascii() and chr(b).isupper()]] = 1
_CLASS[[b for b in range(48, 58)]] = 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 5
_CLASS[128:] = 6
NAMES = ["log_words", "log_chars", "word_length", "long_words", "lower", "upper", "digit", "space", "symbol", "punctuation", "foreign", "lines", "repeated_lines", "distinct_words", "word_ends_in_symbol", "single_char_words", "top_word", "stop_marks"]


def _sum(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def _repeats(h: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the number of distinct values and the count of the most frequent one."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    top = np.zeros(rows)
    np.maximum.at(top, doc[at], runs)
    return np.bincount(doc[at], minlength=rows).astype(float), top


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows, and a statistic in each column, in the order of NAMES."""
    for block in blocks(batches, "text"):
        block.words(SPACES)
        rows, data = len(block.offsets) - 1, block.data
        kind = _CLASS[data]
        n, w = np.maximum(np.diff(block.offsets), 1).astype(float), np.diff(block.first).astype(float)
        words = np.maximum(w, 1)
        size = block.end - block.start
        shares = [_sum(kind == k, block.offsets) / n for k in (0, 1, 2, 3, 4, 5, 6)]
        doc = np.repeat(np.arange(rows), np.diff(block.first))
        distinct, top = _repeats(block.hashes(), doc, rows)
        breaks = data == 10
        ends = np.flatnonzero(breaks)
        line_end = np.sort(np.concatenate([ends, block.offsets[1:]]))
        line_start = np.sort(np.concatenate([ends + 1, block.offsets[:-1]]))
        owner = np.searchsorted(block.offsets, line_start, "right") - 1
        real = line_end > line_start
        a, b, owner = line_start[real], line_end[real], owner[real]
        lines = np.bincount(owner, minlength=rows).astype(float)
        unlike, _ = _repeats(mix(rolling(data.astype(U64) + U64(1), a, b)), owner, rows)
        last = kind[np.maximum(block.end - 1, 0)] if len(size) else np.zeros(0)
        stops = _sum(np.isin(data, [46, 33, 63]), block.offsets)
        x = np.stack([
            np.log1p(w), np.log1p(np.diff(block.offsets)), _sum(size, block.first) / words, _sum(size > 14, block.first) / words,
            *shares, lines / words, 1 - unlike / np.maximum(lines, 1), distinct / words, _sum(last == 4, block.first) / words,
            _sum(size == 1, block.first) / words, top / words, stops / words,
        ], 1)
        yield block.rows, x


class FourierRidge:
    """mean, spread: of the statistics; W, shift: the projections; beta: the solution; knots: the calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.W = rng.normal(0, np.sqrt(2 * GAMMA), (len(NAMES), FEATURES)) / np.sqrt(len(NAMES) / 6)
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.knots = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.cos(z @ self.W + self.shift) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.map(x) @ self.beta, *self.knots), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x: blocks of adjacent violators pooled; a line joins their middles."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []  # sum of y, rows, sum of x
    for v, t in zip(x[order].tolist(), y[order].tolist(), strict=True):
        stack.append([t, 1.0, v])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            s, n, q = stack.pop()
            stack[-1] = [stack[-1][0] + s, stack[-1][1] + n, stack[-1][2] + q]
    at = np.array([q / n for _, n, q in stack])
    return at + np.arange(len(at)) * 1e-12, np.array([s / n for s, n, _ in stack]) * 0.999 + 0.0005


_ROW = "part int, moments binary"


def _equations(model: FourierRidge | None):
    """Per partition: counts and moments of the statistics, or with a model its normal equations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(NAMES) if model is None else FEATURES + 1
        gram, right = np.zeros((size, size)), np.zeros(size)
        total = 0.0
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(NAMES))
            y = batch.column("label").to_numpy().astype(float)
            z = x if model is None else model.map(x)
            gram += z.T @ z
            right += z.sum(0) if model is None else z.T @ y
            total += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate([[total], right, gram.ravel()]).tobytes()], pa.binary())], ["part", "moments"])

    return run


def _summed(train: DataFrame, model: FourierRidge | None) -> tuple[float, np.ndarray, np.ndarray]:
    size = len(NAMES) if model is None else FEATURES + 1
    total = sum(np.frombuffer(bytes(r.moments)) for r in train.mapInArrow(_equations(model), _ROW).toLocalIterator())
    return total[0], total[1 : size + 1], total[size + 1 :].reshape(size, size)


def fit(documents: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> FourierRidge | None:
    """labelled: doc_id, label (0 or 1). None without labels of both classes."""
    labelled = labelled.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    totals = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(totals) != {0, 1}:
        return None
    n = sum(totals.values())
    share = min(1.0, sample / max(n, 1))
    picked = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in statistics(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(measure, "doc_id long, label int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.label", "r.x")
    rows = rows.repartition(PARTITIONS, "doc_id").sortWithinPartitions("doc_id").cache()
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4))
    train, rest = rows.filter(part != 0), rows.filter(part == 0)
    count, first, second = _summed(train, None)
    if count < 2:
        rows.unpersist()
        return None
    mean = first / count
    model = FourierRidge(mean, np.sqrt(np.maximum(np.diag(second) / count - mean**2, 0)) + 1e-3)
    _, right, gram = _summed(train, model)
    model.beta = np.linalg.solve(gram + RIDGE * np.eye(FEATURES + 1) * max(1.0, count * 1e-4), right)
    held = rest.select("label", "x").toPandas()
    rows.unpersist()
    if held.label.nunique() == 2:
        model.knots = isotonic(model.map(np.array(held.x.tolist())) @ model.beta, held.label.to_numpy(float))
    return model


def score(docs: DataFrame, model: FourierRidge | None) -> DataFrame:
    """All columns of docs, then quality (0 to 1)."""
    docs = docs.drop("quality")
    if model is None:
        return docs.withColumn("quality", F.lit(0.5))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", quality double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in statistics(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.scores(x))], [*rows.schema.names, "quality"])

    return docs.mapInArrow(run, schema)
