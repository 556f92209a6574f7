"""Toxic texts: a convolutional classifier over hashed word embeddings, trained in numpy.

Words, and their beginnings of STEM bytes, fall into BUCKETS hash buckets, each with a small embedding, and a word's vector is the
sum of both, so an inflected form that was never seen has its stem's; filters of widths 1 to 3 slide over the
words, each filter's maximum over the whole text is taken, and a logistic layer scores the maxima. After
training, embedding times filter is tabulated, so a text costs a few table look-ups a word.

Training takes at most SAMPLE labelled ids of each class, in expectation, chosen by hash of the id, one text of each (where rows share
an id, that of the least hash) and of at most WORDS words, so what reaches the driver is bounded by both parameters. It is split in three disjoint
parts: the first starts the embeddings with each bucket's log odds, the second trains everything by
Adam, the third calibrates the score to a probability of the class as it is in the labels.
Thresholds are calibrated by language: each language's cut balances misses and false alarms on the third
part; languages with few labels take the cut of all.

Cases: null and empty texts, and those without words, score the calibrated minimum; long texts are scored whole; repeated
rows and null doc_ids are scored as any; ids labelled both ways count as toxic; further columns pass through, but for one named
toxicity, which is replaced; without labels of both classes, every text scores 0; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.llm.common import LETTERS, U64, blocks, mix, within

BUCKETS = 1 << 16
STEM = 5
WIDTHS = (1, 2, 3)
DIM, FILTERS = 8, 6
SAMPLE, WORDS = 5000, 20_000
THRESHOLD = 0.3
#: Of the log odds that a word and its beginning start with, as they add up.
SHARE = 0.6


def _word_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows; buckets of each word (first line) and of its beginning (second); and first word of each row; each row is led and followed by padding (bucket 0)."""
    for block in blocks(batches, "text", lower=True):
        block.words(LETTERS)
        whole = block.hashes()
        block.end = np.minimum(block.end, block.start + STEM)
        n = np.diff(block.first)
        size = np.maximum(n, 1) + 2
        first = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros((2, first[-1]), np.int32)
        doc, place = within(n)
        spot = first[doc] + 1 + place
        out[0, spot] = (whole % U64(BUCKETS - 1)).astype(np.int32) + 1
        out[1, spot] = (mix(block.hashes() + U64(1)) % U64(BUCKETS - 1)).astype(np.int32) + 1
        yield block.rows, out, first


class TextCNN:
    """E: embeddings; C[w]: filters of width w; b: their bias; v, c: the logistic layer; scale, shift: calibration."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.C = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for k, w in enumerate(WIDTHS):
            self.C[k][:, 0, :] = 0.0
            self.C[k][w // 2, 0, :] = np.linspace(0.5, 1.0, FILTERS)
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.c = np.float32(-2.0)
        self.scale, self.shift = 1.0, 0.0
        self.cuts: dict[str, float] = {}

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.E @ c[j] for j in range(w)] for w, c in zip(WIDTHS, self.C, strict=True)]

    def pooled(self, ids: np.ndarray, first: np.ndarray, tables: list, arg: bool = False):
        """Maxima of each filter over each text; with arg, also the places they stand at."""
        tops, places = [], []
        for w, parts, b in zip(WIDTHS, tables, self.b, strict=True):
            n = ids.shape[1] - w + 1
            a = parts[0][ids[0, :n]]
            a += parts[0][ids[1, :n]]
            for j in range(1, w):
                a += parts[j][ids[0, j : n + j]]
                a += parts[j][ids[1, j : n + j]]
            last = np.minimum(first[1:] - w + 1, n)
            stop = np.stack([first[:-1], last], 1).ravel()
            stop[1::2] = np.maximum(stop[1::2], stop[::2] + 1)
            pad = np.concatenate([a, np.full((2, FILTERS), -np.inf, np.float32)])
            top = np.maximum.reduceat(pad, stop, axis=0)[::2]
            tops.append(np.maximum(top + b, 0))
            if arg:
                group = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
                for f in range(FILTERS):
                    hit = np.flatnonzero(a[:, f] == top[group, f])
                    place = np.zeros(len(first) - 1, np.int64)
                    place[group[hit[::-1]]] = hit[::-1]
                    places.append(place)
        h = np.concatenate(tops, 1)
        return (h, places) if arg else h

    def logits(self, ids: np.ndarray, first: np.ndarray, tables: list) -> np.ndarray:
        return self.pooled(ids, first, tables) @ self.v + self.c

    def scores(self, ids: np.ndarray, first: np.ndarray, tables: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(ids, first, tables).astype(float) + self.shift, -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, key, value: np.ndarray, grad: np.ndarray) -> None:
        m, s = self.state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        s += 0.01 * (grad * grad - s)
        value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-6)


def _train(model: TextCNN, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 64) -> None:
    rng, adam = np.random.default_rng(11), _Adam(0.02)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            adam.t += 1
            ids = np.concatenate([docs[i] for i in part], 1)
            first = np.concatenate([[0], np.cumsum([docs[i].shape[1] for i in part])])
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            tables = [[model.E[used] @ c[j] for j in range(w)] for w, c in zip(WIDTHS, model.C, strict=True)]
            h, places = model.pooled(local, first, tables, arg=True)
            p = 1 / (1 + np.exp(-np.clip(h @ model.v + model.c, -30, 30)))
            g = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
            dh = g[:, None] * model.v * (h > 0)
            moves = np.zeros((len(used), DIM), np.float32)
            for k2, w in enumerate(WIDTHS):
                dC = np.zeros_like(model.C[k2])
                for f in range(FILTERS):
                    d, at = dh[:, k2 * FILTERS + f], places[k2 * FILTERS + f]
                    for j in range(w):
                        for line in local:
                            word = line[np.minimum(at + j, len(line) - 1)]
                            dC[j, :, f] += d @ model.E[used[word]]
                            np.add.at(moves, word, d[:, None] * model.C[k2][j, :, f])
                adam.step(("b", k2), model.b[k2], dh[:, k2 * FILTERS : (k2 + 1) * FILTERS].sum(0))
                adam.step(("C", k2), model.C[k2], dC)
            adam.step("v", model.v, h.T @ g)
            c = np.array([model.c], np.float32)
            adam.step("c", c, np.array([g.sum()], np.float32))
            model.c = c[0]
            model.E[used] -= 0.5 * moves


def fit(documents: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> TextCNN | None:
    """Trains on rows of documents with a label; labelled: doc_id, label (0 or 1). None without both classes.

    At most `sample` labelled ids of each class are taken (in expectation, chosen by hash), so what reaches
    the driver and what is broadcast are bounded by that parameter.
    """
    labelled = labelled.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    totals = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(totals) != {0, 1}:
        return None
    share = {k: min(1.0, sample / n) for k, n in totals.items()}
    pick = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < F.when(F.col("label") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20)))
    rows = documents.select("doc_id", "text", "lang").join(F.broadcast(labelled.filter(pick)), "doc_id")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, out, first in _word_ids(batches):
            short = np.diff(first) <= WORDS + 2
            flat = [out[:, a:b].astype("<i4").tobytes() for a, b in zip(first[:-1][short], first[1:][short], strict=True)]
            part = part.filter(pa.array(short))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("lang"), pa.array(flat, pa.binary())], ["doc_id", "label", "lang", "ids"])

    made = rows.mapInArrow(ids, "doc_id long, label int, lang string, ids binary")
    one = made.groupBy("doc_id").agg(F.min_by(F.struct("label", "lang", "ids"), F.xxhash64("ids", "lang")).alias("r")).select("doc_id", "r.*")
    got = sorted((r.doc_id, r.label, r.lang or "", bytes(r.ids)) for r in one.toLocalIterator())
    if len({r[1] for r in got}) < 2:
        return None
    docs, y = [np.frombuffer(r[3], "<i4").reshape(2, -1) for r in got], np.array([r[1] for r in got])
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    part = np.array([zlib.crc32(b"part %d" % r[0]) % 20 for r in got])
    start, learn, rest = part < 9, (part >= 9) & (part < 16), part >= 16
    model = TextCNN()
    present = {k: np.zeros(BUCKETS) for k in (0, 1)}
    for d, k, w, s in zip(docs, y, weight, start, strict=True):
        if s:
            present[k][np.unique(d)] += w
    base = (y * weight).sum() / weight.sum()
    seen, pos = present[0] + present[1], present[1]
    rate = (pos + 3 * base) / (seen + 3)
    model.E[:, 0] = SHARE * np.clip(np.log(rate / (1 - rate + 1e-3)) - np.log(base / (1 - base)), -3, 4)
    model.E[0] = 0
    chosen = np.flatnonzero(learn)
    if len(set(y[chosen])) == 2:
        balance = np.where(y == 1, 0.5 / max(1e-9, (weight * y).sum()), 0.5 / max(1e-9, (weight * (1 - y)).sum())) * weight
        _train(model, [docs[i] for i in chosen], y[chosen], (balance / balance.mean())[chosen])
    tables = model.tables()
    held = np.flatnonzero(rest) if len(set(y[rest])) == 2 else np.arange(len(y))
    first = np.concatenate([[0], np.cumsum([docs[i].shape[1] for i in held])])
    z = model.logits(np.concatenate([docs[i] for i in held], 1), first, tables).astype(float)
    _calibrate(model, z, y[held], weight[held])
    p = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))
    langs, y, weight = np.array([got[i][2] for i in held]), y[held], weight[held]
    for lang in sorted({"", *langs.tolist()}):
        own = langs == lang if lang else np.ones(len(z), bool)
        if y[own].sum() >= 20 and (1 - y[own]).sum() >= 20 or not lang:
            model.cuts[lang] = _cut(p[own], y[own], weight[own])
    return model


def _calibrate(model: TextCNN, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    """Logistic regression of the label on the logit, with a small ridge towards the identity."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, q = w * (p - y), w * p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + (a - 1), r.sum() + 0.1 * b])
        H = np.array([[(q * z * z).sum() + 1, (q * z).sum()], [(q * z).sum(), q.sum() + 0.1]])
        step = np.linalg.solve(H, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    model.scale, model.shift = max(float(a), 1e-3), float(b)


def _cut(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The threshold of the best F1, held between 0.2 and 0.5."""
    best = max((2 * (w * y * (p >= t)).sum() / max(1e-9, (w * y).sum() + (w * (p >= t)).sum()), -abs(t - THRESHOLD), t) for t in np.arange(0.2, 0.51, 0.05))
    return float(round(best[2], 2))


def score(docs: DataFrame, model: TextCNN | None) -> DataFrame:
    """All columns of docs, then toxicity (0 to 1)."""
    docs = docs.drop("toxicity")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", toxicity double"
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = own.tables()
        for rows, ids, first in _word_ids(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own.scores(ids, first, tables))], [*rows.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)


def rejected(scored: DataFrame, model: TextCNN | None):
    """The column that says whether a scored row is over its language's threshold."""
    cuts = dict(model.cuts) if model else {}
    cut = F.lit(cuts.pop("", THRESHOLD))
    for lang, t in sorted(cuts.items()):
        cut = F.when(F.col("lang") == lang, t).otherwise(cut)
    return F.col("toxicity") >= cut
