"""Decision trees over binned features: boosted, bagged and single.

One grower serves all kinds. It works on first and second derivatives of the loss summed by bin, level by level: boosting uses
those of the logistic loss, and a forest's trees take -w * y and w, for which the gain is the weighted drop of the Gini impurity (times a
constant) and a leaf's value is the weighted share of positives. Features are binned once, to at most BINS quantile bins.

Spark's own boosted trees lack a least gain by node weight, a share of columns by tree and a weight of positives as specified here, and
run several jobs a tree; here a fit is one task's work on all labelled rows, of which a task holds the binned columns, and Spark spreads what is
independent: the trees of a forest, the folds of a cross-validation and the combinations of a grid.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BINS = 256


@dataclass
class Tree:
    """feature: of each node, -1 for leaves; rows with a value of at most threshold go left. gain: what each split won."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self) -> int:
        for x, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)):
            x.append(empty)
        return len(self.feature) - 1

    def values(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        open_ = feature[at] >= 0
        while open_.any():
            rows = np.flatnonzero(open_)
            node = at[rows]
            low = x[rows, feature[node]] <= threshold[node]
            at[rows] = np.where(low, left[node], right[node])
            open_ = feature[at] >= 0
        return np.array(self.value)[at]


def _columns(x: np.ndarray | list[np.ndarray]) -> np.ndarray | list[np.ndarray]:
    return x.T if isinstance(x, np.ndarray) else x


def edges_of(x: np.ndarray | list[np.ndarray], most: int = BINS) -> list[np.ndarray]:
    """Upper bounds of each feature's bins but the last: between all its values where they're few, else at quantiles. x: a table or its columns."""
    out = []
    for column in _columns(x):
        column = column.astype(float)
        own = np.unique(column)
        if len(own) > most:
            own = np.unique(np.quantile(column, np.linspace(0, 1, most), method="lower"))
        out.append((own[1:] + own[:-1]) / 2)
    return out


def codes_of(x: np.ndarray | list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Each value's bin, stored by column, as histograms read columns."""
    columns = _columns(x)
    out = np.zeros((len(columns[0]) if len(columns) else 0, len(columns)), np.uint8, order="F")
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, columns[i], "left")
    return out


def exact(w: np.ndarray) -> np.ndarray:
    """w rounded to multiples of a power of two (some 1e-15 of the sum of |w|), so that all sums of it are exact in any order: a node's
    sums less those of one child are those of the other."""
    total = float(np.abs(w).sum())
    unit = 2.0 ** (51 - math.frexp(total)[1]) if 1e-200 < total < 1e200 else 1.0
    return np.round(w * unit) / unit


class Bins:
    """Binned rows, a byte a value. Of columns in which one bin has most of the rows, the others are listed, as that bin is what they leave of a node's sums.
    The rest's codes lie eight columns to a word, so that a row's are read at once."""

    def __init__(self, codes: np.ndarray, edges: list[np.ndarray]):
        self.codes, self.edges = np.asfortranarray(codes, dtype=np.uint8), edges
        self.usual, self.rare, dense = [], [], []
        for i, e in enumerate(edges):
            counts = np.bincount(self.codes[:, i], minlength=len(e) + 1)
            usual = int(counts.argmax())
            few = len(e) > 0 and counts[usual] >= 0.7 * len(codes)
            rows = np.flatnonzero(self.codes[:, i] != usual) if few else None
            self.usual.append(usual)
            self.rare.append((rows, self.codes[:, i].take(rows)) if few else None)
            if len(e) and not few:
                dense.append(i)
        self.place = {c: divmod(k, 8) for k, c in enumerate(dense)}
        packed = np.zeros((-(-len(dense) // 8), len(codes), 8), np.uint8)
        for c, (word, byte) in self.place.items():
            packed[word, :, byte] = self.codes[:, c]
        self.words = packed.view(np.uint64)[:, :, 0]

    def read(self, word: int, rows: np.ndarray) -> np.ndarray:
        """The rows' codes of the word's columns."""
        return self.words[word].take(rows).view(np.uint8).reshape(-1, 8)


@dataclass(frozen=True)
class Growth:
    """ridge: added to the second derivatives; gamma: the least gain; child: the least weight of a child; leaf: the least rows of one;
    split: the least rows of a node that is split; by_node: how many features each node draws."""

    depth: int
    ridge: float = 1.0
    gamma: float = 0.0
    child: float = 0.0
    leaf: int = 1
    split: int = 2
    by_node: int | None = None


def grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, how: Growth, columns: np.ndarray, rng: np.random.Generator) -> Tree:
    return grown(Bins(codes, edges), exact(g), exact(h), how, columns, rng, np.arange(len(codes)))[0]


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * a / b, in new arrays that are used again."""
    a = a * a
    a /= np.maximum(b, 1e-12, out=b)
    return a


def grown(bins: Bins, g: np.ndarray, h: np.ndarray, how: Growth, columns: np.ndarray, rng: np.random.Generator, rows: np.ndarray, rest: np.ndarray | None = None):
    """A tree of the rows (which may repeat), its leaves as pairs of node and rows, the rest's with them, and the least gain and child's weight of its splits.

    g and h: exact(). Sums by bin are made for the smaller child of each split only, unless nodes draw columns: then for what is drawn."""
    tree = Tree()
    tree.add()
    codes, edges, ends = bins.codes, bins.edges, []
    live = [i for i, c in enumerate(columns) if len(edges[c])]
    own = [int(columns[i]) for i in live]
    starts = np.cumsum([0, *(len(edges[c]) + 1 for c in own)])
    last = starts[1:] - 1  # nothing is above a column's last bin
    draws = how.by_node is not None and how.by_node < len(columns)
    counted = how.leaf > 1 or how.split > 2 or how.child <= 0  # else a child of some weight has a row
    slot = np.full(len(codes), -1, np.int16 if how.depth < 16 else np.int64)
    w = g + 1j * h  # both sums in one pass; they don't mix

    def summed(nodes: list[np.ndarray], drawn: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Of each node's rows: weights by bin, those of lower bins with them; how many rows they are (if needed); and the whole weight."""
        k, sizes = len(nodes), [len(x) for x in nodes]
        r = nodes[0] if k == 1 else np.concatenate(nodes)
        place = np.repeat(np.arange(0, k * BINS, BINS), sizes)
        mine, ends = w.take(r), np.cumsum([0, *sizes])
        whole = np.array([mine[a:b].sum() for a, b in itertools.pairwise(ends)])
        low, n = np.zeros((k, starts[-1]), complex), np.zeros((k, starts[-1])) if counted else None
        sparse = drawn is None and not counted  # rows occur once
        if sparse:
            slot[r] = np.repeat(np.arange(k, dtype=slot.dtype), sizes)
        read: dict[int, np.ndarray] = {}
        for j, c in enumerate(own):
            bins_of, part = slice(starts[j], starts[j + 1]), np.zeros(k * BINS, complex)
            if sparse and bins.rare[c] is not None:
                few, few_codes = bins.rare[c]
                at = slot.take(few)
                met = np.flatnonzero(at >= 0)
                index = at.take(met) * np.intp(BINS)
                index += few_codes.take(met)
                np.add.at(part, index, w.take(few.take(met)))
                part = part.reshape(k, BINS)
                part[:, bins.usual[c]] = whole - part.sum(1)
            else:
                if drawn is not None:
                    met = np.flatnonzero(drawn[:, j].take(place // BINS))
                    index = place.take(met)
                    index += codes[:, c].take(r.take(met))
                    np.add.at(part, index, mine.take(met))
                else:
                    if c in bins.place:
                        word, byte = bins.place[c]
                        if word not in read:
                            read[word] = bins.read(word, r)
                        index = read[word][:, byte].astype(np.intp)
                    else:
                        index = codes[:, c].take(r).astype(np.intp)
                    if k > 1:
                        index += place
                    np.add.at(part, index, mine)
                part = part.reshape(k, BINS)
                if counted:
                    np.bincount(index, minlength=k * BINS).reshape(k, BINS)[:, : len(edges[c]) + 1].cumsum(1, out=n[:, bins_of])
            part[:, : len(edges[c]) + 1].cumsum(1, out=low[:, bins_of])
        if sparse:
            slot[r] = -1
        return low, n, whole

    # each open node: its number, its rows and the rest's, and how many are rows
    active, least_gain, least_child = [(0, rows if rest is None else np.concatenate([rows, rest]), len(rows))], np.inf, np.inf
    low, low_n, whole, pairs = None, None, None, []
    for level in range(how.depth + 1):
        final = level == how.depth or not own
        drawn = np.argsort(rng.random((len(active), len(columns))), 1) < how.by_node if draws and level < how.depth and len(columns) else None
        if final:
            whole = np.array(parts if level else [w.take(r[:m]).sum() for _, r, m in active])
        elif level == 0 or drawn is not None:
            low, low_n, whole = summed([r[:m] for _, r, m in active], None if drawn is None else drawn[:, live])
        else:
            small = [int(active[2 * i + 1][2] < active[2 * i][2]) for i in range(len(pairs))]
            some = summed([active[2 * i + s][1][: active[2 * i + s][2]] for i, s in enumerate(small)], None)
            mine = 2 * np.arange(len(pairs)) + small
            joined = []
            for part, before in zip(some, (low, low_n, whole), strict=True):
                both = None if part is None else np.empty((len(active), *part.shape[1:]), part.dtype)
                if part is not None:
                    both[mine] = part
                    both[mine ^ 1] = before[pairs] - part
                joined.append(both)
            low, low_n, whole = joined
        whole_g, whole_h = whole.real.copy(), whole.imag.copy()
        for i, (node, _, _) in enumerate(active):
            tree.value[node] = float(-whole_g[i] / (whole_h[i] + how.ridge)) if whole_h[i] + how.ridge else 0.0
        if final:
            break
        low_g, low_h = low.real.copy(), low.imag.copy()
        total_g, total_h = whole_g[:, None], whole_h[:, None]
        high_h = total_h - low_h
        allowed = low_h >= how.child
        allowed &= high_h >= how.child
        if counted:
            n = np.array([m for _, _, m in active])[:, None]
            allowed &= (low_n >= how.leaf) & (n - low_n >= how.leaf) & (n >= how.split)
        allowed[:, last] = False
        if drawn is not None:
            allowed &= np.repeat(drawn[:, live], np.diff(starts), 1)
        gain = _score(low_g, low_h + how.ridge)
        gain += _score(total_g - low_g, high_h + how.ridge)
        gain -= _score(total_g, total_h + how.ridge)
        np.putmask(gain, ~allowed, -np.inf)
        best = gain.argmax(1)
        opened, pairs, parts = [], [], []
        for i, (node, r, m) in enumerate(active):
            won = 0.5 * float(gain[i, best[i]])
            if won <= how.gamma + 1e-12:
                ends.append((node, r))
                continue
            j = int(np.searchsorted(starts, best[i], "right")) - 1
            c, code = own[j], int(best[i] - starts[j])
            least_gain, least_child = min(least_gain, won), min(least_child, float(low_h[i, best[i]]), float(high_h[i, best[i]]))
            tree.feature[node], tree.threshold[node], tree.gain[node] = c, float(edges[c][code]), won
            tree.left[node], tree.right[node] = tree.add(), tree.add()
            under = codes[:, c].take(r) <= code
            n_under = int(np.count_nonzero(under[:m]))
            pairs.append(i)
            parts += [low[i, best[i]], whole[i] - low[i, best[i]]]
            opened += [(tree.left[node], r.take(np.flatnonzero(under)), n_under), (tree.right[node], r.take(np.flatnonzero(~under)), m - n_under)]
        active = opened
        if not active:
            break
    return tree, ends + [(node, r) for node, r, _ in active], least_gain, least_child


#: The parameters of each kind.
BOOSTED = {"trees": 200, "rate": 0.05, "depth": 4, "subsample": 0.8, "columns": 0.8, "gamma": 0.1, "child": 3.0, "seed": 42}
FOREST = {"trees": 200, "depth": 10, "leaf": 5, "split": 10, "seed": 42}
TREE = {"trees": 1, "depth": 10, "leaf": 5, "split": 10, "seed": 42}
DEFAULTS = {"boosted": BOOSTED, "forest": FOREST, "tree": TREE}


def chances(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


@dataclass
class Model:
    """kind: boosted, forest or tree; features: names, in order; senders: the categories, by code, or none; base: the first logit."""

    kind: str
    features: list[str]
    senders: list[str] | None
    trees: list[Tree]
    rate: float = 1.0
    base: float = 0.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            total += t.values(x)
        if self.kind == "boosted":
            return chances(self.base + self.rate * total)
        return total / max(1, len(self.trees))

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's share of all gains, the greatest first."""
        won = np.zeros(len(self.names()))
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    won[f] += gain
        return sorted(zip(self.names(), (won / max(won.sum(), 1e-300)).tolist(), strict=True), key=lambda x: (-x[1], x[0]))

    def names(self) -> list[str]:
        return [*self.features, *(["sender_type"] if self.senders is not None else [])]

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "trees": [t.__dict__ for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Model:
        made = json.loads(text)
        return Model(**{**made, "trees": [Tree(**t) for t in made["trees"]]})


def fit_boosted(x: np.ndarray | list[np.ndarray], y: np.ndarray, p: dict) -> list[Tree]:
    """Newton boosting of the logistic loss; positives weigh as much as negatives in all."""
    edges = edges_of(x)
    return boosted(Bins(codes_of(x, edges), edges), y, [p])[0][0]


class _Run:
    """Fits that have had equal trees so far: their places, trees and logits."""

    def __init__(self, places: list[int], trees: list[Tree], logit: np.ndarray):
        self.places, self.trees, self.logit = places, trees, logit


def boosted(bins: Bins, y: np.ndarray, fits: list[dict]) -> list[tuple[list[Tree], np.ndarray]]:
    """Trees and the logits of all rows, for each of the fits, which differ in gamma and child only. y: of the first rows, which are those that are learnt from;
    the rest is scored along with them.

    Fits with equal trees so far draw the same rows and columns, and a tree grown with the least gamma and child of them is that of each fit
    whose gamma and child its splits keep; so it's grown once, and the others go on by themselves."""
    n_rows, n_columns, base = len(y), bins.codes.shape[1], fits[0]
    rest, rng = np.arange(n_rows, len(bins.codes)), np.random.default_rng(base["seed"])
    weight = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1.0)
    runs = [_Run(list(range(len(fits))), [], np.zeros(len(bins.codes)))]
    for _ in range(base["trees"]):
        drawn = rng.random(n_rows) < base["subsample"] if base["subsample"] < 1 else np.ones(n_rows, bool)
        columns = np.sort(rng.permutation(n_columns)[: max(1, round(n_columns * base["columns"]))])
        rows, others = np.flatnonzero(drawn), np.concatenate([np.flatnonzero(~drawn), rest])
        after: list[_Run] = []
        for run in runs:
            chance = 1 / (1 + np.exp(-run.logit[:n_rows]))
            g, h = exact(weight * (chance - y)), exact(weight * chance * (1 - chance))
            places = run.places
            while places:
                gamma, child = min(fits[i]["gamma"] for i in places), min(fits[i]["child"] for i in places)
                how = Growth(depth=base["depth"], ridge=1.0, gamma=gamma, child=child)
                tree, ends, gain, least = grown(bins, g, h, how, columns, rng, rows, others)
                same = [i for i in places if (fits[i]["gamma"], fits[i]["child"]) == (gamma, child) or gain > fits[i]["gamma"] + 1e-12 and least >= fits[i]["child"]]
                if not same:  # none has both of the least values
                    same = places[:1]
                    how = Growth(depth=base["depth"], ridge=1.0, gamma=fits[same[0]]["gamma"], child=fits[same[0]]["child"])
                    tree, ends, *_ = grown(bins, g, h, how, columns, rng, rows, others)
                places = [i for i in places if i not in same]
                logit = run.logit.copy() if places else run.logit
                for node, r in ends:
                    logit[r] += base["rate"] * tree.value[node]
                after.append(_Run(same, [*run.trees, tree], logit))
        runs = after
    done: list = [None] * len(fits)
    for run in runs:
        for i in run.places:
            done[i] = (run.trees, run.logit)
    return done


def fit_bagged(x: np.ndarray | list[np.ndarray], y: np.ndarray, p: dict, numbers: Iterator[int], bagged: bool) -> list[Tree]:
    """Trees of balanced classes; of a forest, each on a bootstrap of the rows and sqrt(features) a node."""
    edges = edges_of(x)
    bins = Bins(codes_of(x, edges), edges)
    counts = np.maximum(np.bincount(y, minlength=2), 1)
    weight = exact((len(y) / (2 * counts))[y])
    how = Growth(depth=p["depth"], ridge=0.0, leaf=p["leaf"], split=p["split"], by_node=max(1, int(np.sqrt(len(edges)))) if bagged else None)
    trees = []
    for i in numbers:
        rng = np.random.default_rng([p["seed"], i])
        rows = rng.integers(0, len(y), len(y)) if bagged else np.arange(len(y))
        trees.append(grown(bins, -weight * y, weight, how, np.arange(len(edges)), rng, rows)[0])
    return trees


def fitted(kind: str, x: np.ndarray | list[np.ndarray], y: np.ndarray, p: dict, numbers: Iterator[int] | None = None) -> list[Tree]:
    return fit_boosted(x, y, p) if kind == "boosted" else fit_bagged(x, y, p, numbers if numbers is not None else range(p["trees"]), kind == "forest")


def auc(p: np.ndarray, y: np.ndarray) -> float | None:
    """Exactly, by pairs; ties count half. None without both classes."""
    if not 0 < y.sum() < len(y):
        return None
    order = np.sort(p[y == 0])
    below, up_to = np.searchsorted(order, p[y == 1], "left"), np.searchsorted(order, p[y == 1], "right")
    return float((below + up_to).sum() / 2 / len(order) / (y == 1).sum())


@contextlib.contextmanager
def kept_memory() -> Iterator[None]:
    """Meanwhile the C library keeps freed blocks of up to 32 MB for the next arrays; a fit's would else be mapped and faulted in anew each time. Without glibc: nothing."""
    try:
        libc = ctypes.CDLL(None)
        mallopt, trim = libc.mallopt, libc.malloc_trim
    except (OSError, AttributeError, TypeError):
        yield
        return
    mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
    mallopt(-1, 1 << 30)  # M_TRIM_THRESHOLD
    try:
        yield
    finally:
        mallopt(-1, 1 << 26)
        trim(0)


def spread(spark: SparkSession, jobs: list[dict], run, at_once: int = 64) -> list:
    """Runs jobs (JSON objects) as tasks of the cluster and gathers what they return, in their order."""
    frame = spark.createDataFrame([(i, json.dumps(j)) for i, j in enumerate(jobs)], "number long, job string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, job in zip(batch.column("number").to_pylist(), batch.column("job").to_pylist(), strict=True):
                with kept_memory():
                    done = json.dumps(run(json.loads(job)))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([done], pa.string())], ["number", "result"])

    found = frame.repartitionByRange(max(1, min(len(jobs), at_once)), "number").mapInArrow(work, "number long, result string").collect()
    return [json.loads(r.result) for r in sorted(found, key=lambda r: r.number)]


def scored(model: Model, df: DataFrame, columns: list[str]) -> DataFrame:
    """df with p; columns: the model's inputs, as numbers."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as its trees
    clean = df.drop("p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1) if batch.num_rows else np.zeros((0, len(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.probabilities(np.nan_to_num(x)))], [*batch.schema.names, "p"])

    return clean.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema) + ", p double")
