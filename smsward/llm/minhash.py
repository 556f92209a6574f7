"""Near-duplicate groups by ProbMinHash over weighted word shingles.

1. Equal texts form a class, known by a 64-bit hash (two different texts of n share one with a chance of
   about n**2 / 2**65); all further work is on classes.
2. A class's shingles of five words, weighted by their counts, are sketched by ProbMinHash: each shingle's
   points arrive as a Poisson process of its weight, each point falls on one of REGISTERS registers, and a
   process ends when its next point comes later than every register's earliest. Two registers agree with the
   probability Jaccard similarity of the weights. Bands of ROWS registers make candidates.
   A class with repeated shingles has bands of a second sketch too, without counts; where none repeats, both are the same.
3. Members of a band's bucket point to the bucket's least member; components of these pointers are the
   coarse groups, which hold all candidate pairs without listing them.
4. Within a coarse group, links are verified on the shingles themselves: texts are linked if their probability Jaccard or
   their plain Jaccard similarity is at least `threshold`. Components of links are the groups. A group of up to BLOCK
   members and SHINGLES shingles is one task's work. Of a larger one, random blocks of that size are verified first; a block's components
   are then known by a central member each, and these are verified among themselves the same way, until they fit a block or
   no longer get fewer. What that leaves outside the group's largest component, mostly little, is at last compared with all members of
   other components, so no link is lost, and a large family of near copies costs as much a member as a small one.
   Only a large coarse group that falls into many components costs the product of its size and of what lies outside the largest.

Cases: null texts are empty texts; equal texts are always one group, empty ones too; texts under five words
are one shingle; texts without letters or digits match equal texts only; repeated rows share a group; a
group's id is its least doc_id (null if all are null); further columns aren't read; long texts are taken whole; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.llm.common import LETTERS, U64, blocks, join_groups, mix, rolling, within, written
from smsward.llm.components import components

SHINGLE = 5
ROWS, BANDS = 6, 24
REGISTERS = ROWS * BANDS
BLOCK, SHINGLES = 1536, 2_000_000
ROUNDS = 8
_HASH_BITS = 52


def shingles(batches: Iterator[pa.RecordBatch], size: int = SHINGLE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows; and of each distinct shingle of a row: the row, a hash of 52 bits, the count. Rows and hashes ascend."""
    for block in blocks(batches, "text", lower=True):
        for at in range(0, block.rows.num_rows, 1 << (64 - _HASH_BITS)):
            part = block.rows.slice(at, 1 << (64 - _HASH_BITS))
            a, b = block.offsets[at], block.offsets[at + part.num_rows]
            own = type(block)(part, block.data[a:b], block.offsets[at : at + part.num_rows + 1] - a).words(LETTERS)
            words = np.diff(own.first)
            doc, place = within(np.where(words > 0, np.maximum(words - size + 1, 1), 0))
            start = own.first[:-1][doc] + place
            h = mix(rolling(own.hashes(), start, np.minimum(start + size, own.first[1:][doc])))
            key = np.sort((doc.astype(U64) << U64(_HASH_BITS)) | (h >> U64(64 - _HASH_BITS)))
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            count = np.diff(np.append(edge, len(key)))
            key = key[edge]
            yield part, (key >> U64(_HASH_BITS)).astype(np.int64), key & U64((1 << _HASH_BITS) - 1), count


def sketch(rows: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures: for each row, the shingle that came first on each register."""
    first = np.full(rows * registers, np.inf)
    owner = np.zeros(rows * registers, U64)
    limit = np.full(rows, np.inf)
    x, w, t, step = mix(shingle + U64(1)), weight.astype(float), np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        r = mix(x + U64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        t = t - np.log1p(-(r >> U64(11)).astype(float) * 2.0**-53) / w
        live = t < limit[doc]
        if not live.all():
            doc, x, w, t, r = doc[live], x[live], w[live], t[live], r[live]
        slot = doc * registers + ((mix(r ^ U64(0x5851F42D4C957F2D)) >> U64(32)) * U64(registers) >> U64(32)).astype(np.int64)
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        owner[slot[won]] = x[won]
        limit = first.reshape(rows, registers).max(1)
        live = t < limit[doc]
        doc, x, w, t = doc[live], x[live], w[live], t[live]
    return owner.reshape(rows, registers)


def _band_hashes(sketches: np.ndarray) -> np.ndarray:
    s = sketches.reshape(len(sketches), BANDS, ROWS)
    h = np.zeros((len(s), BANDS), U64)
    for i in range(ROWS):
        h = mix(h * U64(0x9E3779B97F4A7C15) + s[:, :, i] + U64(i + 1))
    return h


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, doc, shingle, count in shingles(batches):
        rows = part.num_rows
        size = np.bincount(doc, minlength=rows)
        has = size > 0
        repeats = np.bincount(doc, count > 1, minlength=rows) > 0
        own = np.repeat(np.arange(rows), has * (1 + repeats))
        h = np.zeros((len(own), BANDS), U64)
        second = np.concatenate([[False], own[1:] == own[:-1]]) if len(own) else np.zeros(0, bool)
        h[~second] = _band_hashes(sketch(rows, doc, shingle, count))[has]
        if repeats.any():
            some = repeats[doc]
            place = np.cumsum(repeats) - 1
            h[second] = _band_hashes(sketch(int(repeats.sum()), place[doc[some]], shingle[some], np.ones(int(some.sum()))))
        offsets = np.concatenate([[0], np.cumsum(has * (1 + repeats) * BANDS)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column("class"), part.column("doc_id"), lists, pa.array(size, pa.int64())], ["class", "doc_id", "bands", "size"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and counts of each class; rows that hold the same class again are left out."""
    done: set[int] = set()

    def fresh() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [not (c in done or done.add(c)) for c in batch.column("class").to_pylist()]
            yield batch.filter(pa.array(new, pa.bool_()))

    for part, doc, shingle, count in shingles(fresh()):
        edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
        ids = (mix(shingle) >> U64(32)).astype("<u4")
        blobs = [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        counts = [count[a:b].astype("<u4").tobytes() if (count[a:b] > 1).any() else b"" for a, b in zip(edges[:-1], edges[1:], strict=True)]
        keys = [part.column(c) for c in ("bin", "coarse", "class", "size")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["bin", "coarse", "class", "size", "ids", "counts"])


_SETS = "bin long, coarse long, class long, size long, ids binary, counts binary"


def probability_jaccard(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray) -> float:
    """Of two weighted sets, exactly: the sum over shared elements of 1 / sum of max(a'/a, b'/b) over all elements."""
    ids = np.union1d(ids_a, ids_b)
    p, q = np.zeros(len(ids)), np.zeros(len(ids))
    np.add.at(p, np.searchsorted(ids, ids_a), a)
    np.add.at(q, np.searchsorted(ids, ids_b), b)
    with np.errstate(divide="ignore"):
        ratio = q / p
    order = np.argsort(ratio)
    p, q, ratio = p[order], q[order], ratio[order]
    below, above = np.cumsum(p), np.sum(q) - np.cumsum(q)
    both = (p > 0) & (q > 0)
    return float(np.sum(1 / ((below[both] + above[both] / ratio[both]) / p[both])))


def linked_groups(sets: list[np.ndarray], counts: list[np.ndarray | None], threshold: float) -> np.ndarray:
    """For each set, the number of its component's first member; links are tested exactly.

    From a set, all sets that aren't reached yet are tested at once, by marking its elements; sets whose
    elements are common in the group go first, as they reach most of it.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    total = np.bincount(flat)
    lead = np.cumsum(sizes) - sizes
    share = np.concatenate([(np.ones(len(s)) if c is None else c) / (len(s) if c is None else c.sum()) for s, c in zip(sets, counts, strict=True)])
    plain = np.array([c is None for c in counts])
    central = np.add.reduceat(total[flat], lead) / sizes
    group = np.full(n, -1)
    mark, weigh = np.zeros(len(total), np.int32), np.zeros(len(total))
    left, left_flat, left_share, left_lead = np.arange(n), flat, share, lead
    for seed in np.argsort(-central, kind="stable"):
        if group[seed] >= 0:
            continue
        group[seed] = seed
        queue = [(-central[seed], seed)]
        while queue:
            _, i = heapq.heappop(queue)
            own = flat[lead[i] : lead[i] + sizes[i]]
            open_ = group[left] < 0
            if open_.sum() < len(left) // 2:
                keep = np.repeat(open_, sizes[left])
                left, left_flat, left_share = left[open_], left_flat[keep], left_share[keep]
                left_lead = np.cumsum(sizes[left]) - sizes[left]
                open_ = np.ones(len(left), bool)
            if not len(left):
                break
            mark[own] = 1
            shared = np.add.reduceat(mark[left_flat], left_lead)
            near = shared >= threshold * (sizes[i] + sizes[left] - shared)
            unsure = open_ & ~near & ~(plain[i] & plain[left])
            if unsure.any():
                weigh[own] = share[lead[i] : lead[i] + sizes[i]]
                least = np.add.reduceat(np.minimum(weigh[left_flat], left_share), left_lead)
                weigh[own] = 0
                for k in np.flatnonzero(unsure & (least >= threshold)):
                    j = left[k]
                    other = slice(lead[j], lead[j] + sizes[j])
                    near[k] = probability_jaccard(own, share[lead[i] : lead[i] + sizes[i]], flat[other], share[other]) >= threshold
            mark[own] = 0
            for j in left[near & open_]:
                group[j] = seed
                heapq.heappush(queue, (-central[j], j))
    return group


def _sets(group: pa.Table, rows: list[int]) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    ids, counts = group["ids"].take(pa.array(rows)).to_pylist(), group["counts"].take(pa.array(rows)).to_pylist()
    return [np.frombuffer(x, "<u4") for x in ids], [np.frombuffer(x, "<u4") if x else None for x in counts]


def _verify(threshold: float):
    """Of each member of each coarse group: class (a) and the central member of its component (b)."""

    def run(group: pa.Table) -> pa.Table:
        cls, coarse = group["class"].to_numpy(), group["coarse"].to_numpy()
        cls, kept = np.unique(cls, return_index=True)
        coarse = coarse[kept]
        order = np.argsort(coarse, kind="stable")
        a, b, c = [], [], []
        for part in np.split(order, np.flatnonzero(np.diff(coarse[order])) + 1):
            found = linked_groups(*_sets(group, kept[part].tolist()), threshold) if len(part) > 1 else np.zeros(len(part), int)
            own = cls[part]
            a += own.tolist()
            b += own[found].tolist()
            c += coarse[part].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["a", "b", "coarse"])

    return run


def _cross(threshold: float):
    """Links between the rest (outer) and the members of other components, as pairs of components' labels."""

    def run(group: pa.Table) -> pa.Table:
        outer, label = group["outer"].to_numpy(zero_copy_only=False).astype(bool), group["label"].to_numpy()
        found: set[tuple[int, int]] = set()
        rest, all_ = np.flatnonzero(outer), np.flatnonzero(~outer)
        if len(rest) and len(all_):
            sets, counts = _sets(group, all_.tolist())
            sizes = np.array([len(x) for x in sets])
            lead = np.cumsum(sizes) - sizes
            known, flat = np.unique(np.concatenate(sets), return_inverse=True)
            share = np.concatenate([(np.ones(len(x)) if c is None else c) / (len(x) if c is None else c.sum()) for x, c in zip(sets, counts, strict=True)])
            plain = np.array([c is None for c in counts])
            mark, weigh = np.zeros(len(known), np.int32), np.zeros(len(known))
            for i, own, weight in zip(rest, *_sets(group, rest.tolist()), strict=True):
                p = np.ones(len(own)) if weight is None else weight.astype(float)
                p /= p.sum()
                at = np.searchsorted(known, own)
                held = known[np.minimum(at, len(known) - 1)] == own
                at = at[held]
                mark[at] = 1
                shared = np.add.reduceat(mark[flat], lead)
                mark[at] = 0
                other = label[all_] != label[i]
                near = shared >= threshold * (len(own) + sizes - shared)
                unsure = other & ~near & ~(plain & (weight is None))
                if unsure.any():
                    weigh[at] = p[held]
                    least = np.add.reduceat(np.minimum(weigh[flat], share), lead)  # probability Jaccard is at most that
                    weigh[at] = 0
                    for j in np.flatnonzero(unsure & (least >= threshold)):
                        near[j] = probability_jaccard(own, p, sets[j], share[lead[j] : lead[j] + sizes[j]]) >= threshold
                found |= {(min(int(label[i]), int(label[all_[j]])), max(int(label[i]), int(label[all_[j]]))) for j in np.flatnonzero(near & other)}
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _parts(members: DataFrame) -> DataFrame:
    """members (coarse, size, ...) with parts: how many blocks their coarse group needs."""
    sizes = members.groupBy("coarse").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / SHINGLES)).cast("int").alias("parts"))
    return join_groups(members, written(sizes, "sizes"), ["coarse"])


def _large_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the members of large coarse groups, each a table of sets, into their components."""
    links, now, before = None, sets, None
    for turn in range(ROUNDS):
        dealt = now.select("coarse", "class", "size").transform(_parts).withColumn("block", F.pmod(F.xxhash64("class", F.lit(turn)), "parts").cast("int"))
        most = dealt.agg(F.max("parts").alias("m"), F.count("*").alias("n")).first()
        if turn and (not most.n or before is not None and most.n > 0.8 * before):
            break  # blocks no longer find much: the comparison below is the rest
        blocks_ = now.join(dealt.select("class", "block"), "class").select("block", "coarse", "class", "ids", "counts")
        found = written(blocks_.groupBy("coarse", "block").applyInArrow(_verify(threshold), "a long, b long, coarse long"), "links")
        links = found.select("a", "b") if links is None else links.union(found.select("a", "b"))
        before = most.n
        if most.m <= 1:
            break
        now = now.join(found.select(F.col("b").alias("class")).distinct(), "class", "left_semi")
    pairs = written(links.filter("a <> b").distinct(), "pairs")
    own = components(pairs).select(F.col("node").alias("class"), F.col("root").alias("label"))
    labelled = written(sets.select("coarse", "class", "size").join(own, "class", "left").withColumn("label", F.coalesce("label", "class")), "labelled")
    sizes = labelled.groupBy("coarse", "label").agg(F.sum("size").alias("size"))
    top = sizes.groupBy("coarse").agg(F.max_by("label", F.struct("size", "label")).alias("top"), F.count("*").alias("labels"))
    open_ = written(top.filter("labels > 1"), "open")  # groups that fell into several components
    if not open_.limit(1).count():
        return pairs
    counts = written(labelled.join(open_, "coarse").groupBy("coarse").agg(F.count("*").alias("n"), F.first("top").alias("top"), F.sum((F.col("label") != F.col("top")).cast("long")).alias("u"), F.sum("size").alias("all"), F.sum(F.when(F.col("label") != F.col("top"), F.col("size")).otherwise(0)).alias("rest")), "counts")
    blocks_of = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / SHINGLES)).cast("int")
    held = join_groups(labelled, counts.select("coarse", "n", "top", blocks_of("n", "all").alias("mb"), blocks_of("u", "rest").alias("ub")), ["coarse"])
    held = held.withColumns({"m": F.pmod(F.xxhash64("class", F.lit(91)), "mb").cast("int"), "u": F.pmod(F.xxhash64("class", F.lit(92)), "ub").cast("int")})
    is_member = held.select("coarse", "class", "label", F.lit(False).alias("outer"), "m", F.explode(F.sequence(F.lit(0), F.col("ub") - 1)).alias("u"))
    is_rest = held.filter("label <> top").select("coarse", "class", "label", F.lit(True).alias("outer"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), "u")
    tasks = is_member.union(is_rest).join(sets.select("class", "ids", "counts"), "class")
    more = tasks.groupBy("coarse", "m", "u").applyInArrow(_cross(threshold), "a long, b long")
    return written(pairs.union(more).distinct(), "pairs")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Of each document: doc_id, class (the text's hash), group_id (least doc_id of its group)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("class", F.xxhash64("text"))
    banded = docs.mapInArrow(_bands, "class long, doc_id long, bands array<long>, size long")
    classes = written(banded.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.count("*").alias("n")), "classes")
    held = classes.select("class", F.posexplode("bands").alias("band", "h")).withColumn("band", F.col("band") % BANDS)
    least = written(held.groupBy("band", "h").agg(F.min("class").alias("b"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    pointers = join_groups(held, least, ["band", "h"]).filter("class <> b").select(F.col("class").alias("a"), "b").distinct()
    coarse = components(pointers)
    members = coarse.select(F.col("node").alias("class"), F.col("root").alias("coarse")).join(classes.select("class", F.col("doc_id").alias("least_id"), "size"), "class")
    members = written(_parts(members), "members")
    total = members.agg(F.max("parts").alias("parts"), F.sum(F.when(F.col("parts") <= 1, F.col("size"))).alias("size"), F.count("*").alias("n")).first()
    bins = max(1, (total.size or 0) // SHINGLES, (total.n or 0) // BLOCK)
    members = members.withColumn("bin", F.when(F.col("parts") <= 1, F.pmod(F.xxhash64("coarse", F.lit(7)), F.lit(bins))).otherwise(-1))
    texts = docs.join(members.select("class", "least_id", "coarse", "size", "bin").withColumnRenamed("class", "_c").hint("shuffle_hash"), (docs["class"] == F.col("_c")) & docs["doc_id"].eqNullSafe(F.col("least_id")))
    sets = texts.select("bin", "coarse", "class", "size", "text").mapInArrow(_members, _SETS)
    verify = _verify(threshold)
    if (total.parts or 0) > 1:
        sets = written(sets, "sets")
        small = sets.filter("bin >= 0").groupBy("bin").applyInArrow(verify, "a long, b long, coarse long")
        links = small.select("a", "b").union(_large_links(sets.filter("bin < 0").dropDuplicates(["class"]), threshold))
        roots = components(written(links, "links"))
    else:
        links = written(sets.groupBy("bin").applyInArrow(verify, "a long, b long, coarse long"), "links")
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    grouped = written(classes.select("class", "doc_id", "n").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), "grouped")
    named = written(grouped.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("classes")), "named")
    of_class = written(join_groups(grouped.select("class", "n", "root"), named, ["root"], "classes").select("class", "n", "group_id"), "groups")
    return join_groups(docs.select("doc_id", "class"), of_class, ["class"]).select("doc_id", "class", "group_id")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose doc_id is their group's; of rows with the same doc_id and text, one."""
    groups = near_duplicates(docs, threshold)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("doc_id", "class").agg(F.count("*").alias("_rows"))
    kept = written(kept, "kept")
    keyed = docs.withColumn("_class", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = kept.select(F.col("class").alias("_class"), F.col("doc_id").alias("_id"), "_rows")
    stay = keyed.join(own.hint("shuffle_hash"), (keyed["_class"] == own["_class"]) & keyed["doc_id"].eqNullSafe(own["_id"])).select(*docs.columns, "_rows")
    if not kept.filter("_rows > 1").limit(1).count():
        return stay.drop("_rows")
    return stay.drop("_rows").dropDuplicates(["doc_id", "text"])
