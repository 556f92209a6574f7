"""Benchmark decontamination by spaced seeds.

A seed mask selects some positions of a span of words and ignores the others, so a substituted word at an
ignored position leaves the seed's hash as it was. Hashes of all masks at all words of the benchmark and of
the training texts are joined; each hit fixes an alignment of a text and an item, and the alignment is
verified word by word: any segment of LEAST words or more, or of a whole shorter item, with at least SAME of
its words equal counts. A match scores 1 - SAME and a substitution -SAME, so a segment qualifies just if its sum
isn't negative, and the best of all segments of that length tells whether there is one.

The masks lose nothing: any segment of 12 words or more with four fifths equal holds a hit of one of MASKS, and so does an item of 5
to 11 words, all of it aligned, with SHORT (the tests enumerate the substitutions). Items under five words count where they are all of a text.

Training hashes that occur in no item stay in their task: up to MAX_KEYS benchmark hashes (8 bytes each) all tasks get the hashes
themselves; beyond, a bitmap of 2**WIDE bits of them, whose size is fixed, and what passes it is joined by shuffle, with the same results.
Copies of one text, however many, are verified once.

Cases: null, empty and wordless texts are clean; case and punctuation don't count; equal items are one, reported by their least item_id
and their number; repeated rows are reported each; null doc_ids are kept; a passage that several items share is reported for each; further
columns of documents pass through keep_clean; long texts are searched whole, and a repetitive one keeps as many alignments as it has words, at
most; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.llm.common import LETTERS, U64, blocks, join_groups, mix, written

#: 1: the word counts, 0: it may differ. For items of LEAST words or more, and for those of 5 to 11.
MASKS = ("11111", "110111")
SHORT = ("1111", "10111", "11011", "11101")
FEW = 5
LEAST, SAME = 12, 0.8
MAX_KEYS, MAX_CLASSES = 1 << 21, 1 << 20
NARROW, WIDE = 20, 28
_WHOLE = U64(0xA0761D6478BD642F)


def seed_hashes(x: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each word where its span fits into x."""
    n = max(0, len(x) - len(mask) + 1)
    total = np.full(n, int(mix(np.array([int(mask, 2)], U64))[0]), U64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total += x[i : i + n] * U64((0x9E3779B97F4A7C15 * (2 * i + 3) & (1 << 64) - 1) | 1)
    return total ^ (total >> U64(29))


def _whole(x: np.ndarray) -> np.ndarray:
    """The hash of a text of a few words as a whole."""
    return seed_hashes(x, "1" * len(x)) ^ _WHOLE


def _masks_of(n: int) -> tuple[str, ...]:
    return MASKS if n >= LEAST else SHORT if n >= FEW else ()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", lower=True):
        x = block.words(LETTERS).hashes()
        keys, places, words = [], [], []
        for a, b in zip(block.first[:-1], block.first[1:], strict=True):
            own = x[a:b]
            found = [_whole(own)] if 0 < b - a < FEW else [seed_hashes(own, m) for m in _masks_of(b - a)] or [x[:0]]
            keys.append(np.concatenate(found).view(np.int64).tolist())
            places.append(np.concatenate([np.arange(len(f)) for f in found]).tolist())
            words.append((own >> U64(32)).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([block.rows.column("item"), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(words, pa.binary())], ["item", "keys", "places", "words"])


class Known:
    """Which hashes the benchmark may hold: a bitmap of their first bits, and where they're few, all of them."""

    def __init__(self, bits: int, bitmap: np.ndarray, keys: np.ndarray | None):
        self.bits, self.bitmap, self.keys = bits, bitmap, keys

    def places(self, h: np.ndarray) -> np.ndarray:
        spot = (h >> U64(64 - self.bits)).astype(np.int64)
        at = np.flatnonzero(self.bitmap[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
        if self.keys is None or not len(at):
            return at
        near = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        return at[self.keys[near] == h[at]]


def known_hashes(keys: DataFrame, count: int) -> Known:
    """keys: key. Beyond MAX_KEYS the bitmap is put together by the executors, 4 KB a piece."""
    if count <= MAX_KEYS:
        own = np.sort(np.array([r.key for r in keys.select("key").distinct().toLocalIterator()], np.int64).view(U64))
        spot = np.unique((own >> U64(64 - NARROW)).astype(np.int64))
        return Known(NARROW, np.packbits(np.isin(np.arange(1 << NARROW), spot), bitorder="little"), own)
    spot = keys.select((F.shiftrightunsigned("key", 64 - WIDE) + 1).alias("s"))
    pieces = spot.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    bitmap = np.zeros(1 << (WIDE - 3), np.uint8)
    for r in pieces.toLocalIterator():
        own = np.frombuffer(bytes(r.bits), np.uint8)
        bitmap[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(own)] = own
    return Known(WIDE, bitmap, None)


def _hits(masks: tuple[str, ...], few: bool, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Known = shared.value
        for block in blocks(batches, "text", lower=True):
            x = block.words(LETTERS).hashes()
            first = block.first
            at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
            for mask in masks:
                h = seed_hashes(x, mask)
                place = known.places(h)
                if len(place):
                    place = place[place + len(mask) <= first[np.searchsorted(first, place, "right")]]
                at.append(place)
                hashes.append(h[place])
            for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < FEW)) if few else ():
                h = _whole(x[first[d] : first[d + 1]])
                if len(known.places(h)):
                    at.append(first[d : d + 1])
                    hashes.append(h)
            at, hashes = np.concatenate(at), np.concatenate(hashes)
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            order = np.argsort(doc, kind="stable")
            at, hashes, doc = at[order], hashes[order], doc[order]
            rows, edges = np.unique(doc, return_index=True)
            edges = np.append(edges, len(doc)).astype(np.int32)
            words = [(x[first[d] : first[d + 1]] >> U64(32)).astype("<u4").tobytes() for d in rows]
            own = block.rows.take(pa.array(rows))
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(v)) for v in (hashes.view(np.int64), (at - first[doc]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("class"), *lists, pa.array(words, pa.binary())], ["doc_id", "class", "keys", "places", "words"])

    return run


def best_segment(doc: np.ndarray, item: np.ndarray, shift: int, least: int, part: float) -> tuple[int, int, int] | None:
    """Of the alignment item[i] ~ doc[i + shift]: first item word, length and equal words of the best segment of at
    least `least` words; none where no such segment has the part of its words equal."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b - a < least:
        return None
    same = item[a:b] == doc[a + shift : b + shift]
    total = np.round(np.concatenate([[0.0], np.cumsum(same - part)]), 6)
    gain = total[least:] - np.minimum.accumulate(total[: len(total) - least])
    end = int(np.argmax(np.round(gain, 6))) + least
    start = int(np.argmin(total[: end - least + 1]))
    return (a + start, end - start, int(same[start:end].sum())) if gain[end - least] > -1e-5 else None


def _verify(least: int, part: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cls, item, shifts, own, other in zip(*(batch.column(c).to_pylist() for c in ("class", "item", "shifts", "words", "item_words")), strict=True):
                doc, it = np.frombuffer(own, "<u4"), np.frombuffer(other, "<u4")
                found = max(((equal, -n, s, start) for s in shifts if (best := best_segment(doc, it, s, min(least, len(it)), part)) for start, n, equal in [best]), default=None)
                if found:
                    equal, n, s, start = found
                    rows.append((cls, item, -n, equal, start + s, start))
            kinds = [("class", pa.int64()), ("item", pa.int64()), ("n_words", pa.int32()), ("n_equal", pa.int32()), ("doc_start", pa.int32()), ("item_start", pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return run


_FOUND = "class long, item long, n_words int, n_equal int, doc_start int, item_start int"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, same: float = SAME) -> DataFrame:
    """Of each document and item that share a passage: doc_id, class (hash of the text), item_id (the least of equal items), n_items (how
    many they are), n_words and n_equal of the best aligned segment, doc_start and item_start (its first words)."""
    spark = docs.sparkSession
    bench = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item", F.xxhash64("text"))
    ids = bench.groupBy("item").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    items = written(bench.dropDuplicates(["item"]).select("item", "text").mapInArrow(_items, "item long, keys array<long>, places array<int>, words binary"), "items")
    keys = items.select("item", F.explode(F.arrays_zip("keys", "places")).alias("k")).select("item", F.col("k.keys").alias("key"), F.col("k.places").alias("item_place"))
    count = keys.count()
    if not count:
        return spark.createDataFrame([], "doc_id long, class long, item_id long, n_items long, n_words int, n_equal int, doc_start int, item_start int")
    size = F.octet_length("words") / 4
    has = items.agg(F.max((size >= LEAST).cast("int")).alias("long"), F.max(((size >= FEW) & (size < LEAST)).cast("int")).alias("short"), F.max(((size > 0) & (size < FEW)).cast("int")).alias("few")).first()
    shared = spark.sparkContext.broadcast(known_hashes(keys, count))  # at most MAX_KEYS hashes, or 2 ** WIDE bits
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("class", F.xxhash64("text"))
    hits = own.mapInArrow(_hits((MASKS if has.long else ()) + (SHORT if has.short else ()), bool(has.few), shared), "doc_id long, class long, keys array<long>, places array<int>, words binary")
    hits = written(hits, "hits")
    texts = hits.dropDuplicates(["class"])
    near = F.broadcast if count <= MAX_KEYS else (lambda df: df)
    met = texts.select("class", F.explode(F.arrays_zip("keys", "places")).alias("k")).select("class", F.col("k.keys").alias("key"), F.col("k.places").alias("place"))
    pairs = met.join(near(keys), "key").select("class", "item", (F.col("place") - F.col("item_place")).alias("shift")).groupBy("class", "item").agg(F.collect_set("shift").alias("shifts"))
    full = pairs.join(texts.select("class", "words"), "class").join(near(items.select("item", F.col("words").alias("item_words"))), "item")
    found = full.mapInArrow(_verify(least, same), _FOUND).join(near(ids), "item")
    per = F.collect_list(F.struct("item_id", "n_items", "n_words", "n_equal", "doc_start", "item_start")).alias("found")
    of_class = written(found.groupBy("class").agg(per), "found")
    counted = hits.groupBy("class").agg(F.count("*").alias("n")).join(of_class, "class")
    return join_groups(hits.select("doc_id", "class"), written(counted, "counted"), ["class"]).select("doc_id", "class", F.explode("found").alias("f")).select("doc_id", "class", "f.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text shares no passage with the benchmark."""
    found = written(contaminated(docs, benchmark).select(F.col("class").alias("_class")).distinct(), "dirty")
    found = F.broadcast(found) if found.count() <= MAX_CLASSES else found
    return docs.withColumn("_class", F.xxhash64(F.coalesce("text", F.lit("")))).join(found, "_class", "left_anti").select(*docs.columns)
