"""Exact substring dedup: words covered by a window of words that starts more than once are removed.

Every window of `window` consecutive words gets Rabin-Karp hashes: prefix sums over word hashes turn
each window into one subtraction and one product. Counting happens in Spark, in three shuffles:

1. A task gathers the windows of about CHUNK_WINDOWS windows of documents, the chunk. Hashes that
   occur more than once in the chunk are settled there, so each hash leaves a chunk once only and a
   passage that a third of all documents hold sends one entry a chunk. Entries go to buckets by a
   second, independent hash, as blobs of 7-byte hashes with their places in the chunk.
2. A bucket sorts its hashes; the places of those that came from two chunks or more return to their
   chunks, where marked windows merge into maximal removal intervals a document.
3. The intervals join the documents by a key of the row.

A bucket is the work of about BUCKET_BYTES of text, however large the input. Up to FAN buckets a chunk sends
a blob to each; where more are needed, blobs go to FAN coarse buckets first, and pieces of about PIECE_BYTES of one coarse bucket, each of
many chunks, are split into the final ones by bits of the hash: so blobs stay large at any size, at the cost of one more shuffle.

A hash has 56 bits and those of its coarse bucket's number, so at n windows about n**2 / 2**(57 + log2(buckets, FAN at most)) pairs
are taken for equal by chance: 1e-3 at a hundred million windows.

Cases: null and wordless texts have no words and lose none; texts shorter than the window lose none;
repeated rows repeat each other's windows (rows of one doc_id and text share their intervals; Spark's skew handling splits the join where they
are many); null doc_ids are kept; further columns aren't read; empty tables give no rows.
A repeated task must read its rows again in the same order: file scans do, and anything else is written to the shared folder first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.llm.common import U64, Block, blocks, mix, pack, plan_bytes, rolling, shuffle_partitions, slices, unpack, within, written

CHUNK_WINDOWS = 1 << 20
BUCKET_BYTES, PIECE_BYTES, FAN = 4 << 20, 64 << 20, 2048
_SECOND = 0xD6E8FEB86659FD93 | 5
_BUCKETS = "bucket int, kind byte, chunk long, blob binary, places binary"
_FINE = "bucket long, kind byte, chunk long, blob binary, places binary, owners binary"
_MARKS = "chunk long, kind byte, blob binary, places binary"
_SPANS = "k1 long, k2 int, spans binary"
_HASH = 7


def _chunk(number: int, gathered: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    one, two, windows, words, k1, k2 = (np.concatenate(x) for x in zip(*gathered, strict=True))
    order = np.argsort(one, kind="stable")
    ranked = one[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(one) + 1, bool)
    again[1:-1] = same
    repeated = again[1:].copy()  # equal to the next or to the one before
    repeated[1:] |= same
    repeated = repeated if len(one) else np.zeros(0, bool)
    leads = ~again[: len(one)]
    local = np.zeros(len(one), bool)
    local[order] = repeated
    sent = np.sort(order[leads])
    bucket = (two[sent] % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    by = np.argsort(bucket, kind="stable")
    sent, bucket = sent[by], bucket[by]
    edges = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=-1)) if len(sent) else np.zeros(0, int)
    short = one[sent].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH]
    rows: list[tuple] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = sent[a:b]
        settled = local[part]
        first = np.concatenate([np.flatnonzero(~settled), np.flatnonzero(settled)])  # those with an answer to come lead
        rows.append((int(bucket[a]), 0, number, short[a:b][first].tobytes(), pack(part[~settled])))
    about = np.concatenate([windows.astype("<i8"), words.astype("<i8"), k1.astype("<i8"), k2.astype("<i8")])
    rows.append((number % buckets, 1, number, about.tobytes(), pa.compress(np.packbits(local).tobytes(), codec="zstd", asbytes=True)))
    for at in range(0, len(rows), 512):
        yield _batch(rows[at : at + 512], [("bucket", pa.int32()), ("kind", pa.int8()), ("chunk", pa.int64()), ("blob", pa.binary()), ("places", pa.binary())])


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _windows(block: Block, window: int) -> tuple:
    words = np.diff(block.words().first)
    count = np.maximum(words - window + 1, 0)
    doc, place = within(count)
    start = block.first[:-1][doc] + place
    x = block.hashes()
    one, two = mix(rolling(x, start, start + window)), mix(rolling(x, start, start + window, _SECOND))
    return one, two, count, words, *(block.rows.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2"))


def _emit(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, gathered, size = TaskContext.get().partitionId() << 32, [], 0
        for block in blocks(batches, "text"):
            gathered.append(_windows(block, window))
            size += len(gathered[-1][0])
            if size >= CHUNK_WINDOWS:
                yield from _chunk(number, gathered, buckets)
                number, gathered, size = number + 1, [], 0
        if gathered:
            yield from _chunk(number, gathered, buckets)

    return run


_SETTLED = 0xFFFFFFFF


def _hashes(blobs: list[bytes]) -> np.ndarray:
    raw = b"".join(blobs)
    wide = np.zeros((len(raw) // _HASH, 8), np.uint8)
    wide[:, :_HASH] = np.frombuffer(raw, np.uint8).reshape(-1, _HASH)
    return wide.view("<u8").ravel()


def _squeeze(a: np.ndarray) -> bytes:
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _stretch(b: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _split(fine: int):
    """Deals the entries of one coarse bucket, from many chunks, to its final buckets; each entry keeps its chunk and place."""

    def run(group: pa.Table) -> pa.Table:
        kind, bucket = group["kind"].to_numpy(), group["bucket"].to_numpy().astype(np.int64)
        chunks, blobs, places = group["chunk"].to_numpy(), group["blob"].to_pylist(), group["places"].to_pylist()
        rows = [(int(bucket[i]) * fine, 1, int(chunks[i]), blobs[i], places[i], None) for i in np.flatnonzero(kind == 1)]
        own = np.flatnonzero(kind == 0)
        if len(own):
            x = _hashes([blobs[i] for i in own])
            counts = np.array([len(blobs[i]) // _HASH for i in own])
            owner = np.repeat(chunks[own], counts)
            place = np.full(len(x), _SETTLED, "<u4")
            for at, i in zip(np.cumsum(counts) - counts, own, strict=True):
                found = unpack(places[i])
                place[at : at + len(found)] = found
            to = ((x >> U64(20)) % U64(fine)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
            short = x.view(np.uint8).reshape(-1, 8)[:, :_HASH]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = order[a:b]
                rows.append((int(bucket[own[0]]) * fine + int(to[part[0]]), 0, -1, short[part].tobytes(), _squeeze(place[part]), _squeeze(owner[part].astype("<i8"))))
        fields = [("bucket", pa.int64()), ("kind", pa.int8()), ("chunk", pa.int64()), ("blob", pa.binary()), ("places", pa.binary()), ("owners", pa.binary())]
        return pa.Table.from_batches([_batch(rows, fields)])

    return run


def _settle(group: pa.Table) -> pa.Table:
    kind = group["kind"].to_numpy()
    chunks, blobs, places = group["chunk"].to_pylist(), group["blob"].to_pylist(), group["places"].to_pylist()
    owners = group["owners"].to_pylist() if "owners" in group.column_names else [None] * len(kind)
    out = [(chunks[i], 1, blobs[i], places[i]) for i in np.flatnonzero(kind == 1)]
    hashed = np.flatnonzero(kind == 0)
    if len(hashed):
        x = _hashes([blobs[i] for i in hashed])
        order = np.argsort(x, kind="stable")
        ranked = x[order]
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(len(x), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        at, of, spots = 0, [], []  # of entries of many chunks: chunk and place
        for i in hashed:
            n = len(blobs[i]) // _HASH
            if owners[i] is None:
                own = unpack(places[i])
                marked = own[hit[at : at + len(own)]]
                if len(marked):
                    out.append((chunks[i], 0, pack(marked), None))
            else:
                place = _stretch(places[i], "<u4")
                some = hit[at : at + n] & (place != _SETTLED)
                of.append(_stretch(owners[i], "<i8")[some])
                spots.append(place[some])
            at += n
        if of:
            of, spots = np.concatenate(of), np.concatenate(spots)
            order = np.lexsort((spots, of))
            of, spots = of[order], spots[order]
            edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else []
            out += [(int(of[a]), 0, pack(spots[a:b]), None) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.Table.from_batches([_batch(out, [("chunk", pa.int64()), ("kind", pa.int8()), ("blob", pa.binary()), ("places", pa.binary())])])


def _merge(window: int):
    def run(group: pa.Table) -> pa.Table:
        kinds, blobs = group["kind"].to_pylist(), group["blob"].to_pylist()
        at = kinds.index(1)
        windows, words, k1, k2 = np.frombuffer(blobs[at], "<i8").reshape(4, -1)
        total = int(windows.sum())
        packed = pa.decompress(group["places"][at].as_py(), decompressed_size=(total + 7) // 8, codec="zstd", asbytes=True) if total else b""
        marked = np.unpackbits(np.frombuffer(packed, np.uint8), count=total).astype(bool)
        for kind, blob in zip(kinds, blobs, strict=True):
            if not kind:
                marked[unpack(blob)] = True
        lead = np.cumsum(words) - words
        starts = np.flatnonzero(marked)
        doc = np.repeat(np.arange(len(windows)), windows)[starts]
        word = starts - (np.cumsum(windows) - windows)[doc] + lead[doc]
        steps = np.zeros(int(words.sum()) + window + 1, np.int32)
        steps[word] += 1
        steps[word + window] -= 1
        covered = np.cumsum(steps)[: int(words.sum())] > 0
        before = np.zeros(len(covered), bool)
        before[1:] = covered[:-1]
        has = lead[words > 0]
        before[has] = False
        after = np.zeros(len(covered), bool)
        after[:-1] = covered[1:]
        after[has[has > 0] - 1] = False
        a, b = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
        owner = np.searchsorted(lead, a, "right") - 1
        # wordless rows share their lead with the next row, which "right" skips to
        rows, edges = [], np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            d = owner[i]
            rows.append((int(k1[d]), int(k2[d]), (np.stack([a[i:j], b[i:j]], 1) - lead[d]).astype("<u4").tobytes()))
        return pa.Table.from_batches([_batch(rows, [("k1", pa.int64()), ("k2", pa.int32()), ("spans", pa.binary())])])

    return run


def _repeatable(docs: DataFrame) -> bool:
    """Whether the rows come from files (or the driver) with nothing but filters and projections between."""
    lines = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return all(line.lstrip(" :+-!").startswith(("Project", "Filter", "Relation", "LocalRelation")) for line in lines if line.strip())


def removal_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """k1, k2 (the row's key), spans (uint32 pairs: first word, word after the last) of rows that lose words."""
    spark = docs.sparkSession
    size = plan_bytes(docs) or docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = docs.select(*_key(), "text")
    buckets = max(4 * shuffle_partitions(spark), size // BUCKET_BYTES)
    coarse, fine = min(buckets, max(FAN, 4 * shuffle_partitions(spark))), 1
    sent = keyed.mapInArrow(_emit(window, coarse), _BUCKETS)
    if buckets > coarse:
        fine = -(-buckets // coarse)
        pieces = max(1, size // coarse // PIECE_BYTES)
        sent = sent.groupBy("bucket", F.pmod(F.xxhash64("chunk"), F.lit(pieces)).alias("piece")).applyInArrow(_split(fine), _FINE)
    marks = sent.groupBy("bucket").applyInArrow(_settle, _MARKS)
    spans = marks.groupBy("chunk").applyInArrow(_merge(window), _SPANS)
    return spans.dropDuplicates(["k1", "k2"])


def _key() -> list:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, n, removed, kept = batch.column("doc_id"), [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_py() or "").encode().split()
            n.append(len(words))
            if spans.is_valid:
                pairs, left, at = np.frombuffer(spans.as_py(), "<u4").reshape(-1, 2).tolist(), [], 0
                for a, b in pairs:
                    left += words[at:a]
                    at = b
                words = left + words[at:]
            removed.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by a space)."""
    docs = docs.select("doc_id", "text")
    docs = docs if _repeatable(docs) else written(docs, "texts")
    spans = removal_spans(docs, window)
    own = docs.select("doc_id", "text", *_key())
    joined = own.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept string")
