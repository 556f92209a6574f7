"""Language of web pages by fusion of evidence.

Four pieces of evidence meet as log odds: the likelihood of the page's main text under n-gram models of
each language, the language its markup declares, the suffix of its address, and its host. How far a
declaration can be trusted, and what languages a suffix and a host hold, come from grouped sums of the
text-only posteriors over all pages; host counts are smoothed towards their suffix and these towards the whole
(SMOOTH pseudo-pages a level), and a page's own posterior is taken out of its prior.

Any number of languages may be labelled. The n-gram models learn from about SAMPLE distinct documents, by hash, shared out among
the languages, and at least one of each; models hold the n-grams that occur only, so their size is bounded by that of the sample's
texts, not by languages times buckets. Posteriors are kept where they are LEAST or more, so a page is a few
pairs however many languages there are. Host sums are partial before their shuffle, and the sums of the largest hosts
reach their pages by broadcast. What reaches the driver besides is a row for each language.

Cases: null or empty html, and html without text, leave the other evidence; null urls share the empty host; undeclared languages
are a value of their own; an element that isn't closed reaches to the end of the page; without labelled documents the language
is null; of ties the first language by name wins; repeated rows are judged each; further columns of the pages aren't read;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.llm.common import LETTERS, U64, blocks, join_groups, mix, slices, within, written
from smsward.llm.urls import host_and_path

BUCKETS = 1 << 15
SAMPLE = 4000
SMOOTH = 4.0
LEAST = 1e-9
FLOOR = 0.2
#: n-grams overlap, so their sum counts as at most so many independent ones.
WEIGHT = 40.0


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows; buckets of all n-grams (3 and 4 bytes, spaces and marks as one separator) and the row of each."""
    for block in blocks(batches, "text", lower=True):
        data = np.where(LETTERS[block.data], block.data, 32).astype(U64)
        found, rows = [], []
        doc = np.repeat(np.arange(len(block.offsets) - 1), np.diff(block.offsets))
        for n in (3, 4):
            size = len(data) - n + 1
            if size > 0:
                h = np.zeros(size, U64)
                for i in range(n):
                    h = (h << U64(8)) | data[i : size + i]
                inside = (doc[:size] == doc[n - 1 :]) & ((data[1 : size + 1] != 32) | (data[:size] != 32))
                found.append((mix(h[inside] + U64(n << 40)) % U64(BUCKETS)).astype(np.int64))
                rows.append(doc[:size][inside])
        yield block.rows, np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(rows) if rows else np.zeros(0, np.int64)


class Grams:
    """What each language says of an n-gram, beyond the floor that all n-grams have; entries lie by n-gram, then language."""

    def __init__(self, langs: list[str], keys: np.ndarray, counts: np.ndarray):
        """keys: n-gram * languages + language, ascending."""
        self.langs, k = langs, len(langs)
        self.lang = (keys % k).astype(np.int32)
        self.first = np.searchsorted(keys // k, np.arange(BUCKETS + 1))
        self.gain = np.log((counts + FLOOR) / FLOOR).astype(np.float32)
        self.base = np.log(FLOOR / (np.bincount(self.lang, counts, minlength=k) + FLOOR * BUCKETS))

    def likelihoods(self, rows: int, gram: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of each row and language, the mean log-likelihood of the row's n-grams."""
        k, n = len(self.langs), np.bincount(row, minlength=rows)
        total = np.zeros(rows * k)
        for at in range(0, len(gram), 1 << 17):
            g, r = gram[at : at + (1 << 17)], row[at : at + (1 << 17)]
            size = self.first[g + 1] - self.first[g]
            which, place = within(size)
            entry = self.first[g][which] + place
            total += np.bincount(r[which] * k + self.lang[entry], self.gain[entry], minlength=rows * k)
        return total.reshape(rows, k) / np.maximum(n, 1)[:, None] + self.base


def fit(docs: DataFrame, sample: int = SAMPLE) -> Grams | None:
    """None without labelled documents."""
    known = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)).alias("h"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).collect()
    if not counts:
        return None
    langs = sorted(r.lang for r in counts)
    limit = {r.lang: max(r.least + 1, int(min(1.0, sample / len(counts) / r.n) * (1 << 30))) for r in counts}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([h < limit[x] for x, h in zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True)], pa.bool_())).select(["lang", "text"])

    rows = known.mapInArrow(pick, "lang string, text string").distinct()  # copies combine before they move

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part, gram, row in _grams(batches):
            own = np.searchsorted(langs, part.column("lang").to_pylist())
            new, n = np.unique(gram * len(langs) + own[row], return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([np.stack([keys, counts]).astype("<i8").tobytes()], pa.binary())], ["counts"])

    parts = [np.frombuffer(bytes(r.counts), "<i8").reshape(2, -1) for r in rows.mapInArrow(count, "counts binary").toLocalIterator()]
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return Grams(langs, keys, np.bincount(place, np.concatenate([p[1] for p in parts]), minlength=len(keys)))


_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>)")
_ASIDE = frozenset("script style nav footer header aside head".split())
_ENTITY = re.compile(r"&#?\w{1,10};")


def main_text(html: str) -> str:
    """Text of the article or main element where there is one, else of the page; without boilerplate elements and tags.

    One pass: within boilerplate only its end is looked for, so any page takes time linear in its length."""
    inner: list[str] = []
    outer: list[str] = []
    at, inside, low = 0, None, html.lower()
    while (m := _TAG.search(html, at)) is not None:
        (outer if inside is None else inner).append(html[at : m.start()])
        if m[1]:
            end = html.find("-->", m.end())
            at = end + 3 if end >= 0 else len(html)
            continue
        at, name = m.end(), m[3].lower()
        if m[2]:
            inside = None if name == inside else inside
        elif name in _ASIDE or name == "div" and 'class="ad"' in m[4]:
            end = low.find(f"</{name}", at)
            close = low.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(html)
        elif inside is None and name in ("article", "main"):
            inside = name
    (outer if inside is None else inner).append(html[at:])
    text = " ".join(inner)
    return _ENTITY.sub(" ", text if text.strip() else " ".join(outer))


def _dense(column: pa.ListArray, rows: int, k: int, value: str) -> np.ndarray:
    """Lists of pairs of a language and a value, as a row of values each."""
    out = np.zeros((rows, k))
    pairs = column.flatten()
    size = np.diff(np.asarray(column.offsets))
    out[np.repeat(np.arange(rows), size), pairs.field("lang").to_numpy(zero_copy_only=False)] = pairs.field(value).to_numpy(zero_copy_only=False)
    return out


_PAIRS = "array<struct<lang: int, score: double, post: double>>"


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang (by the text alone), declared, host of each page."""
    model = fit(docs)
    html = F.col("html").cast("string")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^<>]*?\blang\s*+=\s*+[\"']?([a-z]{2,3})", 1))
    host, path = host_and_path(F.col("url"))
    suffix = F.concat(F.regexp_extract(host, r"[^.]*$", 0), F.lit("/"), F.regexp_extract(path, r"^/([a-z]{2})(?:/|$)", 1))
    own = pages.select("page_id", F.coalesce(declared, F.lit("")).alias("declared"), host.alias("host"), suffix.alias("suffix"), html.alias("html"))
    if model is None:
        none = F.lit(None).cast("string")
        return own.select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", "host")
    langs, k = model.langs, len(model.langs)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # as many entries as the sample has n-grams, at most

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (pa.RecordBatch.from_arrays([*b.drop_columns(["html"]).columns, pa.array([main_text(x or "") for x in b.column("html").to_pylist()], pa.string())], ["page_id", "declared", "host", "suffix", "text"]) for b in slices(batches, 200))
        for rows, gram, row in _grams(texts):
            n = np.bincount(row, minlength=rows.num_rows)
            score = shared.value.likelihoods(rows.num_rows, gram, row) * np.minimum(n, WEIGHT)[:, None]
            score -= score.max(1, keepdims=True)
            post = np.exp(score)
            post /= post.sum(1, keepdims=True)
            doc, lang = np.nonzero((post >= LEAST) & (n > 0)[:, None])
            pairs = pa.StructArray.from_arrays([pa.array(lang, pa.int32()), pa.array(score[doc, lang]), pa.array(post[doc, lang])], ["lang", "score", "post"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("page_id", "declared", "host", "suffix")), lists], ["page_id", "declared", "host", "suffix", "own"])

    seen = written(own.mapInArrow(evidence, f"page_id long, declared string, host string, suffix string, own {_PAIRS}"), "evidence")
    # a pair of language -1 counts the page itself
    each = F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("lang"), F.lit(1.0).alias("post"))), F.transform("own", lambda x: F.struct(x["lang"].alias("lang"), x["post"].alias("post"))))).alias("p")

    def grouped(sums: DataFrame, what: str, *keys: str) -> DataFrame:
        pair = F.when(F.col("lang") >= 0, F.struct("lang", "post"))
        return written(sums.groupBy(*keys).agg(F.collect_list(pair).alias(f"in_{what}"), F.max(F.when(F.col("lang") < 0, F.col("post"))).cast("long").alias("n")), what)

    add = lambda df, *keys: df.groupBy(*keys, "lang").agg(F.sum("post").alias("post"))
    by_host = written(add(seen.select("host", "suffix", each).select("host", "suffix", "p.*"), "host", "suffix"), "hosts")
    by_suffix = written(add(by_host, "suffix"), "suffixes")
    by_claim = add(seen.select("declared", each).select("declared", "p.*"), "declared")
    world = np.ones(k)
    for r in add(by_suffix.filter("lang >= 0")).collect():
        world[r.lang] += r.post
    world = world / world.sum()
    joined = join_groups(seen, grouped(by_host, "host", "host", "suffix"), ["host", "suffix"])
    joined = join_groups(joined, grouped(by_suffix, "suffix", "suffix"), ["suffix"])
    joined = join_groups(joined, grouped(by_claim, "claim", "declared"), ["declared"])

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, step = np.array(langs), max(1, (1 << 20) // k)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                n = rows.num_rows
                post, score = _dense(rows.column("own"), n, k, "post"), _dense(rows.column("own"), n, k, "score")
                has = post.any(1)[:, None]
                score = np.where(has & (post == 0), np.log(LEAST), score)
                others = {c: np.maximum(_dense(rows.column(f"in_{c}"), n, k, "post") - post, 0.0) for c in ("host", "suffix", "claim")}
                share = lambda counts, up: (counts + SMOOTH * up) / (counts + SMOOTH * up).sum(1, keepdims=True)
                by_host, by_claim = share(others["host"], share(others["suffix"], world)), share(others["claim"], world)
                says = np.array([bool(x) for x in rows.column("declared").to_pylist()], bool)[:, None]
                logit = score + np.log(by_host) + np.where(says, np.log(by_claim) - np.log(world), 0.0)
                norm = np.exp(logit - logit.max(1, keepdims=True)).sum(1)
                text = [x if h else None for x, h in zip(names[post.argmax(1)].tolist(), has[:, 0], strict=True)]
                new = [pa.array(names[logit.argmax(1)].tolist(), pa.string()), pa.array(np.round(1 / norm, 6)), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), *new, rows.column("declared"), rows.column("host")], ["page_id", "lang", "confidence", "text_lang", "declared", "host"])

    needed = joined.select("page_id", "declared", "host", "own", "in_host", "in_suffix", "in_claim")
    return needed.mapInArrow(fuse, "page_id long, lang string, confidence double, text_lang string, declared string, host string")
