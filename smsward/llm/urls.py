"""URL rules by a sort-merge range join.

A host becomes a key with its labels reversed, so that a rule's host and all its subdomains are the keys
of one interval; intervals of rules nest or are apart. URLs are dealt to parts by ranges of their keys (and, within
a key, of a hash of the row, so that one host may hold any share of all rows). A rule goes to the part where its
interval begins, and to each part that begins inside it; the latter are the few rules whose hosts lie on the path
from a part's first key to the root. Within a part URLs and rules are sorted together by key, rules first, and one
sweep keeps the stack of rules whose interval holds the present key; of these the longest whose path starts the URL's
path wins. No side is broadcast: what all tasks get is the parts' first keys, of CUT characters at most, drawn from a
sample of PER_PART keys a part, in expectation.

Cases: null urls and urls without `://` have empty host and path and fit no rule whose host isn't empty;
the method's verdict where no rule fits is `default`; rules that are repeated count once, a block before
an allow; null rules are ignored; very long urls are handled whole; repeated rows are judged each; further columns
pass through, but for those named host, path, rule and verdict, which are replaced; empty tables give no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsward.llm.common import plan_bytes, shuffle_partitions

PART_BYTES = 64 << 20
PER_PART = 40
CUT = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.when(has, F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by a character below all that labels hold."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "\x01"), F.lit("\x01"))


class Sweep:
    """Takes rules and asks for keys in ascending order; the stack holds the rules whose interval holds the key."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, str]]] = []

    def add(self, key: str, path: str, verdict: str) -> None:
        self._leave(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        self.stack[-1][1][path] = verdict

    def rule(self, key: str, path: str) -> tuple[str | None, str | None]:
        self._leave(key)
        best = None
        for start, own in self.stack:
            host = ".".join(reversed(start[:-1].split("\x01")))
            # of rules of one host the longest path wins: a few paths are tried each, of many the beginnings of the url's
            fit = [p for p in own if path.startswith(p)] if len(own) <= 8 else [p for n in range(len(path) + 1) if (p := path[:n]) in own]
            for p in fit:
                if best is None or len(host) + len(p) > best[0]:
                    best = len(host) + len(p), host + p, own[p]
        return best[1:] if best else (None, None)

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()


def _cuts(keyed: DataFrame, parts: int) -> list[tuple[str, int]]:
    """First key and hash of each part but the first, from a sample by hash of the rows."""
    rows = keyed.count()
    share = min(1.0, parts * PER_PART / max(rows, 1))
    picked = keyed.filter(F.pmod(F.xxhash64("_deal", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    held = sorted((r.k, r.d) for r in picked.select(F.substring("_key", 1, CUT).alias("k"), F.col("_deal").alias("d")).toLocalIterator())
    return sorted({held[i * len(held) // parts] for i in range(1, parts)}) if held else []


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages, then host, path, rule (host and path of the rule that wins, or null) and verdict."""
    host, path = host_and_path(F.col(url))
    parts = max(shuffle_partitions(pages.sparkSession), plan_bytes(pages) // PART_BYTES)
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    columns = [f for f in pages.schema if f.name not in ("_key", "_deal", "_part", "_kind")]
    keyed = pages.select(*(f"`{f.name}`" for f in columns)).withColumns({"_key": host_key(F.col("host")), "_deal": F.xxhash64(*(f"`{f.name}`" for f in columns if f.name not in ("host", "path") and "map<" not in f.dataType.simpleString()))})
    cuts = pages.sparkSession.sparkContext.broadcast(_cuts(keyed, parts))  # parts times CUT characters at most
    rules = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("_verdict")).select(F.col("path").alias("_path"), "_verdict", host_key(F.col("host")).alias("_key"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(cuts.value, x) for x in zip(batch.column("_key").to_pylist(), batch.column("_deal").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_deal"]).columns, pa.array(at, pa.int32())], [*(n for n in batch.schema.names if n != "_deal"), "_part"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, at = [], []
            for i, key in enumerate(batch.column("_key").to_pylist()):
                j = bisect.bisect_left(cuts.value, (key,))
                took.append(i)
                at.append(j)
                while j < len(cuts.value) and cuts.value[j][0].startswith(key):  # each cut up to here lies inside the rule's interval
                    j += 1
                    took.append(i)
                    at.append(j)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(took, pa.int64())).columns, pa.array(at, pa.int32())], [*batch.schema.names, "_part"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    dealt = keyed.mapInArrow(place, f"{kinds}, _key string, _part int").withColumn("_kind", F.lit(1))
    sent = rules.mapInArrow(spread, "_path string, _verdict string, _key string, _part int").withColumn("_kind", F.lit(0))
    both = dealt.unionByName(sent, allowMissingColumns=True).repartitionByRange(parts, "_part").sortWithinPartitions("_part", "_key", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, now = Sweep(), None
        for batch in batches:
            urls, won = [], []
            for i, (part, kind, key, path, rule, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_part", "_kind", "_key", "path", "_path", "_verdict")), strict=True)):
                if part != now:
                    sweep, now = Sweep(), part
                if kind:
                    urls.append(i)
                    won.append(sweep.rule(key, path))
                else:
                    sweep.add(key, rule, verdict)
            own = batch.select([f.name for f in columns]).take(pa.array(urls, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([r for r, _ in won], pa.string()), pa.array([v or default for _, v in won], pa.string())], [*own.schema.names, "rule", "verdict"])

    return both.mapInArrow(run, f"{kinds}, rule string, verdict string")
