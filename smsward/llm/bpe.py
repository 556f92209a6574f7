"""Byte-level BPE by prefix-sharing trie traversal, and its inverse.

The encoding of every prefix of a word ends in one last token, and cutting that token off leaves the
encoding of a shorter prefix. So the distinct new words of a block go into a trie, and a depth-first walk
finds for each node the one token that ends there and agrees with the last token before it: prefixes that
words share are encoded once. Two tokens agree if merging their joined bytes gives just these two; the
answers are kept, up to PAIRS of them. Words found once are kept for the life of the Python worker, up to STORE bytes,
beyond which the store is emptied after the block that filled it and filled again; that costs time, never results.
So a worker's memory is bounded by STORE and by a block or the longest single text (about 100 bytes for each of its bytes).

Cases: null and empty texts have no ids and decode to the empty text; special tokens inside a text are
their own ids, as in the tokenizers library; repeated rows and null doc_ids are kept; further columns pass
through unread. Very long texts are handled in one piece, by one block.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from smsward.llm.common import slices

STORE, OVERHEAD = 96 << 20, 200
PAIRS = 300_000
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: For text of ASCII and Latin letters only, the same split by the standard library, which is faster.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t\n\v\f\r -~{_LATIN}]*")
_SPLIT_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_READY: dict[int, Codec] = {}


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes both begin with."""
    low, high = 0, min(len(a), len(b))
    while high - low > 8:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    while low < high and a[low] == b[low]:
        low += 1
    return low


def words_of(text: str) -> list[str]:
    return _SPLIT_PLAIN.findall(text) if _PLAIN.fullmatch(text) else _SPLIT.findall(text)


class Codec:
    """Encoder and decoder of a tokenizers file with a ByteLevel pre-tokenizer and a BPE model."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError("only byte-level BPE without normalizer, prefix space or dropout is supported")
        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        special = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("special tokens that take neighbouring text aren't supported")
        self.special = {t["content"]: t["id"] for t in special}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if special else None
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        #: The trie of all tokens read from their ends: the state after a state and a byte; of a state the one before, its token, if any,
        #: and (made when first asked for) the tokens that end there with their lengths, the longest first.
        self.steps: dict[int, int] = {}
        self.before, self.token_at = array("i", [0]), array("i", [-1])
        for token, i in self.ids.items():
            state = 0
            for byte in reversed(token):
                key = state << 8 | byte
                after = self.steps.get(key)
                if after is None:
                    after = self.steps[key] = len(self.token_at)
                    self.before.append(state)
                    self.token_at.append(-1)
                state = after
            self.token_at[state] = i
        self.ending: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.token_at)
        self.raw = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.four = {i: i.to_bytes(4, "little") for i in self.raw}
        self.merges: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # of a token: its rank, left and right part
        for rank, (a, b) in enumerate(merges):
            left, right = self.ids[raw(a)], self.ids[raw(b)]
            self.merges.setdefault((left, right), rank)
            self.made.setdefault(self.ids[raw(a) + raw(b)], (rank, left, right))
        self.edges: tuple[dict, dict] = {}, {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0  # bytes of the store, about

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The parts that stand at the token's right (or left) edge while it's merged, each with the rank that ends it."""
        known = self.edges[right]
        if token not in known:
            parts, part, until = [], token, 1 << 60
            while True:
                parts.append((part, until))
                if part not in self.made:
                    break
                until, *both = self.made[part]
                part = both[right]
            known[token] = parts
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens' joined bytes merge into just these two: no merge crosses the border while both its sides stand there."""
        for x, x_ends in self.edge(a, True):
            for y, y_ends in self.edge(b, False):
                rank = self.merges.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def alone(self, token: int) -> bool:
        """Whether the token's own bytes merge into it."""
        if token not in self.whole:
            _, a, b = self.made.get(token, (0, None, None))
            single = len(self.raw[token]) == 1
            self.whole[token] = single or a is not None and self.alone(a) and self.alone(b) and self._joins(a, b)
        return self.whole[token]

    def _joins(self, a: int, b: int) -> bool:
        """Whether the first merge over the border of a and b is of a and b themselves."""
        own = self.merges[a, b]
        return all((r := self.merges.get((x, y))) is None or (x, y) == (a, b) or not (r < x_ends and r <= y_ends) or r > own for x, x_ends in self.edge(a, True) for y, y_ends in self.edge(b, False))

    def ends(self, state: int) -> tuple[tuple[int, int], ...]:
        """Length and number of each token that ends where the state's bytes end, the longest first."""
        at, path = state, []
        while at:
            path.append(at)
            at = self.before[at]
        made = tuple((n, self.token_at[x]) for n, x in zip(range(len(path), 0, -1), path, strict=True) if self.token_at[x] >= 0)
        self.ending[state] = made
        return made

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Encodings of words, by one depth-first walk of the trie of all of them.

        The trie is held as its words in the order of their bytes, which is the order of a depth-first walk, and the
        depth at which each parts from the word before: what was found on the path down to there stands for both.
        """
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        made: dict[str, bytes] = {}
        step, ending, four, pairs = self.steps.get, self.ending, self.four, self.pairs
        last, cut = [-1], [0]  # of the prefix of each length on the path: last token, length without it
        before = b""
        for raw, word in sorted((w.encode(), w) for w in new):
            depth = _shared(before, raw)
            del last[depth + 1 :], cut[depth + 1 :]
            before = raw
            for depth in range(depth + 1, len(raw) + 1):
                state, start = 0, depth
                while start and (after := step(state << 8 | raw[start - 1])):
                    state = after
                    start -= 1
                for size, token in ending[state] or self.ends(state):
                    start = depth - size
                    if start:
                        pair = last[start] << 32 | token
                        fits = pairs.get(pair)
                        if fits is None:
                            fits = pairs[pair] = self.fits(last[start], token)
                    else:
                        fits = self.alone(token)
                    if fits:
                        last.append(token)
                        cut.append(start)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            chain, place = [], len(raw)
            while place:
                chain.append(four[last[place]])
                place = cut[place]
            made[word] = b"".join(reversed(chain))
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        pieces = [[p if p in self.special and i % 2 else words_of(p) for i, p in enumerate(self.cut.split(t) if self.cut else [t])] for t in texts]
        known = self.words
        new = set().union(*(p for text in pieces for p in text if isinstance(p, list))).difference(known)
        made = self.learn(new)
        known |= made
        self.held += sum(len(w) + len(x) + OVERHEAD for w, x in made.items())
        get = known.__getitem__
        out = [b"".join(self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(get, p)) for p in text) for text in pieces]
        if self.held > STORE:
            known.clear()
            self.held = 0
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def _pieces(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids (binary: little-endian uint32) and decoded (the ids' text).

    tokenizer: path of the tokenizer's JSON file; the driver reads it, executors get it by broadcast (its
    size is the vocabulary's).
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    shared, key = spark.sparkContext.broadcast(source), hash(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _READY.get(key) or _READY.setdefault(key, Codec(shared.value))
        for batch in slices(batches):
            at = 0
            for part in _pieces([x or "" for x in batch.column(text).to_pylist()]):
                ids = codec.encode(part)
                own = [batch.column(c).slice(at, len(part)) for c in keep]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())], [*keep, "n_tokens", "ids", "decoded"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long, ids binary, decoded string"
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
