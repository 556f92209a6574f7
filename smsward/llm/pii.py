"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns (email, ip, card, phone) give base spans, which always stay. Around digits and at-signs a
semi-Markov CRF labels whole segments: features of the entire candidate (its shape, digits, checksum, the
word before it) score it as a kind, and a dynamic program over segments of at most LONGEST atoms of the kind (spaces
count in numbers, but not in addresses, where each dot may be a word) and LETTERS characters picks the boundaries
and kinds of a region together. Segments that it finds, that touch no base span and that lead
by MARGIN are added, as written differently: a phone number without its plus, `name at host dot com`.

Training is numpy-free gradient ascent of the conditional likelihood, by forward-backward over candidate
segments, on at most REGIONS regions, by hash, of at most SAMPLE distinct texts with their base spans for labels, and on
rewritten forms of these (MASKS). Its result is a table of some hundred weights.

Cases: null and empty texts have no spans; very long texts are searched whole, region by region, and a region of any
length in time linear in it; repeated rows and null doc_ids are kept; further columns pass through unread, but for those
named as the new ones, which are replaced; tables without a digit or at-sign train on our own examples only.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 1000
REGIONS = 2000
LONGEST = {"email": 30, "ip": 14, "card": 14, "phone": 14}
LETTERS = 254
MARGIN = 1.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\s")
_AT, _DOT = re.compile(r"@| at |\[at\]|\(at\)"), re.compile(r"\.| dot |\[dot\]|\(dot\)")
_ON, _BACK = re.compile(r"(?:\.| dot |\[dot\]|\(dot\))\w"), re.compile(r"\w(?:\.| dot |\[dot\]|\(dot\))\Z")
_DIGITS, _NUMERIC = frozenset("0123456789"), frozenset("0123456789+(")
_SEED = re.compile(r"[0-9@]|(?<=[a-z0-9\])] )at(?= [a-z0-9])|\[at\]|\(at\)|(?<=[A-Za-z0-9] )dot(?= [A-Za-z0-9])|\[dot\]|\(dot\)")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As the pattern's leftmost matches, but in time linear in the text: back from each at-sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Region:
    """Atoms of a stretch of text."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.atoms = [m.span() for m in _ATOM.finditer(text, start, end)]

    def segments(self) -> Iterator[tuple[int, int, str, list[str]]]:
        """Each candidate segment, by its first atom: first atom, after the last, kind, features."""
        text, atoms, kinds = self.text, self.atoms, KINDS[1:]
        n, far = len(atoms), max(LONGEST[k] for k in kinds)
        stop = atoms[-1][1] if n else 0
        closes = [text[b - 1].isalnum() for _, b in atoms]
        spaces = [text[a].isspace() for a, _ in atoms]
        addressed = n and _AT.search(text, atoms[0][0], stop)
        for i, (a, _) in enumerate(atoms):
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            end = min(stop, a + LETTERS)  # no entity goes beyond, so a long stretch costs as much a letter as a short one
            line = text.find("\n", a, end)
            # an address holds one at-sign and a dot: it ends from `least` on, before `most`
            ats = [m.end() for m in itertools.islice(_AT.finditer(text, a, end), 2)] if addressed else []
            dot = _DOT.search(text, a, end) if ats else None
            least, most = (max(ats[0], dot.end()), ats[1] if len(ats) > 1 else end + 1) if dot else (end + 1, end + 1)
            plain = 0
            for j in range(i + 1, n + 1):
                b = atoms[j - 1][1]
                plain += not spaces[j - 1]
                near = j - i <= far
                if 0 <= line < b or b > end or not near and (plain > LONGEST["email"] or least > end or b >= most):
                    break
                if closes[j - 1]:
                    if least <= b < most and plain <= LONGEST["email"] and (f := _features(text, a, b, "email")):
                        yield i, j, "email", f
                    for kind in kinds if near and text[a] in _NUMERIC and text[b - 1] in _DIGITS else ():
                        if j - i <= LONGEST[kind] and (f := _features(text, a, b, kind)):
                            yield i, j, kind, f

    @property
    def candidates(self) -> dict[tuple[int, int, str], list[str]]:
        return {(i, j, kind): f for i, j, kind, f in self.segments()}


def _features(text: str, a: int, b: int, kind: str) -> list[str]:
    """Names of the binary features of text[a:b] as this kind; none where it can't be one."""
    s = text[a:b]
    digits = re.sub("[^0-9]", "", s)
    glued = a > 0 and (text[a - 1].isalnum() or text[a - 1] in "@_") or b < len(text) and (text[b].isalnum() or text[b] in "@_")
    letters = any(c.isalpha() for c in s)
    own = []
    if kind == "email":
        ats, dots = len(_AT.findall(s)), len(_DOT.findall(s))
        if not letters or ats != 1 or not dots:
            return []
        odd = re.sub(r"[\w.%+@-]| at | dot |\[at\]|\[dot\]|\(at\)|\(dot\)", "", s)
        own = ["sign" if "@" in s else "spelled at", f"odd {min(len(odd), 2)}", f"dots {min(dots, 3)}", f"words {min(len(s.split()), 6)}", "cut" if _ON.match(text, b) or _BACK.search(text, max(0, a - 8), a) else "whole"]
    elif kind == "ip":
        groups = re.split(r"\.| dot |\[\.\]", s)
        if letters and " dot " not in s or len(groups) != 4 or not all(g.isdigit() and g.isascii() for g in groups):
            return []
        own = ["bytes" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "large parts"]
    elif letters or len(digits) < 7:
        return []
    elif kind == "card":
        if not 12 <= len(digits) <= 19 or "(" in s or "+" in s:
            return []
        groups = re.split("[^0-9]+", s)
        own = ["luhn" if luhn(digits) else "no luhn", f"digits {len(digits)}", "fours" if {*map(len, groups[:-1])} == {4} else f"groups {min(len(groups), 4)}", "dotted" if "." in s else ""]
    else:
        if len(digits) > 15 or re.search(r"[^0-9+().\x20-]", s):
            return []
        groups = re.split("[^0-9]+", s.strip("+("))
        own = [f"opens {s[0] if s[0] in '+(' else '0'}", f"digits {len(digits)}", f"groups {min(len(groups), 5)}", "balanced" if s.count("(") == s.count(")") else "unbalanced", "dotted quad" if len(s.split(".")) == 4 else "", "luhn" if len(digits) > 13 and luhn(digits) else ""]
    word = re.search(r"(\w+)\W{0,3}$", text[max(0, a - 24) : a])
    own += ["glued" if glued else "free", f"after {word[1].lower()[:8]}" if word and word[1].isalpha() else "", "bias"]
    return [f"{kind}: {x}" for x in own if x]


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


class SegmentCRF:
    """Weights of features; an atom outside any segment scores 0."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def climb(self, n: int, candidates: dict[tuple[int, int, str], list[str]], gold: set[tuple[int, int, str]], rate: float) -> None:
        """One step up the likelihood of the gold segments, by forward and backward sums over the segmentations of n atoms."""
        scores = {c: self.score(f) for c, f in candidates.items()}
        ending, starting = defaultdict(list), defaultdict(list)
        for c, s in scores.items():
            ending[c[1]].append((c, s))
            starting[c[0]].append((c, s))
        ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _logsum([ahead[j - 1], *(ahead[c[0]] + s for c, s in ending[j])])
        for i in range(n - 1, -1, -1):
            back[i] = _logsum([back[i + 1], *(back[c[1]] + s for c, s in starting[i])])
        for c, s in scores.items():
            push = (c in gold) - math.exp(ahead[c[0]] + s + back[c[1]] - ahead[n])
            if abs(push) > 1e-4:
                for f in candidates[c]:
                    self.weights[f] += rate * push

    def best(self, region: Region) -> list[tuple[int, int, str, float]]:
        """The best segmentation's segments, each with its score. Candidates are scored as they come and not kept."""
        n = len(region.atoms)
        top, via = [-math.inf] * (n + 1), [None] * (n + 1)
        top[0], reached = 0.0, 0  # places up to `reached` are settled

        def settle(until: int) -> None:
            nonlocal reached
            for k in range(reached + 1, until + 1):
                if top[k - 1] >= top[k]:
                    top[k], via[k] = top[k - 1], None
            reached = max(reached, until)

        for i, j, kind, f in region.segments():
            settle(i)
            value = top[i] + (s := self.score(f))
            if value > top[j]:
                top[j], via[j] = value, (i, kind, s)
        settle(n)
        found, j = [], n
        while j:
            if via[j]:
                i, kind, s = via[j]
                found.append((i, j, kind, s))
                j = i
            else:
                j -= 1
        return found[::-1]


def regions(text: str, around: int = 40) -> Iterator[Region]:
    """Stretches with seeds, each widened by some characters: seeds that are near each other are never parted."""
    start = end = None
    for m in _SEED.finditer(text):
        if start is None or m.start() > end + 2 * around:
            if start is not None:
                yield Region(text, max(0, start - around), min(len(text), end + around))
            start = m.start()
        end = m.end()
    if start is not None:
        yield Region(text, max(0, start - around), min(len(text), end + around))


def _national(s: str, mark: str) -> str:
    """A phone number without its country's prefix, its groups joined by the mark."""
    return mark.join(re.findall("[0-9]+", re.sub(r"^\+[0-9]{1,2}(?=[^0-9])", "", s)))


#: Rewritten forms of base spans that the field learns beside the plain ones.
MASKS = {
    "phone": [
        lambda s: re.sub(r"^\+[0-9]{1,2} ?", "", s), lambda s: s.replace("+", ""), lambda s: re.sub("[() -]+", ".", s.lstrip("+")).strip("."),
        lambda s: _national(s, " "), lambda s: _national(s, "-"), lambda s: _national(s, "."),
    ],
    "email": [lambda s: s.replace("@", " at ").replace(".", " dot "), lambda s: s.replace("@", "(at)"), lambda s: s.replace("@", " at "), lambda s: s.replace("@", "[at]").replace(".", "[dot]")],
    "card": [lambda s: ".".join(re.findall("[0-9]{1,4}", s)), lambda s: " ".join(re.findall("[0-9]{1,4}", s))],
    "ip": [lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", " dot ")],
}


def examples(text: str) -> Iterator[tuple[str, list[Span]]]:
    """Short regions of a text with the base spans in them; of those without a span every second, by hash."""
    spans = base_spans(text)
    for r in regions(text):
        if not r.atoms:
            continue
        a, b = r.atoms[0][0], r.atoms[-1][1]
        own = [(x - a, y - a, k) for x, y, k in spans if a <= x and y <= b]
        if b - a < 400 and (own or _hash(text[a:b])[0] & 1):
            yield text[a:b], own


def _hash(piece: str) -> bytes:
    return hashlib.blake2b(piece.encode(errors="surrogatepass")).digest()


def train(drawn: list[tuple[str, list[Span]]], rounds: int = 6) -> SegmentCRF:
    """Learns from examples, from our own, and from the rewritten forms of both."""
    made = [("email", f"jo.{i}@mail{i}.example.org") for i in range(6)] + [("ip", f"10.{i}.7.{2 * i}") for i in range(6)] + [("phone", f"+1 (20{i}) 555-010{i}") for i in range(6)] + [("card", x) for x in ("4111111111111111", "5500005555555559", "340000000000009")]
    made += [("email", x) for x in ("bob@example.org", "ana@site.net", "li.wei@post.example.com", "kim_k@mail.example.org", "sam-o@web.example.net", "joe@corp.example.com")]
    seen = [(f"see {s} there", [(4, 4 + len(s), k)]) for k, s in made] + drawn
    for text, spans in list(seen):
        for a, b, kind in spans[:1]:
            for form in MASKS[kind]:
                new = form(text[a:b])
                seen.append((text[:a] + new + text[b:], [(a, a + len(new), kind)]))
    work = []
    for text, spans in seen:
        r = Region(text, 0, len(text))
        spot = {x: i for i, (x, _) in enumerate(r.atoms)}, {y: i + 1 for i, (_, y) in enumerate(r.atoms)}
        gold = {(spot[0][a], spot[1][b], k) for a, b, k in spans if a in spot[0] and b in spot[1]}
        if held := r.candidates:
            work.append((len(r.atoms), held, gold & set(held)))
    field, rng = SegmentCRF(), random.Random(7)
    for i in range(rounds):
        rng.shuffle(work)
        for n, held, gold in work:
            field.climb(n, held, gold, 0.3 / (1 + i))
    field.weights = dict(field.weights)
    return field


def find(text: str, field: SegmentCRF) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by start, then kind."""
    base = base_spans(text)
    extra: list[Span] = []
    if _SEED.search(text):
        starts, ends = [], []  # what the base spans cover, as stretches apart
        for a, b, _ in sorted(base):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for r in regions(text):
            for i, j, kind, score in field.best(r):
                a, b = r.atoms[i][0], r.atoms[j - 1][1]
                k = bisect.bisect_right(ends, a)  # the first stretch that ends after a
                if score > MARGIN and (k == len(starts) or starts[k] >= b):
                    extra.append((a, b, kind))
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def write(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one, by the first's kind."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def fit(docs: DataFrame, seed: int = 5) -> SegmentCRF:
    """Trains on at most REGIONS regions of at most SAMPLE distinct texts, in expectation, that hold a digit or an at-sign.

    Texts are chosen by their hash and copies of one are combined before they move; only regions, of under 400
    characters each, reach the driver, the first by hash of all of them.
    """
    marked = docs.filter(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text", F.lit(seed)).alias("h"))
    share = min(1.0, SAMPLE / max(1, marked.agg(F.approx_count_distinct("h")).first()[0]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(piece, write(spans)) for t in batch.column("text").to_pylist() for piece, spans in examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["piece", "spans"])

    texts = marked.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    pieces = texts.select("text").mapInArrow(cut, "piece string, spans string").distinct()
    rows = pieces.orderBy(F.xxhash64("piece", F.lit(seed)), "piece").limit(REGIONS).collect()
    return train([(r.piece, _read(r.spans)) for r in rows])


def _read(spans: str) -> list[Span]:
    return [(int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def find_spans(docs: DataFrame, field: SegmentCRF | None = None) -> DataFrame:
    """All columns of docs, then base and spans (kind:start:end, comma-joined), n_<kind> of base, and redacted."""
    field = field or fit(docs)
    weights = field.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SegmentCRF()
        model.weights = weights
        for batch in slices(batches):
            rows = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base, spans = find(text, model)
                counts = [sum(k == kind for *_, k in base) for kind in KINDS]
                rows.append((write(base), write(spans), *counts, redact(text, spans) if spans else t.as_py()))
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
            new = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *_NEW])

    clash = [c for c in docs.columns if c in _NEW]
    docs = docs.drop(*clash)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", pii_base string, pii_spans string, n_email long, n_ip long, n_card long, n_phone long, redacted string"
    return docs.mapInArrow(run, schema)


_NEW = ["pii_base", "pii_spans", "n_email", "n_ip", "n_card", "n_phone", "redacted"]
