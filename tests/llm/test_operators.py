"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import itertools
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from smsward.llm import bpe, common, decontaminate, imatch, language, minhash, pii, quality, substrings, toxicity, urls
from smsward.llm.components import components

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "tu", "ra", "so") for b in ("n", "r", "st", "la", "mo", "k")]
DOCS = "doc_id long, text string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 8, 60, 90, 120, 400, 2500)]
    near = base[4].split()
    near[50] = "other"
    shared = sentence(rng, 50)
    more = [base[3], " ".join(near), base[2] + "\n" + shared, shared + " " + base[1], "!!! ???", "x" * 30000, "Ünï çødé \t tabs\n\nlines  " + shared]
    rows = [(i, t) for i, t in enumerate(base + more)] + [(100, None), (101, ""), (None, base[2]), (102, " \n\t "), (3, base[3])]
    return rows


def frame(spark, rows):
    """With extra columns whose names an operator might use itself."""
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], DOCS + ", spans string, `class` long").repartition(3)


def test_minhash(spark, texts, monkeypatch):
    got = collections.defaultdict(set)
    rows = minhash.near_duplicates(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got[r.group_id].add(r.doc_id)
    assert {3, 7} in got.values() and {4, 8} in got.values() and {100, 101} in got.values()
    rng = random.Random(2)
    base = sentence(rng, 150).split()
    many = [(i, " ".join(w if rng.random() > 0.02 else f"z{rng.randrange(99)}" for w in base)) for i in range(40)] + [(50 + i, sentence(rng, 60)) for i in range(20)]
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in many}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    for block in (1536, 8):  # in one task, and as pairs of blocks
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(many, DOCS)).collect()} == {k: find(k) for k in sets}
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = minhash.keep_one(frame(spark, texts))
    assert kept.count() == len({r.group_id for r in rows}) and kept.columns == frame(spark, texts).columns


def test_minhash_of_texts_that_differ_in_repeats(spark):
    """Plain Jaccard 1 or nearly, probability Jaccard far below: a line repeats in one text only, in both, and with a word changed."""
    rng = random.Random(11)
    rows, pairs = [], []
    for i in range(12):
        line, rest = sentence(rng, 14) + f" mark{i}", sentence(rng, 90)
        rows += [(10 * i, f"{line} {line} {rest}"), (10 * i + 1, " ".join([line] * 50) + " " + rest), (10 * i + 2, " ".join([line] * 9) + " " + rest + " more")]
        pairs.append({10 * i, 10 * i + 1, 10 * i + 2})
    got = collections.defaultdict(set)
    for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect():
        got[r.group_id].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, pairs))


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    ids = np.arange(400, dtype=np.uint64)
    a, b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    s = minhash.sketch(2, np.repeat([0, 1], 300), np.concatenate([ids[:300], ids[100:]]), np.concatenate([a, b]), registers=4000)
    exact = minhash.probability_jaccard(ids[:300], a / a.sum(), ids[100:], b / b.sum())
    p, q = dict(zip(ids[:300], a / a.sum())), dict(zip(ids[100:], b / b.sum()))
    brute = sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in ids) for d in ids if d in p and d in q)
    assert exact == pytest.approx(brute) and (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.04)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[i] for i in (100, 101, 102)}) == 1 and got[0] != got[100]


@pytest.mark.parametrize("two_levels", [False, True])
def test_substrings(spark, texts, monkeypatch, two_levels):
    monkeypatch.setattr(substrings, "CHUNK_WINDOWS", 300)  # several chunks a task
    if two_levels:
        for name, value in (("FAN", 1), ("BUCKET_BYTES", 500), ("PIECE_BYTES", 200)):
            monkeypatch.setattr(substrings, name, value)
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    count = collections.Counter(tuple(w[i : i + 35]) for _, w in docs for i in range(len(w) - 34))
    want = []
    for k, w in docs:
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((str(k), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substrings.remove_repeats(frame(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_decontamination(spark, texts):
    rng = random.Random(9)
    items = [(i, sentence(rng, 40)) for i in range(5)] + [(9, "one two three four five six"), (10, "so mi"), (11, None)]
    swapped = items[1][1].split()
    swapped[7] = swapped[19] = swapped[30] = "changed"
    planted = [(500, "start " + items[0][1] + " end"), (501, " ".join(swapped)), (502, "ZERO, One two three; four five SIX seven"), (503, items[2][1][:30])]
    docs, bench = frame(spark, texts + planted), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(500, 0), (501, 1), (502, 9)}
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.count() == len(texts) + 1 and clean.columns == docs.columns
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_contamination_of_substituted_passages(spark):
    """Any aligned segment counts, also where a shorter one scores higher; against all segments of all alignments."""
    rng = random.Random(3)
    items = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (5, 6, 7, 9, 10, 11, 12, 13, 15, 15, 17, 20, 25, 30, 45)]
    docs = []
    for it in items:
        for part in (0.1, 0.15, 0.2, 0.25):
            docs += [[f"f{rng.randrange(99)}" for _ in range(rng.randrange(4))] + [w if rng.random() >= part else "changed" for w in it] + ["end"] for _ in range(8)]
    docs.append([w if i not in (5, 11) else "changed" for i, w in enumerate(items[8])])
    want = set()
    for d, doc in enumerate(docs):
        for i, it in enumerate(items):
            for s in range(-len(it) + 1, len(doc)):
                same = [0 <= k + s < len(doc) and doc[k + s] == w for k, w in enumerate(it)]
                a, b = max(0, -s), min(len(it), len(doc) - s)
                if any(5 * sum(same[x:y]) >= 4 * (y - x) for x in range(a, b) for y in range(x + min(12, len(it)), b + 1)):
                    want.add((d, i))
    made = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], DOCS)
    found = decontaminate.contaminated(made, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    assert (len(docs) - 1, 8) in want and {(r.doc_id, r.item_id) for r in found} == want
    assert all(5 * r.n_equal >= 4 * r.n_words and r.n_words >= min(12, len(items[r.item_id])) for r in found)


def test_masks_lose_no_segment():
    """Whichever words are substituted, at most a fifth: some mask finds the rest."""
    for n in range(5, 23):
        masks = decontaminate._masks_of(n)
        for gone in itertools.combinations(range(n), n // 5):
            same = [i not in gone for i in range(n)]
            assert any(all(same[p + q] for q, c in enumerate(m) if c == "1") for m in masks for p in range(n - len(m) + 1)), (n, gone)


def test_contamination_of_few_words_and_copies(spark):
    """Items under five words count where they are all of a text; equal items are reported once, with their number."""
    items = [(1, "Yes, indeed"), (2, "yes indeed"), (3, "no"), (4, "of the four words"), (5, "of the four words"), (6, ""), (None, "NO!")]
    docs = [(1, "yes... INDEED"), (2, "yes indeed it is"), (3, "no"), (3, "no"), (4, "no no"), (None, "of the four words"), (5, "one of the four words"), (6, None)]
    for most in (decontaminate.MAX_KEYS, 0):
        old, decontaminate.MAX_KEYS = decontaminate.MAX_KEYS, most
        try:
            got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
        finally:
            decontaminate.MAX_KEYS = old
        want = [("1", "1", 1), ("1", "2", 1), ("3", "3", 1), ("3", "3", 1), ("3", "None", 1), ("3", "None", 1), ("None", "4", 2)]
        assert sorted((str(r.doc_id), str(r.item_id), r.n_items) for r in got) == want


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_KEYS", 0)
    rng = random.Random(9)
    item = sentence(rng, 40)
    docs = spark.createDataFrame([(1, "a b " + item), (2, sentence(rng, 80))], DOCS)
    assert [r.doc_id for r in decontaminate.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [1]


def test_imatch(spark, texts):
    rows = list({k: (k, t) for k, t in texts if k is not None}.values()) + [(7000, texts[7][1])]
    got = {r.doc_id: r for r in imatch.compare_with_edits(frame(spark, rows)).collect()}
    order = sorted((k, t or "") for k, t in rows)
    for i, (k, t) in enumerate(order):
        half, after = len(t) // 2, order[(i + 1) % len(order)][1]
        assert got[k].edited == t[: len(t) - half] + after[:half] and got[k].n_chars == len(t)
    same = collections.defaultdict(set)
    for k, t in order:
        same[t].add(got[k].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len({got[k].fingerprint for k in (0, 1, 2, 5)}) == 4
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert imatch.compare_with_edits(spark.createDataFrame([], DOCS)).count() == 0
    one = imatch.compare_with_edits(spark.createDataFrame([(4, "abcd")], DOCS)).first()
    assert one.edited == "abab" and imatch.compare_with_edits(frame(spark, texts)).count() == len(texts)


def spark_hash(*values):
    """Spark's xxhash64, of strings, longs (as int) and ints (as np.int32), one after the other."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
        seed = seed - (1 << 64) if seed >> 63 else seed
    return seed if isinstance(seed, int) else None


@pytest.mark.parametrize("most", [60_000, 3])
def test_imatch_recomputed(spark, monkeypatch, most):
    """Fingerprints and likenesses against plain Python, with the lexicon in the plan and in a join."""
    monkeypatch.setattr(imatch, "MAX_LEXICON", most)
    rng = random.Random(6)
    many = lambda n: " ".join(f"{WORDS[int(42 * rng.random() ** 2)]}{rng.randrange(8)}" for _ in range(n))
    rows = [(i, many(rng.choice([1, 3, 12, 40, 200]))) for i in range(120)] + [(500, None), (501, ""), (502, "..."), (None, "ba xx"), (None, "kela bast"), (7, "same id"), (8, many(5).upper())]
    rows += [rows[3]] * 3
    term = re.compile(r"[^\W_]+")
    terms_of = lambda t: {spark_hash(w) for w in term.findall(t.lower())}
    df = collections.Counter(h for _, t in rows for h in terms_of(t or ""))
    band = {h for h, n in df.items() if max(1, imatch.LOW * len(rows)) <= n <= imatch.HIGH * len(rows)}
    assert len(band) > 3

    def holds(h, k):
        rate, bit = imatch.RATES[k // imatch.EACH], k
        return all(spark_hash(h, np.int32(r)) >> bit & 1 for r in (0, *range(2, rate + 1)))

    def mask(h):
        return sum(holds(h, k) << k for k in range(imatch.LEXICONS))

    masks = {h: mask(h) for h in band}
    signed = lambda m: m - (1 << 64) if m >> 63 else m

    def fingerprint(text):
        own = terms_of(text)
        lists = [sorted(h for h in own & band if masks[h] >> k & 1) for k in range(imatch.LEXICONS)]
        if not any(lists):
            whole = spark_hash(*sorted(own))
            return [spark_hash(whole, np.int32(k)) >> 32 for k in range(imatch.LEXICONS)]
        return [spark_hash(*(x for h in own_k for x in (h, signed(masks[h])))) >> 32 if own_k else 0 for own_k in lists]

    def likeness(a, b):
        either = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in either) / len(either) if either else 1.0

    key = lambda k, t: ((1 << 63) - 1 if k is None else k, spark_hash(t))
    order = sorted({(key(k, t or ""), k, t or "") for k, t in rows}, key=lambda x: x[0])
    want = {}
    for i, (_, k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, g = fingerprint(t), fingerprint(edited)
        text = lambda s: "".join(f"{x & 0xFFFFFFFF:08x}" for x in s)
        want[k, len(t), edited] = (text(f), text(g), likeness(f, g), likeness(f, fingerprint(after)))
    got = imatch.compare_with_edits(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        f, g, a, b = want[r.doc_id, r.n_chars, r.edited]
        assert (r.fingerprint, r.edited_fingerprint) == (f, g) and (r.near_edited, r.near_next) == pytest.approx((a, b))
    monkeypatch.setattr(imatch, "COPIES", 2)
    assert imatch.compare_with_edits(frame(spark, rows)).count() == len(rows)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_urls(spark):
    pages = ["http://WWW.Example.com/en/x?q", "https://m.example.com/en/#t", "http://example.com", "http://a.net/es/1", "http://net/fr/", "http://planet/es/", "x", None, "://?a/b", "ftp://b.com/?/en/", "http://a.b.example.com/en/" + "z" * 9000]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(pages)] + [(3, pages[3], "v")], "page_id long, url string, verdict string")

    def brute(u):
        host, path = "", ""
        if u and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = host.lower()
        fit = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    rules = spark.createDataFrame(RULES + RULES[:1] + [(None, "/", "block")], "host string, path string, verdict string")
    want = sorted((i, *brute(u)) for i, u in [*enumerate(pages), (3, pages[3])])
    key = lambda r: (r[0], r[1])
    got = urls.judge(df, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert urls.judge(df.limit(0), rules).count() == 0


def test_urls_of_many_rules(spark, monkeypatch):
    """Nested rules of all depths, a hot host and more parts than cuts can part evenly: against every rule."""
    monkeypatch.setattr(urls, "PER_PART", 3)
    rng = random.Random(3)
    labels = ["a", "b", "www", "com", "net", "example", "x1", "org"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = {(host(rng.randrange(1, 4)), "/" + rng.choice(["", "en/", "en/a", "fr/", "e"])): rng.choice(["allow", "block"]) for _ in range(300)}
    rules |= {("hot.example.com", f"/{i}/"): "block" for i in range(200)}
    pages = [(i, f"http://{host(rng.randrange(1, 5)) if rng.random() < 0.5 else rng.choice(['hot', 'm.hot']) + '.example.com'}/{rng.choice(['', 'en/', 'en/abc', 'fr/x', 'e', '7/x', '150/'])}") for i in range(3000)]
    made = spark.createDataFrame([(*k, v) for k, v in rules.items()], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string").repartition(5), made).collect()}
    assert len(got) == len(pages)
    for i, u in pages:
        h, p = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
        fit = {a + b: v for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and p.startswith(b)}
        longest = max(map(len, fit), default=0)
        rule, verdict = got[i]
        assert (len(rule or ""), verdict) == (longest, fit[rule] if fit else "allow") and (rule in fit or not fit)
    assert urls.judge(spark.createDataFrame(pages[:9], "page_id long, url string"), made.limit(0)).filter("rule is not null").count() == 0


def test_bpe_round_trip(spark, texts):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    rows = texts + [(600, "a<|endoftext|>b"), (601, "   \n\n tabs\t\tand 123456 's it's 'LL ñandú 日本 🙂"), (602, "=" * 5000)]
    got = bpe.encode_documents(frame(spark, rows), path).collect()
    want = sorted((str(k), np.array(own.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for k, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t in rows)
    assert bpe.encode_documents(spark.createDataFrame([], DOCS), path).count() == 0


def test_pii_base_spans():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@+-_% 0123456789()\n" if rng.random() < 0.8 else "1.9@+é4") for _ in range(rng.randrange(60)))
        want = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[ -]", "", m[0])
            if 14 <= len(digits) <= 19 and pii.luhn(digits):
                want.append((*m.span(), "card"))
        want += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_field(spark):
    rows = [(1, "two cards 4111111111111111 5500005555555559 here"), (2, "mail a.b@mail.example.org or +1 (202) 555-0101"), (3, None), (4, ""), (5, "9" * 9000), (5, "9" * 9000)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], DOCS + ", redacted string")
    rng, seen = random.Random(1), []
    while len(seen) < 120:
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        ok = pii.luhn(digits)
        if ok or rng.random() < 0.1:
            seen.append(f"{sentence(rng, 3)} {digits} {sentence(rng, 3)}")
    field = pii.train([e for t in seen for e in pii.examples(t)])
    got = {r.doc_id: r for r in pii.find_spans(docs, field).collect()}
    assert pii.find_spans(docs).count() == len(rows)
    assert got[1].pii_base == "" and got[1].pii_spans == "card:10:26,card:27:43"
    assert (got[2].n_email, got[2].n_phone) == (1, 1) and got[2].redacted == "mail [EMAIL] or [PHONE]"
    assert got[3].redacted is None and got[4].pii_spans == "" and got[5].n_card == 0
    field = pii.train([])
    region = pii.Region("see a@b.org, 10.1.2.3", 0, 21)
    total = field.best(region)
    assert [k for *_, k, _ in total] == ["email", "ip"]


def test_pii_rewritten_forms():
    """Each rewritten form of ordinary entities is a candidate and is found whole, long spelled-out addresses too."""
    entities = {
        "email": ["first.55@mail4.example.com", "jo@example.org", "anna-b.c@mail12.example.com", "maria.gonzalez.lopez@mail.department.university.example.com"],
        "phone": ["+1 (202) 555-0101", "+44 20 7946 0958"], "card": ["4111 1111 1111 1111", "5500005555555559"], "ip": ["10.20.30.40", "192.168.1.254"],
    }
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = [f(i) for i in range(40) for f in (lambda i: f"user.{i}@mail{i}.example.com", lambda i: f"+1 (20{i % 10}) 555-{digits(4)}", lambda i: f"+44 20 {digits(4)} {digits(4)}", lambda i: f"{rng.randrange(256)}.{i}.2.{rng.randrange(256)}", lambda i: next(c for c in iter(lambda: "4" + digits(15), None) if pii.luhn(c)))]
    field = pii.train([e for m in made for e in pii.examples(f"{sentence(rng, 4)} {m} {sentence(rng, 4)}")])
    for kind, values in entities.items():
        for value in values:
            for form in pii.MASKS[kind]:
                new = form(value)
                text = f"please write or call {new} for more of it"
                want = (21, 21 + len(new), kind)
                held = [(r.atoms[i][0], r.atoms[j - 1][1], k) for r in pii.regions(text) for i, j, k in r.candidates]
                assert want in held, new
                assert want in pii.find(text, field)[1], new
    assert field.weights["email: spelled at"] > 0


def test_pii_learns_from_all_texts(spark, monkeypatch):
    """The bounds on texts and regions are filled from all texts, and copies of one count once."""
    early = [(i, f"a{i:04d} plain text {i} with a number") for i in range(1500)] + [(9, "the same 1 again")] * 3000
    late = [(i, f"z{i:04d} call +99 {i % 7}00 {1000 + i} {2000 + i} now") for i in range(500)]
    for sample, most in ((1000, 2000), (10**6, 300)):
        monkeypatch.setattr(pii, "SAMPLE", sample)
        monkeypatch.setattr(pii, "REGIONS", most)
        assert pii.fit(spark.createDataFrame(early + late, DOCS)).weights["phone: after call"] > 0.3
    assert pii.fit(spark.createDataFrame([(1, None)], DOCS)).weights["email: sign"] != 0


def test_pii_segmentation_is_the_best_of_all():
    """The dynamic program against the enumeration of every segmentation; and the gradient against differences of the likelihood."""
    rng = random.Random(12)
    for n in range(40):
        text = " ".join(rng.choice(["10.1.2.3", "4111111111111111", "+1 202 555 0101", "at", "a@b.org", "12", "555-0101", "x"]) for _ in range(4))
        region = pii.Region(text, 0, len(text))
        field, held = pii.SegmentCRF(), region.candidates
        for f in sorted({f for fs in held.values() for f in fs}):
            field.weights[f] = rng.uniform(-1, 1.2)

        def total(at, held=held, field=field, size=len(region.atoms)):
            yield 0.0, ()
            for c in held:
                if c[0] >= at:
                    for value, rest in total(c[1]):
                        yield value + field.score(held[c]), (c, *rest)

        every = list(total(0))
        found = field.best(region)
        assert sum(s for *_, s in found) == pytest.approx(max(v for v, _ in every), abs=1e-9)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        if held and n < 10:
            gold = max(every, key=lambda x: len(x[1]))[1]
            like = lambda w, every=every, held=held, gold=gold: sum(sum(w[f] for f in held[c]) for c in gold) - np.logaddexp.reduce([sum(sum(w[f] for f in held[c]) for c in seg) for _, seg in every])
            before = dict(field.weights)
            field.climb(len(region.atoms), held, set(gold), 1.0)
            for f in list(before)[:6]:
                up, down = before | {f: before[f] + 1e-5}, before | {f: before[f] - 1e-5}
                assert field.weights[f] - before[f] == pytest.approx((like(up) - like(down)) / 2e-5, abs=2e-3)


def test_pii_long_stretches():
    """A span in the middle of a long run of numbers is found as it is alone, in time linear in the run; overlaps with base spans never come."""
    field = pii.train([])
    run = "1 22 333 " * 3000
    for span in ("a.b@mail.example.org", "10.1.2.3", "jo at mail dot example dot org"):
        text = f"{run}\n{span}\n{run}"
        want = [(a + len(run) + 1, b + len(run) + 1, k) for a, b, k in pii.find(span, field)[1]]
        assert want and [s for s in pii.find(text, field)[1] if len(run) < s[0] <= len(run) + 1 + len(span)] == want
    base, both = pii.find("mail a@b.org 10.1.2.3, 4111111111111111 and " * 50, field)
    extra = [s for s in both if s not in base]
    assert len(base) == 150 and not any(a < y and x < b for a, b, _ in extra for x, y, _ in base)


def labelled(spark, make, n=600):
    rng = random.Random(8)
    rows = [(i, *make(rng, i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS).withColumn("lang", F.lit("en")), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")


def auc(pairs):
    return np.mean([(a > b) + 0.5 * (a == b) for a, y in pairs if y for b, z in pairs if not z])


def test_toxicity(spark):
    def make(rng, bad):
        words = sentence(rng, 40).split()
        for _ in range(2 * bad):
            words[rng.randrange(40)] = rng.choice(["vile", "awful", "nasty"])
        return " ".join(words), int(bad)

    docs, labels = labelled(spark, make)
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    scored = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    held = [(scored[r.doc_id], r.label) for r in labels.filter("doc_id % 3 = 0").collect()]
    assert auc(held) > 0.9 and sum((p >= 0.3) == y for p, y in held) > 0.85 * len(held)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "..", "x")], DOCS + ", lang string")
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.fit(docs, labels.filter("label = 0")) is None and toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_of_unseen_forms(spark):
    """Forms of a word that only share its beginning with those learnt from."""
    ends = [a + b for a in ("an", "or", "ie", "us") for b in ("ka", "te", "ri", "mo")]

    def make(rng, bad):
        words = sentence(rng, 40).split()
        words[rng.randrange(40)] = ("grumb" if bad else "plona") + rng.choice(ends[:12])
        return " ".join(words), int(bad)

    docs, labels = labelled(spark, make)
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(i, f"{sentence(random.Random(i), 30)} {stem}{end}") for i, (stem, end) in enumerate((s, e) for s in ("grumb", "plona") for e in ends[12:])], DOCS)
    got = {r.doc_id: r.toxicity for r in toxicity.score(new, model).collect()}
    assert min(got[i] for i in range(4)) > max(got[i] for i in range(4, 8))


def test_quality(spark):
    def make(rng, bad):
        t = sentence(rng, 60)
        return (t.replace(" ", "### ").upper() if bad else t + "."), int(not bad)

    docs, labels = labelled(spark, make)
    model = quality.fit(docs, labels.filter("doc_id % 3 <> 0"))
    scored = {r.doc_id: r.quality for r in quality.score(docs, model).collect()}
    assert auc([(scored[r.doc_id], r.label) for r in labels.filter("doc_id % 3 = 0").collect()]) > 0.95
    odd = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (3, "\n\n", 2.0), (3, "a" * 50000, 2.0)], DOCS + ", quality double")
    assert all(0 <= r.quality <= 1 for r in quality.score(odd, model).collect())
    assert quality.fit(docs, labels.limit(0)) is None and quality.score(docs.limit(0), model).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    knots, values = quality.isotonic(x, (rng.random(400) < 1 / (1 + np.exp(-2 * x))).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()


def test_language(spark):
    rng = random.Random(6)
    words = {"aa": ["ouai", "elle", "tion", "queau", "ment"], "bb": ["schen", "keit", "unge", "stich", "verz"]}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    docs = spark.createDataFrame([(text(k, 80), k) for k in words for _ in range(20)] + [("x", None), (None, "aa")], "text string, lang string")
    rows = [(i, f"http://{'fr' if i % 2 else 'de'}.example.com/x", f"<html lang='{'aa' if i % 2 else 'bb'}'><body><article><p>{text('aa' if i % 2 else 'bb', 30)}</p></article></body></html>") for i in range(40)]
    rows += [(90, "http://fr.example.com/y", None), (91, None, None), (92, "http://de.example.com/z", ""), (92, "http://de.example.com/z", ""), (93, "http://fr.example.com/q", f"<html lang='bb'><article>{text('aa', 50)}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = language.identify(pages, docs).collect()
    got = {r.page_id: r.lang for r in found}
    assert len(found) == len(rows) and all(got[i] == ("aa" if i % 2 else "bb") for i in range(40))
    assert (got[90], got[92], got[93]) == ("aa", "bb", "aa")  # by host; by host; text against the markup
    assert language.identify(pages, docs.limit(0)).filter("lang is not null").count() == 0


def test_convolution_is_the_naive_one(spark):
    """Scores against word by word sums, every filter at every place; texts of no words, of fewer than a filter's width, and a long one."""
    model = toxicity.TextCNN(seed=4)
    rng = np.random.default_rng(2)
    model.E = rng.normal(0, 0.5, model.E.shape).astype(np.float32)
    model.b = [rng.normal(0, 0.2, b.shape).astype(np.float32) for b in model.b]
    model.v, model.scale, model.shift = rng.normal(0, 0.4, model.v.shape).astype(np.float32), 0.8, -0.3
    pick = random.Random(4)
    docs = [(1, None), (2, ""), (3, "ban"), (4, "Ban, LOR?"), (5, sentence(pick, 30)), (5, sentence(pick, 7)), (None, sentence(pick, 30000)), (7, "ñandú 日本 x")]
    df = spark.createDataFrame([(k, t, 0.5, 7) for k, t in docs], DOCS + ", toxicity double, score long")
    got = toxicity.score(df, model).collect()
    assert got[0].__fields__ == ["doc_id", "text", "score", "toxicity"] and len(got) == len(docs)
    import pyarrow as pa

    for r in got:
        ((_, ids, _),) = toxicity._word_ids([pa.record_batch([pa.array([r.text], pa.string())], ["text"])])
        if ids.shape[1] > 1000:
            assert 0 < r.toxicity < 1
            continue
        vectors = model.E[ids[0]] + model.E[ids[1]]
        tops = []
        for w, c, b in zip(toxicity.WIDTHS, model.C, model.b, strict=True):
            for f in range(toxicity.FILTERS):
                sums = [sum(float(vectors[at + j] @ c[j][:, f]) for j in range(w)) for at in range(len(vectors) - w + 1)]
                tops.append(max(0.0, max(sums) + float(b[f])))
        z = sum(t * float(v) for t, v in zip(tops, model.v, strict=True)) + float(model.c)
        assert r.toxicity == pytest.approx(1 / (1 + np.exp(-(0.8 * z - 0.3))), abs=1e-4)


def test_training_is_bounded_where_ids_repeat(spark, monkeypatch):
    """An id of many rows gives one text to the training, and texts beyond the bound of words none; long texts are scored all the same."""
    monkeypatch.setattr(toxicity, "WORDS", 50)
    rows = [(i, ("vile " if i % 2 else "") + sentence(random.Random(i), 20)) for i in range(200)]
    rows += [(1, f"vile {i}") for i in range(300)] + [(900, "vile " * 60), (901, sentence(random.Random(3), 60))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(900, 1), (901, 0)], "doc_id long, label int")
    seen = []
    real = toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda model, docs, y, weight: (seen.extend(d.shape[1] for d in docs), real(model, docs, y, weight)))
    model = toxicity.fit(docs, labels)
    assert seen and max(seen) <= 52 and model is not None
    got = [r.toxicity for r in toxicity.score(docs.filter("doc_id = 900"), model).collect()]
    assert got[0] > 0.5
    assert quality.fit(docs, labels) is not None and quality.fit(docs, labels.filter("label = 0")) is None


def test_quality_is_the_dense_solution(spark):
    """The partitions' sums against one solution over all training rows, and the statistics against plain counts."""
    rng = random.Random(8)
    texts = [sentence(rng, rng.randrange(1, 80)) + rng.choice(["", ".", "\nA b.\nA b.", " ### $$", " 123"]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(300)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    import pyarrow as pa

    ((_, x),) = list(quality.statistics([pa.record_batch([pa.array(texts)], ["text"])]))
    part = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)).alias("p")).collect()}
    rows = np.array([i for i in range(300) if part[i] != 0])
    y = np.array([i % 3 % 2 for i in range(300)])
    assert model.mean == pytest.approx(x[rows].mean(0)) and model.spread == pytest.approx(x[rows].std(0) + 1e-3, abs=1e-6)
    z = model.map(x[rows])
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]) * max(1.0, len(rows) * 1e-4), z.T @ y[rows])
    assert model.beta == pytest.approx(beta, abs=1e-6)
    for t, own in zip(texts, x, strict=True):
        words, lines = t.split(), [line for line in t.split("\n") if line]
        want = {"log_words": np.log1p(len(words)), "log_chars": np.log1p(len(t.encode())), "word_length": np.mean([len(w.encode()) for w in words]), "digit": sum(c.isdigit() for c in t) / len(t),
                "repeated_lines": 1 - len(set(lines)) / len(lines), "distinct_words": len(set(words)) / len(words), "top_word": max(collections.Counter(words).values()) / len(words), "single_char_words": sum(len(w) == 1 for w in words) / len(words)}
        assert {k: own[quality.NAMES.index(k)] for k in want} == pytest.approx(want)
    ties = quality.isotonic(np.array([1.0, 1.0, 1.0, 2.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(ties[1]) >= 0).all()


def test_language_fusion_recomputed(spark):
    """Posteriors and priors page by page, from every other page, by plain sums."""
    rng = random.Random(6)
    words = {"aa": ["ouai", "elle", "tion", "queau"], "bb": ["schen", "keit", "unge", "stich"], "cc": ["zione", "gli", "mente", "degli"]}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    docs = spark.createDataFrame([(text(k, 60), k) for k in words for _ in range(10)], "text string, lang string")
    rows = []
    for i in range(60):
        k, n = rng.choice(list(words)), rng.choice([0, 1, 2, 20])
        declared = rng.choice([k, "aa", "xx", ""])
        html = f"<html lang='{declared}'><nav>{text('bb', 9)}</nav><p>{text(k, n)} &amp;</p>" if declared else f"<p>{text(k, n)}</p>"
        rows.append((i, rng.choice(["http://a.example.org/fr/x", "http://b.example.org/y", f"http://{k}.example.net/", None]), None if i % 17 == 0 else html, "clash"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in language.identify(pages, docs).collect()}
    model = language.fit(docs)
    assert model.langs == list(words)
    import pyarrow as pa

    post, score, keys = {}, {}, {}
    for i, url, html, _ in rows:
        batch = pa.record_batch([pa.array([language.main_text(html or "")])], ["text"])
        ((_, gram, row),) = list(language._grams([batch]))
        counts = np.zeros((3, language.BUCKETS))
        for g in range(language.BUCKETS):
            for e in range(model.first[g], model.first[g + 1]):
                counts[model.lang[e], g] = np.exp(model.gain[e]) * language.FLOOR - language.FLOOR
        like = np.log((counts + language.FLOOR) / (counts + language.FLOOR).sum(1, keepdims=True))
        own = like[:, gram].mean(1) * min(len(gram), language.WEIGHT) if len(gram) else np.zeros(3)
        own = own - own.max()
        p = np.exp(own) / np.exp(own).sum()
        post[i] = np.where(p >= language.LEAST, p, 0) if len(gram) else np.zeros(3)
        score[i] = np.where(p >= language.LEAST, own, np.log(language.LEAST)) if len(gram) else np.zeros(3)
        host = re.match(r"[^/?#]*", url.split("://", 1)[1])[0] if url else ""
        path = url.split("://", 1)[1][len(host) :] if url else ""
        lang = re.match(r"/([a-z]{2})(?:/|$)", path)
        claim = re.search(r"<html\b[^<>]*?\blang='([a-z]{2})", html or "")
        keys[i] = (host, host.rsplit(".", 1)[-1] + "/" + (lang[1] if lang else ""), claim[1] if claim else "")
    world = 1 + sum(post.values())
    world = world / world.sum()
    share = lambda own, up: (own + language.SMOOTH * up) / (own + language.SMOOTH * up).sum()
    others = lambda i, fits: sum((post[j] for j in post if j != i and fits(keys[j])), np.zeros(3))
    for i, (host, suffix, claim) in keys.items():
        by_host = share(others(i, lambda k: k[:2] == (host, suffix)), share(others(i, lambda k: k[1] == suffix), world))
        by_claim = share(others(i, lambda k: k[2] == claim), world)
        logit = score[i] + np.log(by_host) + (np.log(by_claim) - np.log(world) if claim else 0)
        p = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
        assert got[i].confidence == pytest.approx(p.max(), abs=2e-3) and (p[list(words).index(got[i].lang)] == pytest.approx(p.max(), abs=1e-3))
        assert got[i].text_lang == (list(words)[int(post[i].argmax())] if post[i].any() else None)


def test_language_of_many_languages(spark):
    """Rare languages beyond any former bound are models too; and pages that are made to be slow are not."""
    rng = random.Random(2)
    words = {f"q{chr(97 + i // 26)}{chr(97 + i % 26)}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(230)}
    docs = spark.createDataFrame([(" ".join(rng.choice(w) for _ in range(40)), k) for k, w in words.items()] + [("the of and " * 30, "en")] * 400, "text string, lang string")
    pages = [(i, None, "<p>" + " ".join(rng.choice(words[k]) for _ in range(60))) for i, k in enumerate(words)]
    pages += [(900, None, "<script>" * 20000), (901, None, "<html " * 20000), (902, None, "<!-- " * 20000 + "<article>" * 20000), (903, None, "x " * 200000)]
    got = {r.page_id: r.text_lang for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert sum(got[i] == k for i, k in enumerate(words)) >= 225 and len(got) == len(pages)
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), docs).count() == 0


@pytest.mark.parametrize("html, text", [
    ("<p>a</p><nav>b</nav>c", "a c"), ("x<article>in</article>y", "in"), ("<main> </main>y", "y"), ("a<!-- <p>b -->c", "a c"), ("a<script>if (a<b) x</script>c", "a c"), ("a<script>b", "a"), ("<div class=\"ad\">b</div>c &amp; d", "c d"), ("<ARTICLE>in<Style>b</STYLE>side</ARTICLE>", "in side"),
])
def test_main_text(html, text):
    assert language.main_text(html).split() == text.split()


def test_near_duplicate_recall(spark):
    """Every text whose id is divisible by 50 against all others: links by plain or probability Jaccard of 0.8 or more are in one group."""
    rng = random.Random(21)
    rows = []
    for i in range(0, 3000, 50):
        words = sentence(rng, rng.randrange(30, 200)).split()
        words = [w + str(rng.randrange(30)) for w in words]
        rows.append((i, " ".join(words)))
        for j in range(1, 5):
            own = [w if rng.random() > 0.012 * j else "changed" for w in words] + words[:5] * rng.randrange(3)
            rows.append((i + j, " ".join(own)))
    sets = {k: collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for k, t in rows}
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    links = found = 0
    for a in range(0, 3000, 50):
        for b in sets:
            if a != b:
                plain = len(sets[a].keys() & sets[b].keys()) / len(sets[a].keys() | sets[b].keys())
                if plain >= 0.8:
                    links += 1
                    found += group[a] == group[b]
    assert links > 80 and found >= 0.98 * links


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    item = sentence(rng, 40)
    rows = [(i, sentence(rng, 60) + (" vile awful" if i % 5 == 0 else ""), "en", "s", 1) for i in range(200)]
    rows += [(300, rows[1][1], "en", "s", 1), (301, "x y " + item, "en", "s", 1), (302, "write to a.b@mail.example.org " + sentence(rng, 30), "en", "s", 1), (303, None, None, None, None)]
    spark.createDataFrame(rows, DOCS + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert 300 not in kept and 301 not in kept and 1 in kept and kept[302].startswith("write to [EMAIL] ")
    assert sum(i in kept for i in range(0, 200, 5)) <= 4 and sum(i in kept for i in range(200) if i % 5) >= 155
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()}
    assert out.keys() == kept.keys() and out[303] == 0


def test_pipeline_run_against_brute_force(spark, tmp_path):
    """run() against each stage done plainly: naive scores, all pairs of shingle sets, all alignments, text by text spans, the tokenizers library."""
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(13)
    long = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))
    items = [(i, long(n)) for i, n in enumerate((14, 25, 40, 7, 3))]
    rows = [(i, long(60) + (" vile awful" if i % 5 == 0 else "")) for i in range(120)]
    for i in range(1, 40, 3):
        own = rows[i][1].split()
        for j in rng.sample(range(len(own)), 1):
            own[j] = "other"
        rows.append((200 + i, " ".join(own)))
    rows += [(300 + i, f"{long(9)} {t} {long(9)}") for i, (_, t) in enumerate(items)] + [(310, items[4][1]), (311, " ".join(w if j % 9 else "sub" for j, w in enumerate(items[2][1].split())))]
    rows += [(320, "write to a.b@mail.example.org or +1 (202) 555-0101 " + long(20)), (321, "card 4111111111111111 " + long(20)), (322, None), (323, ""), (324, "a<|endoftext|>b"), (325, rows[3][1]), (None, long(30))]
    full = [(k, t, "en" if j % 2 else None, "s", len(t or "")) for j, (k, t) in enumerate(rows)]
    spark.createDataFrame(full, DOCS + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((str(r.doc_id), r.lang, r.source, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    scores = {(str(r.doc_id), r.text): r.toxicity for r in toxicity.score(docs, model).collect()}
    kept = [(k, t, lang) for k, t, lang, *_ in full if scores[str(k), t] < model.cuts.get(lang, model.cuts[""])]
    assert 60 < len(kept) < len(full)

    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else (t or "",)

    sets, root = [shingles(t) for _, t, _ in kept], list(range(len(kept)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (kept[i][1] or "") == (kept[j][1] or "") or isinstance(a, frozenset) and isinstance(b, frozenset) and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (k, *_) in enumerate(kept):
        groups[find(i)].append((k is None, k or 0, i))
    kept = [kept[min(g)[2]] for g in groups.values()]

    def dirty(t):
        doc = re.findall(r"[^\W_]+", (t or "").lower())
        for _, item in items:
            it = re.findall(r"[^\W_]+", item.lower())
            if len(it) < 5:
                if doc == it:
                    return True
                continue
            for s in range(-len(it) + 1, len(doc)):
                same = [0 <= k + s < len(doc) and doc[k + s] == w for k, w in enumerate(it)]
                a, b = max(0, -s), min(len(it), len(doc) - s)
                if any(5 * sum(same[x:y]) >= 4 * (y - x) for x in range(a, b) for y in range(x + min(12, len(it)), b + 1)):
                    return True
        return False

    kept = [(k, t, lang) for k, t, lang in kept if not dirty(t)]
    assert 310 not in {k for k, *_ in kept} and 311 not in {k for k, *_ in kept} and {320, 321, 324} <= {k for k, *_ in kept}
    frame_ = spark.createDataFrame([(k, t) for k, t, _ in kept], DOCS)
    field, own = pii.fit(frame_), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for k, t, lang in kept:
        ids = own.encode(pii.redact(t, pii.find(t, field)[1]) if t else "", add_special_tokens=False).ids
        want.append((str(k), lang, "s", len(ids), np.array(ids, "<u4").tobytes()))
    key = lambda x: (x[0], str(x[1]), x[4])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_join_groups(spark, monkeypatch, share):
    """All groups broadcast, the hot one only, and none: the same rows, each once."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 14}") for i in range(60)] + [(60, "alone")], "id long, key string")
    groups = rows.groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    got = common.join_groups(rows, groups, ["key"])
    assert sorted(got.columns) == ["id", "key", "top"]
    top = collections.defaultdict(int)
    for r in rows.collect():
        top[r.key] = max(top[r.key], r.id)
    assert sorted((r.id, r.key, r.top) for r in got.collect()) == sorted((r.id, r.key, top[r.key]) for r in rows.collect())
    assert common.join_groups(rows.limit(0), groups.limit(0), ["key"]).count() == 0


def test_hash_helpers():
    from smsward.llm.common import pack, unpack

    for a in ([], [0], [5, 6, 900, 1 << 31]):
        assert unpack(pack(np.array(a, np.uint32))).tolist() == a
