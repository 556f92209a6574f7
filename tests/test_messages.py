"""Unit rows of the message engine; see FIXTURES.md."""

import math
import os
import random
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from smsward import constants as K
from smsward.functions import text as T
from smsward.operators import corpus, mask, ml, normalize, policy, trees
from smsward.plans import predict, queries
from smsward.sources import readers
from smsward.streaming import stream

SF = "/root/testdata/sf0.001"

MASKED = [
    ("Lien he a.b@mail.example.com ngay", "Lien he <EMAIL> ngay", {"email": 1}),
    ("Xem https://site.example.app/x?y=1 nhe", "Xem <URL> nhe", {"url": 1}),
    ("Goi 1900 12 34 56 ngay", "Goi <PHONE> ngay", {"hotline": 1}),
    ("So may 0901.234.567", "So may <PHONE>", {"mobile": 1}),
    ("Soan ST5K gui 9029", "Soan <CODE> gui <PHONE>", {"shortcode": 1, "code": 1}),
    ("STK: 12345678901 ACB", "STK <BANK_ACC> ACB", {"bank_acc": 1}),
    ("Hen 10h30 ngay 15/05", "Hen <TIME> ngay <TIME>", {"datetime": 2}),
    ("Giai thuong 500k", "Giai thuong <MONEY>", {"money": 1}),
    ("Ma OTP la 123456", "Ma OTP la <CODE>", {"code": 1}),
    ("Sinh nam 1990", "Sinh nam 1990", {}),
    ("1.900.000", "1.<PHONE>.000", {"shortcode": 1}),
    ("a   b\nc", "a b c", {}),
    ("", "", {}),
    (None, "", {}),
]


def test_masking(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(MASKED)], "id int, text string")
    got = {r.id: r for r in mask.mask(df).collect()}
    for i, (text, masked, counts) in enumerate(MASKED):
        assert got[i].masked == masked, text
        assert {k: len(v) for k, v in got[i].entities.items()} == counts, text


def test_spaced_address_is_masked_and_extracted(spark):
    df = spark.createDataFrame([(1, "Truy cap abc . com . vn"), (2, "vao s h o p e e . v n nhe")], "id int, text string")
    got = {r.id: r for r in mask.mask(df).collect()}
    assert "<URL>" in got[1].masked and got[2].url_count == 1


NORMAL = [
    ("kh0ng co d!eu k!en", ["khong", "co", "dieu", "kien"], (3, 1, 2, 0, 0), 3.4),
    ("ba0: h0 tro", ["bao", "ho", "tro"], (2, 2, 0, 0, 1), 2.0),
    ("ko <URL>", ["không", "<URL>"], (0, 0, 0, 1, 0), 0.3),
    ("$ms", ["sms"], (1, 0, 1, 0, 0), 1.5),
    ("mjnh", ["minh"], (0, 0, 0, 0, 0), 0.0),
    ("---'''~~~", [], (0, 0, 0, 0, 9), 0.0),
]


def test_normalization(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(NORMAL)], "id int, masked string")
    got = {r.id: r for r in normalize.normalize(df).collect()}
    for i, (text, tokens, counts, weight) in enumerate(NORMAL):
        r = got[i]
        assert r.tokens == tokens, text
        assert (r.leet_count, r.visual_leet_count, r.symbol_leet_count, r.teencode_count, r.separator_count) == counts, text
        assert r.weighted_leet_score == pytest.approx(weight), text


def test_whitelist(spark):
    df = spark.createDataFrame([(["vcb", "thong", "<URL>", "123", "a", "ko"],)], "tokens array<string>")
    r = normalize.split_whitelist(df).first()
    assert (r.whitelisted_tokens, r.to_check, r.whitelist_count) == (["vcb", "<URL>", "123", "a"], ["thong", "ko"], 4)
    assert normalize.split_whitelist(df, repaired=True).first().to_check == ["thong"]


@pytest.mark.parametrize("words, run_on", [(["xinchao", "xkqz", "anban", "hottt", "dduong", "3gb", "xin"], 1), (["xinchao", "anban", "xkqz", "hottt", "dduong", "3gb", "xin"], 2)])
def test_misspelling(spark, words, run_on):
    df = spark.createDataFrame([(1, words, [], [])], "id int, to_check array<string>, original_words array<string>, decoded_words array<string>")
    full = spark.createDataFrame([(w,) for w in ("xin", "chào", "bạn", "thông", "báo", "ăn", "cơm")], "word string")
    shadow = spark.createDataFrame([(w,) for w in ("xin", "chao", "ban", "thong", "bao", "an", "com")], "word string")
    r = normalize.misspell(df, normalize.Dictionary.of(full, shadow)).first()
    assert (r.oov_count, r.longest_oov_length, r.gibberish_count, r.repeated_char_count, r.broken_telex_count, r.run_on_word_count) == (5, 7, 1, 1, 1, run_on)
    assert r.oov_density == pytest.approx(5 / 6, abs=1e-6)


def test_flags_and_senders(spark):
    urls = [("viettel.vn", 1), ("500.000d", 0), ("http://192.168.1.50/x", 1), (None, 0)]
    phones = [("LH 18008168", 1), ("Chi tiet goi 197", 0), ("0912345678", 1), ("Ma 733792", 0)]
    senders = [("Vietcombank", "brandname"), ("191", "shortcode"), ("19001091", "shortcode"), ("0912345678", "personal_number"), ("+84912345678", "personal_number"), ("123456789012345", "unknown"), (None, "brandname")]
    for rows, f in ((urls, T.has_url), (phones, T.has_phone_number), (senders, T.classify_sender)):
        df = spark.createDataFrame([(a,) for a, _ in rows], "x string")
        assert [r[0] for r in df.select(f(F.col("x"))).collect()] == [b for _, b in rows]


def test_malformed_csv(spark):
    lines = ['"Xin "chao", ban oi",1,0,0,unknown', "a,b,c,0,1,0,brandname", "too,few,parts", ""]
    rows, bad = readers.parse_malformed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in rows.collect()] == [("Xin 'chao', ban oi", "1", "0", "0", "unknown"), ("a,b,c", "0", "1", "0", "brandname")]
    assert bad.count() == 1


def test_dictionary_lines(spark):
    lines = ['{"text": " Xin ", "source": []}', "chào", '{"source": []}', ""]
    got = readers.dictionary_words(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r.word for r in got.collect()} == {"xin", "chào"}


FUSION = [
    (0.10, 1.0, "", "x", "x", True, 1.0, "Domain Risk"),
    (0.70, -1.0, "google.com", "x", "x", True, 0.70, "Hybrid Warning"),
    (0.65, -1.0, "google.com", "x", "x", False, 0.2, "Hybrid Safe"),
    (0.99, -1.0, "Whitelisted Domain (viettel.vn)", "x", "x", False, 0.0, "Authority Whitelist"),
    (0.46, 0.0, "", "x", "anh oi di choi", False, 0.25, "Conversation Guard"),
    (0.90, 0.0, "", "x", "anh vay stk", True, 0.90, "AI Detection"),
    (0.10, 0.0, "", "unknown", "vay nhanh", True, 0.6, "Keyword Trigger"),
    (0.10, 0.0, "", "brandname", "vay nhanh", False, 0.10, "AI Model"),
]


def test_fusion(spark):
    df = spark.createDataFrame([r[:5] for r in FUSION], "p double, risk double, reason string, sender string, text string")
    got = df.select(policy.fuse(*(F.col(c) for c in ("p", "risk", "reason", "sender", "text"))).alias("r")).select("r.*").collect()
    assert [tuple(r)[:3] for r in got] == [r[5:] for r in FUSION]
    assert [r.reason for r in got] == [K.REASONS[r.phase].replace("%s", f[2]) for r, f in zip(got, FUSION, strict=True)]


def test_diacritics_keep_d(spark):
    r = spark.createDataFrame([("Điều tra đường phố",)], "t string").select(T.keyword_fold(F.col("t")).alias("a"), T.keyword_fold(F.col("t"), fold_d=True).alias("b")).first()
    assert (r.a, r.b) == ("đieu tra đuong pho", "dieu tra duong pho")


def test_dedupe_before_filter_and_parts(spark):
    raw = spark.createDataFrame([(1, "a", None, "Sent"), (2, "a", "191", "Received"), (3, "b", "191", "Received")], "id int, Content string, Sender string, Type string")
    assert [r.content for r in corpus.structure_export(raw, "id").collect()] == ["b"]
    parts = {r.id: r.part for r in corpus.contiguous_parts(spark.range(11), 5, "id").collect()}
    assert [parts[i] for i in range(11)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4]


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p double, label int")
    assert ml.roc_auc(df).first().auc == pytest.approx(0.875)
    assert tuple(ml.best_threshold(df).first()) == (0.8, 0.8)


def test_models_train_on_the_whole_job(spark, monkeypatch):
    """200 trees over the 27 features and the sender's type; the grid has 144 combinations of five folds."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    training = queries._training(spark, SF).cache()
    assert training.columns == ["doc_id", "label", "sender_type", *K.FEATURES]
    monkeypatch.setattr(queries, "_training", lambda spark, d: training)
    model = ml.train(training)
    assert len(model.trees) == 200 and model.names() == [*K.FEATURES, "sender_type"]
    assert len(ml.train(training, "forest").trees) == 200 and len(ml.train(training, "tree").trees) == 1
    assert len(queries.QUERIES["feature_importance"](spark, "").collect()) == 20
    compared = queries.QUERIES["model_compare"](spark, "").collect()
    assert [r.model for r in compared] == ["boosted", "forest", "tree"] and [r.model for r in compared if r.best] == [max(compared, key=lambda r: r.f1).model]
    saved = {r.doc_id: r.p for r in queries.QUERIES["model_saved"](spark, "").collect()}
    assert saved == pytest.approx({r.doc_id: r.p for r in ml.predict(model, training).collect()})
    assert math.prod(map(len, ml.GRID.values())) == 144
    monkeypatch.setattr(ml, "GRID", {k: v[-1:] for k, v in ml.GRID.items()} | {"gamma": [0.0, 50.0]})
    grid = queries.QUERIES["grid_search"](spark, "").collect()
    assert len(grid) == 2 and all(r.folds == 5 for r in grid) and {r["rank"] for r in grid} == {1, 2}
    assert next(r for r in grid if r.gamma == 50.0).mean_auc <= 0.65  # hardly a split is worth so much


def test_model_inputs(spark):
    """Senders that a model hasn't seen, and null ones, have the first code; null labels aren't learnt from; a sample is drawn beyond the bound."""
    rng = random.Random(3)
    rows = [(i, None if i % 40 == 0 else int(i % 3 == 0), "b" if i % 3 else "a", float(i % 3 == 0) + rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, label int, sender_type string, x double")
    model = ml.train(df, "tree", features=["x"])
    assert model.senders == ["a", "b"]
    new = spark.createDataFrame([(s, 1.2) for s in ("a", "c", None)], "sender_type string, x double")
    assert len({r.p for r in ml.predict(model, new).collect()}) == 1
    assert len(ml.training_table(df, ["x"], most=100)[2]) < 200
    assert ml.predict(model, new.limit(0)).count() == 0


def _best_split(x, g, h, ridge):
    """Over every feature and every threshold, by the definition of the gain."""
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)
    every = np.ones(len(x), bool)
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for t in (np.unique(x[:, f])[1:] + np.unique(x[:, f])[:-1]) / 2:
            low = x[:, f] <= t
            gain = 0.5 * (score(low) + score(~low) - score(every))
            if gain > best[0] + 1e-9:
                best = (gain, f, t)
    return best


def test_trees_against_all_splits():
    rng = np.random.default_rng(5)
    for ridge in (0.0, 1.0):
        x = np.round(rng.normal(size=(80, 4)), 1)
        y = (x[:, 1] + 0.3 * rng.normal(size=80) > 0.2).astype(int)
        g, h = 0.5 - y, np.full(80, 0.25)
        edges = trees.edges_of(x)
        tree = trees.grow(trees.codes_of(x, edges), edges, g, h, trees.Growth(depth=2, ridge=ridge), np.arange(4), rng)
        gain, f, _ = _best_split(x, g, h, ridge)
        t = tree.threshold[0]
        assert (tree.feature[0], tree.gain[0]) == (f, pytest.approx(gain))
        for child, rows in ((tree.left[0], x[:, f] <= t), (tree.right[0], x[:, f] > t)):
            gain, f2, _ = _best_split(x[rows], g[rows], h[rows], ridge)
            assert (tree.feature[child] < 0) == (f2 is None) and (f2 is None or tree.gain[child] == pytest.approx(gain))
        leaf = np.array([tree.value[i] for i in range(len(tree.value))])
        assert np.isin(tree.values(x), leaf).all()
    boosted = trees.Model("boosted", list("abcd"), None, trees.fit_boosted(x, y, trees.BOOSTED | {"trees": 30}), 0.05)
    assert trees.auc(boosted.probabilities(x), y) > 0.95 and boosted.importances()[0][0] == "b"
    pairs = [(p > q) + 0.5 * (p == q) for p, a in zip(boosted.probabilities(x), y, strict=True) if a for q, b in zip(boosted.probabilities(x), y, strict=True) if not b]
    assert trees.auc(boosted.probabilities(x), y) == pytest.approx(np.mean(pairs)) and trees.auc(np.ones(3), np.ones(3, int)) is None


def test_ranks_and_curves_by_ranges(spark):
    rng = random.Random(8)
    rows = [(i if i % 50 else None, i % 2, round(rng.random(), 2)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, label int, p double").repartition(3)
    split = ml.stratified_split(df.filter("id is not null"), "id", "label").groupBy("label", "is_test").count().collect()
    assert {(r.label, r.is_test): r["count"] for r in split} == {(0, True): 96, (0, False): 384, (1, True): 100, (1, False): 400}
    assert sorted(r["count"] for r in ml.folds(df, "id", "label").groupBy("label", "fold").count().collect()) == [100] * 10
    got = {r.threshold: (r.n, r.pos, r.above, r.hits) for r in ml.threshold_counts(df).collect()}
    for t in got:
        assert got[t] == (sum(p == t for *_, p in rows), sum(y for _, y, p in rows if p == t), sum(p >= t for *_, p in rows), sum(y for _, y, p in rows if p >= t))


def test_domain_verdict_reads_pages(spark, tmp_path):
    """A page that links absolutely to its own or a trusted domain is legitimate; relative links and others prove nothing."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    links = {3: "https://own3.example.com/x", 9: "/x", 15: "https://viettel.vn/x", 27: "https://other.net/x"}
    rows = [(i, f"https://www.own{i}.example.com/p", f'<a href="{h}">x</a>'.encode()) for i, h in links.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary")
    pages.withColumn("html", F.col("html").cast(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").schema["html"].dataType)).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.status, r.risk) for r in queries.QUERIES["domain_verdict"](spark, str(tmp_path)).collect()}
    assert got == {3: ("LEGIT", -1.0), 9: ("PHISHING", 1.0), 15: ("LEGIT", -1.0), 27: ("PHISHING", 1.0)}


def plain_mask(text):
    """Masking by Python's own patterns, rule by rule."""
    text, found = unicodedata.normalize("NFC", text or ""), dict.fromkeys(K.ENTITY_TAGS, 0)
    i = regex.IGNORECASE

    def rule(label, pattern, tag, flags=0, keyword=False):
        nonlocal text
        p = regex.compile(regex.sub(r"^\(\?i?U\)", "", pattern), flags)
        found[label] += len(p.findall(text))
        text = p.sub(lambda m: f"{m[1]} {tag}" if keyword else tag, text)

    rule("zalo", K.ZALO, "<APP_LINK>", i)
    rule("telegram", K.TELEGRAM, "<APP_LINK>", i)
    rule("email", K.EMAIL, "<EMAIL>", i)
    rule("url", mask.SHORTENER, "<URL>", i)
    spaced = regex.compile(mask.OBFUSCATED.removeprefix("(?iU)"), i)

    def odd(m):
        s = m[0]
        bad = s.count(" ") / len(s) >= 0.05 and not any(w in s.lower() for w in K.OBFUSCATION_EXEMPT) and len(s) >= 8
        return bad and (" " in s.split(".")[0] or "(.)" in s or " . " in s or "( . )" in s)

    found["url"] += sum(map(odd, spaced.finditer(text)))
    text = spaced.sub(lambda m: "<URL>" if odd(m) else m[0], text)
    for p in (mask.PROTOCOL, mask.SCHEMELESS_SAFE, mask.SCHEMELESS_RISKY):
        rule("url", p, "<URL>", i)
    text = regex.sub(r"\s+", " ", regex.sub(r"<URL>[\w.\-/]+", "<URL>", text)).strip()
    rule("bank_acc", mask.BANK, "<BANK_ACC>", i, True)
    for label, p in (("hotline", K.HOTLINE), ("landline", K.LANDLINE), ("mobile", K.MOBILE), ("shortcode", mask.KNOWN_SHORTCODE)):
        rule(label, p, "<PHONE>")
    rule("shortcode", mask.CONTEXT_SHORTCODE, "<PHONE>", i, True)
    rule("datetime", K.DATETIME, "<TIME>", i)
    rule("money", mask.MONEY, "<MONEY>", i)
    rule("code", mask.CODE, "<CODE>")
    rule("code", mask.OTP, "<CODE>")
    return text, found


def test_full_mask_against_plain_python(spark):
    """All rules in their order, over texts of the tables and over made ones that hold every entity."""
    rng = random.Random(4)
    pieces = [*queries._APPS, *queries._SHORT, *queries._RISKY, *queries._LINKS, *queries._SPACED, *queries._ENTITIES, *(m[0] for m in MASKED if m[0]), "a.b@mail.example.com", "giờ tỷ đồng", "\n\t", "e\u0301"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(400)] + ["", None]
    if os.path.isdir(SF):
        texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = mask.mask(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), entities=False).collect()
    for r in got:
        masked, found = plain_mask(texts[r.id])
        assert r.masked == masked, texts[r.id]
        assert {k: r[f"{k}_count"] for k in K.ENTITY_TAGS} == found, texts[r.id]


def test_rows_of_equal_and_null_keys(spark):
    """Features belong to rows: equal and null keys neither merge nor lose theirs; and a large dictionary gives what a small one gives."""
    full = spark.createDataFrame([(w,) for w in ("xin", "chào", "không", "cơm")], "word string")
    texts = [(1, "xkqz hottt abcdx kh0ng"), (1, "xkqz hottt abcdx kh0ng"), (None, "xkqz hottt abcdx kh0ng"), (None, "xin chào"), (2, ""), (2, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    dic = normalize.Dictionary.of(full)
    large = normalize.Dictionary(dic.full, dic.shadow, False)
    want = None
    for d in (dic, large):
        rows = sorted(map(tuple, normalize.extract_features(df, d).collect()), key=str)
        assert len(rows) == len(texts) and len({r[1:] for r in rows if r[0] == 1}) == 1
        assert {r[1:] for r in rows if r[0] == 1} < {r[1:] for r in rows if r[0] is None}
        assert want is None or rows == want
        want = rows
    r = normalize.extract_features(df.limit(1), dic).first()
    assert (r.oov_count, r.validated_leet_count, r.gibberish_count) == (3, 1, 2)
    none = normalize.extract_features(df.limit(1), normalize.Dictionary.empty(spark)).first()
    assert (none.oov_count, none.oov_density, none.validated_leet_count) == (4, 1.0, 0)


FOLDS = [("ｖａｙ nhanh", "vay nhanh"), ("𝐯𝐚𝐲", "vay"), ("ﬁn ① ²", "fin 1 2"), ("йог Ё", "иог е"), ("Điều tra", "đieu tra"), ("e\u0301\u034fx", "e\u034fx"), ("한글", unicodedata.normalize("NFKD", "한글")), (None, None), ("", "")]


def test_folding_of_any_script(spark):
    texts = [t for t, _ in FOLDS] + ["".join(map(chr, range(a, a + 64))) for a in (*range(0x20, 0x600, 64), *range(0x1E00, 0x2200, 64), *range(0xFB00, 0xFFC0, 64)) if not 0xD800 <= a < 0xE000]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.keyword_fold(F.col("t")).alias("f"), T.strip_diacritics(F.col("t")).alias("s")).collect()
    lower = lambda s: s.replace("İ", "i̇")
    for r in got:
        t = texts[r.id]
        if t is not None:
            folded = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
            assert r.f.lower() == lower(folded).lower(), t
            assert r.s == "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), t
    assert [next(r.f for r in got if r.id == i) for i in range(len(FOLDS))] == [f for _, f in FOLDS]


def test_predictions(spark):
    """The record of 8 fields, each phase by its evidence; both policies; the result table."""
    dic = normalize.Dictionary.of(spark.createDataFrame([("xin",), ("vay",)], "word string"))
    stump = trees.Model("tree", ["oov_count"], ["personal_number"], [trees.Tree([0, -1, -1], [2.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.5, 0.1, 0.9], [1.0, 0.0, 0.0])])
    cases = [
        (1, "vao https://www.viettel.vn/km ngay", "brandname", "Authority Whitelist"), (2, "xem http://bad.example.com/x", "unknown", "Domain Risk"), (3, "docs https://docs.google.com/a va 1", "unknown", "Hybrid Safe"),
        (4, "xin qwert zxcvb asdfg hjklm", "personal_number", "AI Detection"), (4, "anh oi qwert zxcvb asdfg hjklm", "personal_number", "Conversation Guard"), (None, "xin vay", "unknown", "Keyword Trigger"),
        (6, "xin vay", "brandname", "AI Model"), (7, None, None, "AI Model"), (8, "momo http://good.example.com/y", "unknown", "Authority Whitelist"), (9, "http://10.0.0.1/x", "unknown", "AI Model"), (10, "xem http://own.example.net/p", "unknown", "Authority Whitelist"),
    ]
    messages = spark.createDataFrame([c[:3] for c in cases], "doc_id long, text string, sender string")
    search = spark.createDataFrame([("momo", "example.com", 1, "https://www.example.com")], "brand string, domain string, rank int, href string")
    fetched = spark.createDataFrame([("http://own.example.net/p", 200, '<a href="https://example.net/q">x</a>')], "url string, status int, html string")
    got = predict.predictions(messages, stump, dic, search, fetched).collect()
    assert got[0].__fields__ == ["doc_id", *predict.RECORD] and len(got) == len(cases)
    phases = {(r.doc_id, r.text): r.phase for r in got}
    assert phases == {c[:2]: c[3] for c in cases}
    assert all(r.reason and r.is_smishing == (r.phase in ("Domain Risk", "Hybrid Warning", "AI Detection", "Keyword Trigger")) for r in got)
    first = predict.predictions(messages, stump, dic, search, fetched, first_policy=True).collect()
    assert {r.phase for r in first} == {"Domain Check (Phishing Detected)", "Domain Check (Verified Safe)", "AI Model"}
    shown = predict.result_table(predict.predictions(messages, stump, dic, search, fetched)).collect()
    assert {r.status for r in shown} == {K.STATUS_BAD, K.STATUS_CLEAN} and all(len(r.preview or "") <= 50 for r in shown)


def test_labels_and_missing_files(spark):
    rows = spark.createDataFrame([("1",), ("0",)], "label string")
    assert [r[0] for r in rows.select(readers.strict_label(F.col("label"))).collect()] == [1, 0]
    for bad in ("x", None):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(bad,)], "label string").select(readers.strict_label(F.col("label"))).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.load(spark, "/no/such/file.csv")


def test_stream_goes_on_where_it_was(spark, tmp_path):
    """Files that come later are masked by the same query, and no row comes twice."""
    made = lambda i: spark.createDataFrame([(i, "mail a.b@mail.example.com")], "id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    made(1)
    schema = spark.read.parquet(str(tmp_path / "in")).schema

    def run():
        source = stream.masked_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).select("id", "masked", "email_count")
        source.writeStream.option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).format("parquet").trigger(availableNow=True).start().awaitTermination()

    run()
    made(2)
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "mail <EMAIL>", 1), (2, "mail <EMAIL>", 1)]


def test_streams_read_folders_of_part_files(spark, tmp_path):
    """A table may be one file or a folder; a text that is null has no count, as in SQL."""
    rows = [(i, None if i % 7 == 0 else "a@b.com x " * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "folder/documents.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file/documents.parquet")
    for d in ("folder", "file"):
        found = {r.doc_id: r.n for r in queries.QUERIES["stream_masked"](spark, str(tmp_path / d)).collect()}
        assert found == {i: None if text is None else i % 3 for i, text in rows}


def test_fits_that_differ_late_share_their_trees(monkeypatch):
    """A grid's fits of one fold are those that each combination has alone, rows that aren't learnt from are scored on the way, and equal beginnings are grown once."""
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 40, 900), rng.random(900) < 0.1, np.zeros(900)]).astype(float)
    y = (x[:, 0] + 0.05 * x[:, 1] + x[:, 2] + 0.7 * rng.normal(size=900) > 1.8).astype(int)
    edges = trees.edges_of(x[:700])
    bins = trees.Bins(np.concatenate([trees.codes_of(x[:700], edges), trees.codes_of(x[700:], edges)]), edges)
    base = trees.BOOSTED | {"trees": 25, "depth": 3}
    fits = [base | {"gamma": gamma, "child": child} for gamma in (0.0, 0.1, 2.0) for child in (1, 5)]
    grown, calls = trees.grown, []
    monkeypatch.setattr(trees, "grown", lambda *a: (calls.append(1), grown(*a))[1])
    together = trees.boosted(bins, y[:700], fits)
    assert len(calls) < 25 * len(fits)
    for p, (made, logit) in zip(fits, together, strict=True):
        assert made == trees.fit_boosted(x[:700], y[:700], p) and len(made) == 25
        assert trees.chances(logit) == pytest.approx(trees.Model("boosted", [], None, made, p["rate"]).probabilities(x))
    assert len({str(made) for made, _ in together}) > 1


def test_sums_of_a_sibling_are_exact():
    """A node's value comes from its own rows, also where its sums are what the other child leaves of the parent's."""
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.normal(size=500), rng.random(500) < 0.15, rng.integers(0, 9, 500)]).astype(float)
    g, h = trees.exact(rng.normal(size=500) * 1e3), trees.exact(rng.random(500) * 1e-3)
    edges = trees.edges_of(x)
    tree, ends, _, least = trees.grown(trees.Bins(trees.codes_of(x, edges), edges), g, h, trees.Growth(depth=5, child=1e-3), np.arange(3), rng, np.arange(400), np.arange(400, 500))
    assert sorted(np.concatenate([r for _, r in ends]).tolist()) == list(range(500)) and least >= 1e-3
    assert g.sum() == g[::-1].sum() == math.fsum(g)
    for node, r in ends:
        own = r[r < 400]
        assert tree.value[node] == -math.fsum(g[own]) / (math.fsum(h[own]) + 1.0)
        assert (tree.values(x)[r] == tree.value[node]).all()


def test_two_models_make_features_once(spark, monkeypatch):
    """The models learn from the features that the decisions rest on, which are those of extract_features."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    seen = []
    monkeypatch.setattr(queries, "_training", lambda *a: pytest.fail("features are made twice"))
    monkeypatch.setattr(ml, "train", lambda rows, kind="boosted": (seen.append(rows), trees.Model(kind, [], [], []))[1])
    monkeypatch.setattr(predict, "two_models", lambda known, one, other: (seen.append(known), known.selectExpr("doc_id", *(f"0 AS {c}" for c in ("one", "other", "confidence_one", "confidence_other", "agree", "gap"))))[1])
    queries.QUERIES["two_models"](spark, SF)
    monkeypatch.undo()
    rows, _, known = seen
    own = ["doc_id", "label", "sender_type", *K.FEATURES]
    want = [tuple(r) for r in queries._training(spark, SF).select(*own).collect()]
    assert sorted(map(tuple, rows.select(*own).collect())) == sorted(want) and len(want) == 87
    texts = {r.doc_id: (r.text, r.sender) for r in queries._messages(spark, SF).collect()}
    assert {r.doc_id: (r.text, r.sender) for r in known.collect()} == texts and known.count() == len(texts)


def _many(spark, n=200_600):
    """More labelled rows than fits once took."""
    x = F.pmod(F.col("doc_id") * 7919, F.lit(1000))
    return spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", x.cast("double").alias("x"), (x / 3).alias("z"), (x > 600).cast("int").alias("label"))


def test_grid_search_fits_all_rows(spark, monkeypatch):
    """Each fold's fits learn from all rows of the others and are scored by all of its own, however many these are."""
    n, seen, boosted = 200_600, [], trees.boosted
    monkeypatch.setattr(trees, "spread", lambda spark, jobs, run, at_once=64: [run(job) for job in jobs])
    monkeypatch.setattr(trees, "boosted", lambda bins, y, fits: (seen.append((len(y), len(bins.codes) - len(y))), boosted(bins, y, fits))[1])
    found = ml.grid_search(_many(spark, n), {"depth": [1]}, trees=1, sender=None, features=["x", "z"]).collect()
    assert [r.folds for r in found] == [5] and found[0].mean_auc > 0.99
    assert sum(own for _, own in seen) == n and {learnt + own for learnt, own in seen} == {n}


def test_narrow_columns_hold_their_values(spark):
    rows = [(i, i % 2, float(i % 3), -1.0 * i, i / 7, 70_000.0 * i, None if i == 4 else 2.0) for i in range(9)]
    _, x, y, also = ml.training_table(spark.createDataFrame(rows, "doc_id long, label int, a double, b double, c double, d double, e double"), list("abcde"), None, also=("doc_id",))
    order = also["doc_id"].astype(int).tolist()
    assert sorted(order) == list(range(9)) and y.tolist() == [i % 2 for i in order] and x[0].dtype == np.uint8
    for i, column in enumerate(x):
        assert column.astype(float).tolist() == pytest.approx([np.nan if rows[k][2 + i] is None else rows[k][2 + i] for k in order], abs=0, rel=0, nan_ok=True)


def test_two_models_learn_from_all_rows(spark, monkeypatch):
    """Both models of two_models: boosted and forest fit all labelled rows, however many these are."""
    n, seen, fitted = 200_600, [], trees.fitted
    monkeypatch.setattr(trees, "spread", lambda spark, jobs, run, at_once=64: [run(job) for job in jobs])
    monkeypatch.setattr(trees, "fitted", lambda kind, x, y, *more: (seen.append((kind, len(y), len(x[0]))), fitted(kind, x, y, *more))[1])
    rows = _many(spark, n)
    for kind in ("boosted", "forest"):
        assert len(ml.train(rows, kind, trees=1, features=["x", "z"], sender=None).trees) == 1
    assert seen == [("boosted", n, n), ("forest", n, n)]


def test_gains_come_from_the_rows_of_a_split(monkeypatch):
    """Over whole boosted fits, with columns of many bins, few bins and mostly one bin: each split's gain is that of the rows that go through it."""
    rng = np.random.default_rng(13)
    n = 4000
    x = np.column_stack([rng.normal(size=(n, 9)), rng.random((n, 3)) < [0.3, 0.05, 0.01], rng.integers(0, 30, n) * (rng.random(n) < 0.1), np.ones(n)]).astype(float)
    y = (x[:, 0] + x[:, 8] + 2 * x[:, 10] + 0.1 * x[:, 12] + rng.normal(size=n) > 1).astype(int)
    edges, grown, splits = trees.edges_of(x), trees.grown, []

    def checked(bins, g, h, how, columns, rng, rows, rest):
        made = grown(bins, g, h, how, columns, rng, rows, rest)
        tree, at = made[0], {0: rows}
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + how.ridge)
        for node, f in enumerate(tree.feature):
            if f >= 0:
                under = x[at[node], f] <= tree.threshold[node]
                low, high = at[tree.left[node]], at[tree.right[node]] = at[node][under], at[node][~under]
                splits.append((tree.gain[node], 0.5 * (score(low) + score(high) - score(at[node]))))
        return made

    monkeypatch.setattr(trees, "grown", checked)
    trees.boosted(trees.Bins(trees.codes_of(x, edges), edges), y, [trees.BOOSTED | {"trees": 40, "depth": 6, "gamma": gamma} for gamma in (0.0, 0.2)])
    assert len(splits) > 1000 and all(gain == pytest.approx(want, rel=1e-6) for gain, want in splits)


def test_sums_of_a_node_without_rare_values():
    """A column whose rare values are all in one child: the other child's sums of its usual bin are not whole numbers for that, and neither are its sibling's off."""
    a, b = np.repeat([0.0, 1.0], [400, 600]), (np.arange(1000) >= 950).astype(float)
    g, h = trees.exact(np.where(a == 0, 0.7003, -0.3001) + 0.9 * b), trees.exact(np.full(1000, 0.2337))
    x = np.column_stack([a, b])
    edges = trees.edges_of(x)
    tree = trees.grown(trees.Bins(trees.codes_of(x, edges), edges), g, h, trees.Growth(depth=2, child=1e-3), np.arange(2), np.random.default_rng(0), np.arange(1000))[0]
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    low, high, rare = a == 0, a == 1, b == 1
    assert tree.feature == [0, -1, 1, -1, -1]
    assert tree.gain[0] == pytest.approx(0.5 * (score(low) + score(high) - score(low | high)))
    assert tree.gain[2] == pytest.approx(0.5 * (score(high & ~rare) + score(rare) - score(high)))
