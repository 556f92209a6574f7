"""I-Match fingerprints, by DataFrame functions only.

Terms are the distinct lower-cased runs of letters and digits. The lexicon is the band of terms that LOW to
HIGH of all documents hold; since a document's terms are shared out among them, it has at most (mean number
of terms) / LOW entries however large the corpus. Up to MAX_LEXICON entries are made part of the plan; beyond, terms
meet the lexicon in a join, with the same results.
LEXICONS fixed subsets of the lexicon are drawn at random, by hash of the term: EACH at each rate from 1/4 to
1/512, so that texts of few and of many terms have subsets that hold a few of theirs. A signature is the hash of a
text's terms of one subset, in the order of their hashes; 0 where it has none. The fingerprint is all signatures.
Likeness is the share of equal signatures among the subsets of which either text has a term.

The next document is found on narrow rows (id, hash and length of the text), sorted by ranges; then each text moves once to its
own place and its beginning once to the one before, so a task holds as much as any other, whatever the ids.

Cases: null texts are empty texts; a text without a term in any subset has signatures of all its terms, and
so has the empty text; documents are ordered by doc_id, then hash of the text, null doc_ids last; rows with the same
doc_id and text are one document in that order, and reported each; the only document is its own next; further columns
aren't read; long texts are taken whole. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smsward.llm.common import join_groups, written

LOW, HIGH = 0.01, 0.25
RATES, EACH = range(2, 10), 8  # subsets hold each term with chance 2 ** -rate
LEXICONS = len(RATES) * EACH
MAX_LEXICON = 60_000
COPIES = 10_000
_LAST = (1 << 63) - 1
_NOTHING = 42  # xxhash64 of an empty array


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def _hashed(text: Column) -> Column:
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int] | DataFrame:
    """64-bit hashes of the terms of the band, from the document frequencies over all documents; as a table (t, df) where they are many."""
    n = docs.count()
    counts = docs.select(F.explode(_hashed(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = written(counts.filter((F.col("df") >= max(1.0, low * n)) & (F.col("df") <= high * n)), "lexicon")
    return band if band.count() > MAX_LEXICON else sorted(r.t for r in band.select("t").collect())


def _with_band(df: DataFrame, text: str, band: list[int] | DataFrame) -> DataFrame:
    """df with _all (hashes of all terms) and _band (of those in the lexicon), both sorted."""
    if isinstance(band, list):
        df = df.withColumn("_all", F.sort_array(_hashed(F.col(text))))
        return df.withColumn("_band", F.filter("_all", lambda t: t.isin(band)) if band else F.slice("_all", 1, 0))
    keys = [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), F.col(text), F.length(text)).alias("_k2")]
    held = df.select(*keys, F.explode(_hashed(F.col(text))).alias("t")).distinct()
    met = join_groups(held, band, ["t"], "df").groupBy("_k1", "_k2").agg(F.collect_set("t").alias("_t"))
    df = df.withColumn("_all", F.sort_array(_hashed(F.col(text)))).withColumns(dict(zip(("_k1", "_k2"), keys, strict=True)))
    return df.join(met, ["_k1", "_k2"], "left").withColumn("_band", F.coalesce(F.sort_array("_t"), F.slice("_all", 1, 0))).drop("_k1", "_k2", "_t")


def member_of(t: Column) -> Column:
    """Of a term's hash, a bit for each subset that holds it: subset EACH * i + j has rate RATES[i]."""
    mask, bits, found = F.xxhash64(t, F.lit(0)), F.lit(0).cast("long"), 0
    for rate in range(2, max(RATES) + 1):
        mask = mask.bitwiseAND(F.xxhash64(t, F.lit(rate)))  # each bit is set with chance 2 ** -rate
        if rate in RATES:
            own = ((1 << EACH) - 1) << found
            bits = bits.bitwiseOR(mask.bitwiseAND(_long(own)))
            found += EACH
    return bits


def _in_any(array: str, first: int, until: int) -> Column:
    """The entries whose term is in any of the subsets from `first` to before `until`."""
    own = ((1 << until) - 1) & ~((1 << first) - 1)
    return F.filter(array, lambda x: x["m"].bitwiseAND(_long(own)) != 0)


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits)


def fingerprint(df: DataFrame, text: str, name: str, band: list[int] | DataFrame) -> DataFrame:
    """df with the column `name`: an array of a signature for each lexicon."""
    df = _with_band(df, text, band)
    df = df.withColumn("_band", F.transform("_band", lambda t: F.struct(t.alias("t"), member_of(t).alias("m"))))
    # subsets of low rates look for their terms among those that any of them holds
    starts = [0, 3 * EACH, 5 * EACH]
    df = df.withColumns({f"_b{a}": _in_any("_band", a, LEXICONS) for a in starts})
    held = [_in_any(f"_b{max(a for a in starts if k >= a)}", k, k + 1) for k in range(LEXICONS)]
    df = df.withColumn("_h", F.array(*[F.xxhash64(h) for h in held]))
    short = lambda h: F.shiftright(h, 32).cast("int")
    none = (F.array_min("_h") == _NOTHING) & (F.array_max("_h") == _NOTHING)
    whole = F.transform("_h", lambda h, i: short(F.xxhash64(F.col("_whole"), i)))
    made = F.when(none, whole).otherwise(F.transform("_h", lambda h: F.when(h == _NOTHING, 0).otherwise(short(h))))
    return df.withColumn("_whole", F.xxhash64("_all")).withColumn(name, made).drop("_all", "_band", "_h", "_whole", *(f"_b{a}" for a in starts))


def shown(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.substring(F.lpad(F.hex(s.cast("long")), 16, "0"), 9, 8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal signatures among those of subsets with a term in either text."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != 0) | (p["b"] != 0))
    return F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda p: p["a"] == p["b"])) / F.size(pairs)).otherwise(1.0)


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs: at, h, n. Of each distinct (at, h) in ascending order the one before (before the first: the last): p_at, p_h, p_n and p_c (its
    rows); and the most rows of one."""
    keys = docs.groupBy("at", "h").agg(F.first("n").alias("n"), F.count("*").alias("c"))
    ranged = written(keys.repartitionByRange("at", "h").withColumn("r", F.spark_partition_id()), "ids")
    ends = ranged.groupBy("r").agg(F.max(F.struct("at", "h", "n", "c")).alias("end"), F.max("c").alias("c")).orderBy("r").collect()  # a row a range
    before = [(r.r, *ends[i - 1].end) for i, r in enumerate(ends)]
    edge = docs.sparkSession.createDataFrame(before, "r int, e_at long, e_h long, e_n int, e_c long")
    own = Window.partitionBy("r").orderBy("at", "h")
    placed = ranged.withColumn("p", F.lag(F.struct("at", "h", "n", "c")).over(own)).join(F.broadcast(edge), "r")
    return placed.select("at", "h", *(F.coalesce(f"p.{c}", f"e_{c}").alias(f"p_{c}") for c in ("at", "h", "n", "c"))), max((r.c for r in ends), default=0)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), and fingerprints of both, with likenesses to the edit and to the next document."""
    docs = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("at"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    before, most = neighbours(docs.select("at", "h", F.length("text").alias("n")))
    band = lexicon(docs)
    own = fingerprint(docs, "text", "own", band)
    if most > 1:
        own = own.groupBy("at", "h").agg(F.first("text").alias("text"), F.first("own").alias("own"))
    # both joins deal the texts by the same key: that is one shuffle of them, read twice
    sent = own.join(before.hint("merge"), ["at", "h"]).select(
        F.col("p_at").alias("at"), F.col("p_h").alias("h"), "p_c", F.substring("text", F.lit(1), F.floor(F.col("p_n") / 2).cast("int")).alias("start"), F.col("own").alias("next_own"),
    )
    paired = own.join(sent.hint("merge"), ["at", "h"])
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.floor(F.length("text") / 2).cast("int")), F.col("start"))
    made = fingerprint(paired.select("at", "h", "p_c", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own"), "edited", "changed", band)
    if most > COPIES:  # copies of one row are dealt out before they are made
        made = made.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("p_c") - 1) / COPIES).cast("int")))).repartition("at", "h", "part")
        made = made.withColumn("p_c", F.least(F.lit(COPIES), F.col("p_c") - F.col("part") * COPIES))
    if most > 1:
        made = made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("p_c").cast("int"))))
    return made.select(
        F.nullif("at", F.lit(_LAST)).alias("doc_id"), "n_chars", "edited", shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
