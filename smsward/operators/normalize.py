"""Layers 2 to 4: leet decoding, separators, tokens, whitelist, misspelling, and the 27 features.

A dictionary of up to SMALL bytes is sent to all tasks, so that tokens meet it where they are and no frequent word is
a hot key; a larger one meets the distinct tokens in a shuffle, and verdicts return to tokens by word. Messages are known by a row
number of their own, so equal and null keys keep their rows apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smsward import constants as K
from smsward.functions.text import LETTERS, char_count, fold_letters, nfc, strip_diacritics, tokens
from smsward.operators.mask import mask
from smsward.scratch import written

_WORDS = rf"(?U)\b[{LETTERS}]+\b"
_BANG = rf"(?iU)(?<=[{LETTERS}])!(?=[{LETTERS}])"
SMALL = 64 << 20
_SEPARATOR = r"['\-~:;,.\"*^{}\[\]()/|\\!]"
#: A tag becomes letters, so that a digit beside it counts as it would beside a word; no text is lost whatever their number.
_HIDE, _SHOW = (r"<([A-Z_]+)>", "ZQXTAG$1GATXQZ"), (r"(?i)ZQXTAG([A-Z_]+?)GATXQZ", "<$1>")


def normalize(df: DataFrame, text: str = "masked") -> DataFrame:
    """df with leet and separator counts, normalized and tokens; and of texts that decoding changed, original_words and decoded_words."""
    keep = df.columns
    out = df.withColumn("_t", F.regexp_replace(nfc(F.coalesce(F.col(text), F.lit(""))), *_HIDE))
    out = out.withColumns({
        "leet_count": char_count(F.col("_t"), K.LEET_COUNTED), "_char": char_count(F.col("_t"), "@$"),
        "_o": F.col("_t"),
    })
    out = out.withColumn("_t", F.translate("_t", *K.LEET_MAP))
    groups: dict[str, list[str]] = {"teencode": [], "visual": [], "symbol": []}
    steps = [("teencode", p, r) for p, r in K.TEENCODE] + [("visual", p, r) for p, r in K.VISUAL_LEET] + [("symbol", _BANG, "i")]
    for i, (group, pattern, to) in enumerate(steps):
        groups[group].append(f"_n{i}")
        p = pattern if pattern.startswith("(?iU)") else f"(?iU){pattern}"
        held = "!" if pattern is _BANG else next((c for c in "013458" if c in pattern), None)  # what all matches hold
        hit = F.contains("_t", F.lit(held)) if held else F.col("_t").rlike("(?iu)[ck][ko]")
        count, text_ = F.when(hit, F.regexp_count("_t", F.lit(p))).otherwise(0), F.when(hit, F.regexp_replace("_t", p, to)).otherwise(F.col("_t"))
        out = out.select(*[c for c in out.columns if c != "_t"], count.alias(f"_n{i}"), text_.alias("_t"))
    total = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    decoded, none = F.col("_t") != F.col("_o"), F.array().cast("array<string>")
    out = out.withColumns({"teencode_count": total(groups["teencode"]), "visual_leet_count": total(groups["visual"]), "_bang": total(groups["symbol"])})
    out = out.withColumns({
        "symbol_leet_count": F.col("_char") + F.col("_bang"),
        "weighted_leet_score": F.round(1.5 * F.col("_char") + 0.3 * F.col("teencode_count") + F.col("visual_leet_count") + 1.2 * F.col("_bang"), 6),
        "original_words": F.when(decoded, F.transform(F.regexp_extract_all("_o", F.lit(_WORDS), F.lit(0)), lambda w: F.lower(w))).otherwise(none),
        "decoded_words": F.when(decoded, F.regexp_extract_all(F.regexp_replace("_t", *_SHOW), F.lit(_WORDS), F.lit(0))).otherwise(none),
        "separator_count": F.regexp_count("_t", F.lit(_SEPARATOR)),
        "_t": F.trim(F.regexp_replace(F.regexp_replace("_t", _SEPARATOR, " "), r"(?U)\s+", " ")),
    })
    out = out.withColumn("tokens", tokens(F.regexp_replace("_t", *_SHOW)))
    names = ["leet_count", "teencode_count", "visual_leet_count", "symbol_leet_count", "separator_count", "weighted_leet_score", "original_words", "decoded_words", "tokens"]
    return out.select(*keep, *names, F.array_join("tokens", " ").alias("normalized"))


def whitelisted(token: Column, repaired: bool = False, custom: list[str] | None = None) -> Column:
    """In the fixed lists or the custom one, all digits, without letters and digits, a tag, or of one character."""
    known = sorted({*K.BRANDS, *K.JARGON, *K.SLANG, *K.ENTITY_TOKENS, *(K.WHITELIST_REPAIRED if repaired else ()), *(custom or ())})
    return token.isin(known) | (F.length(token) <= 1) | (token.startswith("<") & token.endswith(">")) | token.rlike(r"(?U)^(?:\d+|[^\p{L}\p{N}]*)$")


def split_whitelist(df: DataFrame, repaired: bool = False, custom: list[str] | None = None) -> DataFrame:
    """df with to_check, whitelisted_tokens and whitelist_count; custom: words of a whitelist file. A column that isn't used costs nothing."""
    out = df.withColumns({"to_check": F.filter("tokens", lambda t: ~whitelisted(t, repaired, custom)), "whitelisted_tokens": F.filter("tokens", lambda t: whitelisted(t, repaired, custom))})
    return out.withColumn("whitelist_count", F.size("tokens") - F.size("to_check"))


def first_brand(token_list: Column) -> Column:
    return F.get(F.filter(token_list, lambda t: t.isin(list(K.BRANDS))), F.lit(0))


def eligible(token: Column) -> Column:
    return (F.length(F.trim(token)) >= 2) & ~token.rlike(r"(?U)^\d+$") & ~token.rlike(r"(?iU)^\d+(gb|mb|tb|kb|gbps|mbps|kbps)$")


def gibberish(token: Column) -> Column:
    folded = fold_letters(token)
    return ~folded.rlike("(?i)[aeiouy]") | folded.rlike("(?i)[bcdfghjklmnpqrstvwxyz]{4,}")


def repeated_char(token: Column) -> Column:
    return F.lower(token).rlike(r"(.)\1{2,}")


def broken_telex(token: Column) -> Column:
    return token.rlike(rf"(?i)^[a-z]*(?:{'|'.join(K.TELEX)})[a-z]*$")


def shadow_of(words: DataFrame) -> DataFrame:
    return words.select(strip_diacritics(F.col("word")).alias("word")).distinct()


@dataclass(frozen=True)
class Dictionary:
    """Distinct words as they are and without diacritics; small: both may be sent to all tasks."""

    full: DataFrame
    shadow: DataFrame
    small: bool

    @staticmethod
    def of(full: DataFrame, shadow: DataFrame | None = None, most: int = SMALL) -> Dictionary:
        """Writes both tables once, as they are read several times, and checks their size."""
        full = written(full.select("word").filter("word IS NOT NULL").distinct(), "words")
        shadow = written((shadow if shadow is not None else shadow_of(full)).select("word").distinct(), "shadow")
        size = full.union(shadow).agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0
        return Dictionary(full, shadow, size <= most)

    @staticmethod
    def empty(spark: SparkSession) -> Dictionary:
        """The explicit mode without a dictionary: no word is known, and no decoded word is valid."""
        none = spark.createDataFrame([], "word string")
        return Dictionary(none, none, True)

    def sent(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def _looked_up(words: DataFrame, dic: Dictionary) -> DataFrame:
    own = words.withColumn("_s", fold_letters(F.col("word")))
    own = own.join(dic.sent(dic.full.select("word", F.lit(True).alias("_full"))), "word", "left")
    own = own.join(dic.sent(dic.shadow.select(F.col("word").alias("_s"), F.lit(True).alias("_shadow"))), "_s", "left")
    return own.withColumn("known", F.col("_full").isNotNull() | F.col("_shadow").isNotNull()).drop("_s", "_full", "_shadow")


def with_known(words: DataFrame, dic: Dictionary) -> DataFrame:
    """words (column word, and others) with known: by the full dictionary or, folded, by the shadow one."""
    if dic.small:
        return _looked_up(words, dic)
    return words.join(known_words(words, dic), "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def known_words(candidates: DataFrame, dic: Dictionary) -> DataFrame:
    """Of the distinct words (column word): known."""
    return _looked_up(candidates.select("word").distinct(), dic)


def run_on(candidates: DataFrame, dic: Dictionary) -> DataFrame:
    """Of the distinct words: those made of two shadow words, each of two letters at least."""
    own = candidates.select("word").filter(F.col("word").rlike(r"(?U)^\p{L}{4,}$")).distinct().withColumn("_s", fold_letters(F.col("word")))
    cuts = own.filter(F.length("_s") >= 4).withColumn("i", F.explode(F.sequence(F.lit(2), F.length("_s") - 2)))
    parts = cuts.select("word", F.expr("substring(_s, 1, i)").alias("a"), F.expr("substring(_s, i + 1)").alias("b"))
    left, right = dic.shadow.select(F.col("word").alias("a")), dic.shadow.select(F.col("word").alias("b"))
    return parts.join(dic.sent(left), "a", "left_semi").join(dic.sent(right), "b", "left_semi").select("word").distinct()


_ZEROS = ["oov_count", "oov_density", "broken_telex_count", "longest_oov_length", "gibberish_count", "repeated_char_count", "run_on_word_count", "validated_leet_count"]


def misspell(df: DataFrame, dic: Dictionary) -> DataFrame:
    """df (with to_check, original_words, decoded_words) with the out-of-vocabulary features and validated_leet_count.

    Each row is judged alone, whatever its columns hold: rows get numbers as the table is written."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    words = with_known(rows.select("_row", F.posexplode("to_check").alias("pos", "word")).filter(eligible(F.col("word"))), dic)
    words = words.withColumn("oov", ~F.col("known"))
    # each unknown word is judged once, however often it occurs
    w = F.col("word")
    odd = written(words.filter("oov").select("word").distinct(), "unknown")
    flags = odd.join(run_on(odd, dic).withColumn("run", F.lit(True)), "word", "left").select("word", gibberish(w).alias("gib"), repeated_char(w).alias("rep"), F.col("run").isNotNull().alias("run"))
    flags = written(flags.withColumn("telex", ~F.col("rep") & broken_telex(w)), "flags")
    few = (flags.agg(F.sum(F.octet_length("word") + 48)).first()[0] or 0) <= SMALL
    words = words.join(F.broadcast(flags) if few else flags, "word", "left")
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("int")
    per = words.groupBy("_row").agg(
        n("oov").alias("oov_count"), F.round(n("oov") / F.count("*"), 6).alias("oov_density"), n("telex").alias("broken_telex_count"),
        F.coalesce(F.max(F.when(F.col("oov"), F.length("word"))), F.lit(0)).alias("longest_oov_length"), n("gib").alias("gibberish_count"), n("rep").alias("repeated_char_count"),
        F.min(F.when(F.col("gib"), F.col("pos"))).alias("_first"), F.collect_list(F.when(F.col("run"), F.col("pos"))).alias("_runs"),
    )
    per = per.withColumn("run_on_word_count", F.size(F.filter("_runs", lambda p: F.col("_first").isNull() | (p < F.col("_first"))))).drop("_first", "_runs")
    # words that decoding made: a bag, but only texts with such words are looked at word by word
    fresh = F.array_except(F.transform("decoded_words", lambda x: F.lower(x)), F.col("original_words"))
    new = rows.select("_row", "decoded_words", fresh.alias("fresh")).filter(F.size("fresh") > 0)
    new = new.select("_row", F.explode("decoded_words").alias("w"), "fresh").filter(F.array_contains("fresh", F.lower("w")))
    valid = with_known(new.select("_row", F.lower("w").alias("word")), dic).filter("known").groupBy("_row").agg(F.count("*").cast("int").alias("validated_leet_count"))
    out = rows.join(per, "_row", "left").join(valid, "_row", "left")
    return out.fillna(0, _ZEROS).drop("_row")


def featured(df: DataFrame, dic: Dictionary, text: str = "text", entities: bool = False) -> DataFrame:
    """All columns of df, what the layers make of its text (masked, counts, normalized, tokens, ...) and the 27 features."""
    # each layer is written once: as one projection their code is too large to be compiled, and the dictionary steps read tokens several times
    masked = written(mask(df, text, entities=entities), "masked")
    return misspell(split_whitelist(normalize(masked)), dic)


def extract_features(df: DataFrame, full: DataFrame | Dictionary, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the kept columns and the 27 features, in their order; a row for each row of df, equal and null keys too."""
    dic = full if isinstance(full, Dictionary) else Dictionary.of(full)
    columns = dict.fromkeys([key, *keep])
    masked = written(mask(df.select(*dict.fromkeys([*columns, text])), text, entities=False).select(*columns, "masked", *K.ENTITY_COLUMNS), "masked")
    ready = split_whitelist(normalize(masked)).drop("masked", "normalized", "whitelisted_tokens", "tokens")
    return misspell(ready, dic).select(*columns, *K.FEATURES)
