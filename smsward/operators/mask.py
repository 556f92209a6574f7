"""Entity masking: an ordered registry of rules over a text column.

Each rule is one projection that adds its extracted entities and rewrites the text, so a text is
scanned once a rule and nothing leaves the JVM. User rules go into the registry like the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsward import constants as K
from smsward.functions.text import nfc

_PATH = r"(?:/[\w\-.?=&%]*)?"
_SAFE, _RISKY = "|".join(K.SAFE_TLDS), "|".join(K.RISKY_TLDS)
SHORTENER = r"(?iU)\b(?:b\s*i\s*t|t|tinyurl)\s*[.,]\s*l\s*y\b(?:[/\s]+[\w\-.?=&%]+)?"
#: The scattered letters after the dot are any run of letters and spaces, so one class stands for the repeated group.
OBFUSCATED = r"(?iU)\b(?:[a-z0-9]\s+)+[a-z0-9]\s*(?:\.|dot|\(\.\)|\[\.\])\s*[a-z][a-z\s]*(?:/\s*[\w\-\s]+)?"
#: Words that may span spaces: one class again, which Java matches without recursion.
PROTOCOL = rf"(?iU)\b(?:https?://|www\.)[\w\-.](?:[\w\-.\s]*[\w\-.])?\.[a-z]{{2,10}}\b{_PATH}"
SCHEMELESS_SAFE = rf"(?iU)\b[\w\-]+(?:\s*\.\s*[\w\-]+)*\s*\.\s*(?:{_SAFE})\b{_PATH}"
SCHEMELESS_RISKY = rf"(?iU)\b[\w\-]+(?:\.[\w\-]+)*\.(?:{_RISKY})\b{_PATH}"
BANK = rf"(?iU)\b({'|'.join(K.BANK_WORDS)})[\s:.\-|]*?(\d{{8,19}})(?!\d)"
KNOWN_SHORTCODE = rf"(?U)\b(?:{'|'.join(K.SHORTCODES)})\b"
CONTEXT_SHORTCODE = rf"(?iU)\b({'|'.join(K.SHORTCODE_WORDS)})\s+(\d{{3,6}})\b"
MONEY = rf"(?iU)\b(?:\d+(?:[.,]\d+)*\s*(?:{'|'.join(K.MONEY_UNITS)})\b|[1-9]\d{{0,2}}(?:[.,]\d{{3}})+)(?!\d)"
#: At most 8 characters, a known prefix, and not one 0 or 1 between letters only.
CODE = rf"(?U)\b(?=[A-Z0-9]{{2,8}}\b)(?![A-Z]+[01][A-Z]+\b)(?:{'|'.join(K.CODE_PREFIXES)})[0-9][A-Z0-9]*\b"
OTP = r"(?U)(?<![\w<])(?!(?:19|20)\d\d(?!\d))\d{4,6}(?![\w>])"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _compact(found: Column) -> Column:
    return F.transform(found, lambda u: F.regexp_replace(u, r"(?U)\s+", ""))


@dataclass(frozen=True)
class MaskRule:
    """label: the entity; find: text -> entities; replace: text -> text; guard: a quick pattern that all its matches hold."""

    label: str
    find: Callable[[Column], Column]
    replace: Callable[[Column], Column]
    guard: str = ""


def pattern_rule(label: str, pattern: str, token: str, guard: str = "") -> MaskRule:
    return MaskRule(label, lambda t: _all(t, pattern), lambda t: F.regexp_replace(t, pattern, token), guard)


def keyword_rule(label: str, pattern: str, token: str, guard: str = "") -> MaskRule:
    """The pattern's first group stays, its second is the entity."""
    return MaskRule(label, lambda t: _all(t, pattern, 2), lambda t: F.regexp_replace(t, pattern, f"$1 {token}"), guard)


def url_rule(pattern: str, guard: str = "") -> MaskRule:
    return MaskRule("url", lambda t: _compact(_all(t, pattern)), lambda t: F.regexp_replace(t, pattern, "<URL>"), guard)


def obfuscated(match: Column) -> Column:
    """Whether a candidate is an obfuscated address: spaced out, long enough, not about a well-known site."""
    spaces = F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit("")))
    before_dot = F.split_part(match, F.lit("."), F.lit(1))
    exempt = F.lower(match).rlike("|".join(K.OBFUSCATION_EXEMPT))
    dotted = match.contains("(.)") | match.contains(" . ") | match.contains("( . )")
    return (spaces / F.length(match) >= 0.05) & ~exempt & (F.length(match) >= 8) & (before_dot.contains(" ") | dotted)


def _rebuild(text: Column) -> Column:
    """Pieces between candidates, joined by the tag or by the candidate itself."""
    joined = F.zip_with(F.split(text, OBFUSCATED, -1), _all(text, OBFUSCATED), lambda piece, m: F.concat(piece, F.when(m.isNull(), F.lit("")).when(obfuscated(m), F.lit("<URL>")).otherwise(m)))
    return F.when(text.rlike(OBFUSCATED), F.array_join(joined, "")).otherwise(text)


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)<URL>[\w.\-/]+", "<URL>"), r"(?U)\s+", " "))


_NONE = lambda t: F.array().cast("array<string>")
_I = "(?iU)"
_S = r"[\s\p{Z}\x{85}]*"
REGISTRY: list[MaskRule] = [
    pattern_rule("zalo", _I + K.ZALO, "<APP_LINK>", r"(?i)zalo\."),
    pattern_rule("telegram", _I + K.TELEGRAM, "<APP_LINK>", r"(?i)\.me/"),
    pattern_rule("email", _I + K.EMAIL, "<EMAIL>", "@"),
    url_rule(SHORTENER, rf"(?i)t{_S}[.,]{_S}l|tinyurl"),
    MaskRule("url", lambda t: _compact(F.filter(_all(t, OBFUSCATED), obfuscated)), _rebuild, rf"(?iu)[\s\p{{Z}}\x{{85}}][a-z0-9]{_S}(?:\.|dot|\(\.\)|\[\.\])"),
    url_rule(PROTOCOL, "(?iu)https?://|www[.]"),
    url_rule(SCHEMELESS_SAFE, rf"(?iu)\.{_S}(?:{_SAFE})"),
    url_rule(SCHEMELESS_RISKY, rf"(?iu)\.(?:{_RISKY})"),
    MaskRule("url", _NONE, _tidy),
    keyword_rule("bank_acc", BANK, "<BANK_ACC>", r"\p{Nd}{8}"),
    pattern_rule("hotline", "(?U)" + K.HOTLINE, "<PHONE>", "1[89]00"),
    pattern_rule("landline", "(?U)" + K.LANDLINE, "<PHONE>", r"02\p{Nd}"),
    pattern_rule("mobile", "(?U)" + K.MOBILE, "<PHONE>", "84|0[35789]"),
    pattern_rule("shortcode", KNOWN_SHORTCODE, "<PHONE>", f"[{''.join(sorted({c[0] for c in K.SHORTCODES}))}][0-9]{{2}}"),
    keyword_rule("shortcode", CONTEXT_SHORTCODE, "<PHONE>", r"\p{Nd}{3}"),
    pattern_rule("datetime", _I + K.DATETIME, "<TIME>", r"\p{Nd}"),
    pattern_rule("money", MONEY, "<MONEY>", r"\p{Nd}"),
    pattern_rule("code", CODE, "<CODE>", "[A-Z][0-9]"),
    pattern_rule("code", OTP, "<CODE>", r"\p{Nd}{4}"),
]


def mask(df: DataFrame, text: str = "text", registry: list[MaskRule] | None = None, entities: bool = True) -> DataFrame:
    """df with masked, <label>_count of each label and, if asked for, entities (map of label to list)."""
    rules = registry or REGISTRY
    out, parts = df.withColumn("_m", nfc(F.coalesce(F.col(text), F.lit("")))), {}
    for i, rule in enumerate(rules):
        parts.setdefault(rule.label, []).append(f"_f{i}")
        t = F.col("_m")
        find, to = rule.find(t), rule.replace(t)
        if rule.guard:
            hit = t.rlike(rule.guard)
            find, to = F.when(hit, find).otherwise(_NONE(t)), F.when(hit, to).otherwise(t)
        out = out.select(*[c for c in out.columns if c != "_m"], find.alias(f"_f{i}"), to.alias("_m"))
    counts = [sum((F.size(c) for c in cols[1:]), F.size(cols[0])).alias(f"{label}_count") for label, cols in parts.items()]
    found = F.create_map(*[x for label, cols in parts.items() for x in (F.lit(label), F.concat(*cols))])
    more = [F.map_filter(found, lambda k, v: F.size(v) > 0).alias("entities")] if entities else []
    return out.select(*df.columns, F.col("_m").alias("masked"), *counts, *more)
