"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from smsward import constants as K

#: Every letter here is stable under NFC and none combines; text made of these needs no Python.
_STABLE = r"^[\x{0}-\x{2FF}\x{1E00}-\x{1EFF}]*+$"
_LATIN = [chr(c) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r]
_FOLDED = {c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") for c in _LATIN}
_FOLDED = {c: b for c, b in _FOLDED.items() if b != c and len(b) == 1}
#: Text of these is decomposed by the table above and by dropping marks: Latin letters, and the marks that combine with them.
_BY_TABLE = r"^[\x{0}-\x{36F}\x{1E00}-\x{1EFF}]*+$"
WORD = f"a-zA-Z0-9{K.VIETNAMESE}"


def _without_marks(s: str, form: str) -> str:
    """NFD without nonspacing marks, or NFKD without combining letters."""
    gone = unicodedata.combining if form == "NFKD" else (lambda c: unicodedata.category(c) == "Mn")
    return "".join(c for c in unicodedata.normalize(form, s) if not gone(c))


def _class(letters: list[str]) -> str:
    """A character class of these, as ranges."""
    codes, parts = sorted(map(ord, letters)), []
    for c in codes:
        if parts and parts[-1][1] == c - 1:
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in parts) + "]"


#: The letters of words in both cases, with those that fold to them, as ranges: Java tests a few ranges much faster than a list or the case flag.
LETTERS = _class([*"abcdefghijklmnopqrstuvwxyz", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *K.VIETNAMESE, *K.VIETNAMESE.upper(), *"ſıİ"])[1:-1]
#: As _BY_TABLE, less the letters that have a compatibility form.
_BY_TABLE_K = "^" + _class([c for c in map(chr, [*range(0x370), *range(0x1E00, 0x1F00)]) if _without_marks(c, "NFKD") == ("" if unicodedata.category(c) == "Mn" else _FOLDED.get(c, c))]) + "*+$"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def _nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else _without_marks(s, "NFD"))


@F.pandas_udf(StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else _without_marks(s, "NFKD"))


def _mostly(text: Column, common: str, quick: Column, full) -> Column:
    """quick where the text matches common; only the others are sent to Python."""
    is_common = text.rlike(common)
    return F.when(is_common, quick).otherwise(full(F.when(~is_common, text)))


def nfc(text: Column) -> Column:
    """Canonical composition; only texts that may change are sent to Python."""
    return _mostly(text, _STABLE, text, _nfc)


def fold_letters(text: Column) -> Column:
    """Base letters without marks, of text that is Latin, as tokens are: a column expression without Python."""
    return F.regexp_replace(F.translate(text, "".join(_FOLDED), "".join(_FOLDED.values())), r"\p{Mn}", "")


def strip_diacritics(text: Column) -> Column:
    """Base letters without marks, of any script; đ has no decomposition and stays."""
    return _mostly(text, _BY_TABLE, fold_letters(text), _nfd)


def keyword_fold(text: Column, fold_d: bool = False) -> Column:
    """Compatibility decomposition without marks, lower-cased: fullwidth and mathematical letters become plain ones."""
    out = F.lower(_mostly(text, _BY_TABLE_K, fold_letters(text), _nfkd))
    return F.translate(out, "đ", "d") if fold_d else out


def keyword_fold_v1(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(keyword_fold(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern of these literal words."""
    return "|".join(r"\Q" + w + r"\E" for w in words)


def char_count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def has_url(text: Column) -> Column:
    host = r"(?:[\w_-]++(?:\.[\w_-]++)++)"
    naked = rf"\b[a-zA-Z0-9-]+\.(?:{'|'.join(K.FLAG_TLDS)})(?:/\S*)?\b"
    return F.coalesce(text.rlike(rf"(?iU)(?:http|ftp|https)://{host}|www\.{host}|{naked}").cast("int"), F.lit(0))


def has_phone_number(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?U){K.FLAG_PHONE}").cast("int"), F.lit(0))


def classify_sender(sender: Column) -> Column:
    s = F.trim(F.coalesce(sender, F.lit("nan")))
    return F.when(s.rlike("[a-zA-Z]"), "brandname").when(s.rlike(r"(?U)^\d{3,8}$"), "shortcode").when(s.rlike(r"(?U)^(\+84|84|0)\d{9,10}$"), "personal_number").otherwise("unknown")


def tokens(text: Column) -> Column:
    """Tags as they are; runs of letters and digits, lower-cased."""
    found = F.regexp_extract_all(text, F.lit(rf"<[A-Za-z_]+>|[0-9{LETTERS}]+"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.startswith("<"), t).otherwise(F.lower(t)))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def conversational(folded: Column) -> Column:
    return folded.rlike(rf"(?U)\b(?:{'|'.join(K.CONVERSATION_WORDS)})\b") | folded.rlike(any_of(K.CONVERSATION_PHRASES))


def dangerous(folded: Column) -> Column:
    return folded.rlike(any_of(K.DANGER))
