"""Text functions: normalisation, digits, tokens. Native wherever Spark can express them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.options import NORM, NormOptions

# Characters deleted, punctuation that becomes a space, scripts kept as they are written.
ZERO_WIDTH = "​-‏‪-‮⁠-⁤﻿"
DANDAS = "।॥،؛؟۔"
PROTECTED = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "MYANMAR", "KHMER", "THAI", "LAO", "TIBETAN", "ETHIOPIC", "CHEROKEE", "MONGOLIAN", "HANGUL", "HIRAGANA", "KATAKANA")
# First and last code points of the marks that are kept where not all are.
KEPT_MARKS = (
    (0x0300, 0x036F), (0x0483, 0x0489), (0x0591, 0x05BD), (0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x0900, 0x0903), (0x093A, 0x094F),
    (0x0951, 0x0957), (0x0962, 0x0963), (0x0E31, 0x0E31), (0x0E34, 0x0E3A), (0x0E47, 0x0E4E), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20F0), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F),
)


def trimmed(c: str | Column) -> Column:
    """White space cut from both ends; null becomes blank."""
    return F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def norm_plain(c: str | Column) -> Column:
    """Native normal form: lower case, '&' to 'and', other than letters, marks, digits and '_' to a space, white space collapsed.

    Equal to ``norm_text`` for ASCII; for other texts it leaves out compatibility and case folding.
    """
    text = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_\s]+", " "), r"\s+", " "))


def _is_protected(text: str) -> bool:
    return any(not ch.isascii() and unicodedata.name(ch, "").startswith(PROTECTED) for ch in text)


_DELETE = re.compile(f"[{ZERO_WIDTH}]")
_DELETE_HYPHEN = re.compile(f"[-{ZERO_WIDTH}]")
_DANDA = re.compile(f"[{DANDAS}]")


def _is_kept_mark(ch: str, options: NormOptions) -> bool:
    if options.keep_all_marks:
        return unicodedata.category(ch)[0] == "M"
    return any(a <= ord(ch) <= b for a, b in KEPT_MARKS)


def norm_python(text: str | None, options: NormOptions = NORM) -> str:
    """Script-aware normal form of one text."""
    if not text:
        return ""
    text = (_DELETE_HYPHEN if options.delete_hyphen else _DELETE).sub("", text)
    text = _DANDA.sub(" ", text) if _is_protected(text) else unicodedata.normalize("NFKC", text)
    text = text.casefold().replace("&", " and ")
    kept = (ch if ch == "_" or ch.isalnum() or _is_kept_mark(ch, options) else " " for ch in text)
    return " ".join("".join(kept).split())


def norm_text(c: str | Column, options: NormOptions = NORM) -> Column:
    """Script-aware normal form: native for ASCII; only other texts travel to Python, in Arrow batches."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    ascii_only = text.rlike(r"^\p{ASCII}*$")

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else norm_python(v, options))

    native = F.replace(text, F.lit("-"), F.lit("")) if options.delete_hyphen else text
    return F.when(ascii_only, norm_plain(native)).otherwise(fold(F.when(~ascii_only, text)))


def digit_runs(c: str | Column) -> Column:
    """Maximal runs of digits, in order, repeats kept."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{Nd}+"), F.lit(0))


def address_digits(c: str | Column) -> Column:
    return F.array_join(digit_runs(c), " ")


def words(c: str | Column) -> Column:
    """Non-empty tokens of a normal form."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def token_set(c: str | Column, least: int = 3) -> Column:
    """Distinct tokens of at least ``least`` characters, first-seen order."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) >= least))


def country_key(c: str | Column) -> Column:
    return F.lower(trimmed(c))


def window_keys(tokens: str | Column, k: int) -> Column:
    """Every window of k over the sorted distinct tokens, joined by spaces."""
    ordered = F.array_sort(F.array_distinct(tokens))
    n = F.size(ordered)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(ordered, i, k), " "))).otherwise(F.array().cast("array<string>"))


def pair_keys(tokens: str | Column) -> Column:
    """Every unordered pair of distinct tokens, as 'a b' with a < b."""
    ordered = F.array_sort(F.array_distinct(tokens))
    return F.flatten(F.transform(ordered, lambda a: F.transform(F.filter(ordered, lambda b: b > a), lambda b: F.concat_ws(" ", a, b))))


def id_prefix(c: str | Column) -> Column:
    """Text before the first '-', else NO_PREFIX."""
    return F.when(F.instr(c, "-") > 1, F.substring_index(c, "-", 1)).otherwise(F.lit("NO_PREFIX"))


def percent(a: Column, b: Column) -> Column:
    """Rounded share in percent; 0 of nothing."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * a / b, 4))


def profile_form(c: str | Column, level: int) -> Column:
    """Profiling normal forms: 0 trim and fold; 1 + compatibility; 2 + punctuation to space; 3 + white space collapsed; 4 + accents removed."""

    def form(text: str | None) -> str:
        text = (text or "").strip().casefold()
        if level >= 1:
            text = unicodedata.normalize("NFKC", text)
        if level >= 2:
            text = re.sub(r"[^\w\s]", " ", text)
        if level >= 3:
            text = " ".join(text.split())
        if level >= 4:
            text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
        return text

    @F.pandas_udf("string")
    def forms(values: pd.Series) -> pd.Series:
        return values.map(form)

    return forms(c)


def compact_form(c: str | Column) -> Column:
    """Trimmed, folded, letters and digits only."""
    return F.regexp_replace(F.lower(trimmed(c)), r"[^\p{L}\p{N}_]+", "")
