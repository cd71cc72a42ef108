"""Normalisation and masking of texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from . import rx

_MARKS = ".,;:!?¡¿"
_BRACKETS = (r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}")
#: Every code point whose canonical decomposition is one character and marks.
_ACCENTED = {
    chr(k): d for k in range(0xC0, 0x2000) for d in ["".join(x for x in unicodedata.normalize("NFD", chr(k)) if unicodedata.category(x) != "Mn")] if len(d) == 1 and d != chr(k)
}


def strip_accents(c: Column | str) -> Column:
    """Letters without combining marks (canonical decomposition below U+2000, by a table)."""
    return rx.sub(F.translate(rx.col(c), "".join(_ACCENTED), "".join(_ACCENTED.values())), r"\p{Mn}+")


def normalize_text(
    c: Column | str,
    lowercase: bool = True,
    remove_punctuation: bool = True,
    normalize_whitespace: bool = True,
    remove_accents: bool = False,
    remove_parentheses_content: bool = False,
    strip_quotes: bool = True,
    preserve_alphanumeric_only: bool = False,
) -> Column:
    """The steps that are asked for, in this order: brackets, quotes, accents, case, punctuation that
    is not within a word, everything but letters and digits, white space. Blank gives ''."""
    src = out = rx.col(c)
    if remove_parentheses_content:
        for pattern in _BRACKETS:
            out = rx.sub(out, pattern)
    if strip_quotes:
        out = F.translate(out, "\"'“”‘’", "")
    if remove_accents:
        out = strip_accents(out)
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = rx.sub(out, rf"(?<!\w)[{_MARKS}](?!\w)", " ")
        out = rx.sub(out, rf"[{_MARKS}]+(?=\n?\z)")
        out = rx.sub(out, rf"\A[{_MARKS}]+")
        out = rx.sub(out, rf"\s+[{_MARKS}]+\s+", " ")
    if preserve_alphanumeric_only:
        out = rx.sub(out, r"[^a-zA-Z0-9\s]", " ")
    if normalize_whitespace:
        out = rx.squeeze(out)
    return F.when(rx.has(src, r"\S"), out).when(src.isNotNull(), F.lit(""))


def normalize_whitespace(c: Column | str) -> Column:
    return rx.squeeze(c)


def remove_punctuation_marks(c: Column | str, preserve_hyphens: bool = True) -> Column:
    return F.translate(rx.col(c), _MARKS if preserve_hyphens else _MARKS + "-", "")


def remove_special_characters(c: Column | str, keep_spaces: bool = True, keep_hyphens: bool = False) -> Column:
    pattern = f"[^a-zA-Z0-9{chr(92) + 's' if keep_spaces else ''}{chr(92) + '-' if keep_hyphens else ''}]"
    return rx.squeeze(rx.sub(c, pattern, " ")) if keep_spaces else rx.sub(c, pattern)


def remove_parentheses_and_content(c: Column | str) -> Column:
    out = rx.col(c)
    for pattern in _BRACKETS:
        out = rx.sub(out, pattern)
    return rx.squeeze(out)


def strip_quotes(c: Column | str) -> Column:
    """Without straight quotes; commas followed by a space go too, as callers expect."""
    return F.replace(F.translate(rx.col(c), "\"'", ""), F.lit(", "), F.lit(""))


def prepare_for_comparison(c: Column | str, aggressive: bool = False) -> Column:
    return normalize_text(c, remove_accents=aggressive, remove_parentheses_content=aggressive, preserve_alphanumeric_only=aggressive)


def mask_text(c: Column | str, keep_first: int = 1, keep_last: int = 1, mask_char: str = "*", keep_chars: str | None = None) -> Column:
    """The middle masked; texts that are no longer than what is kept stay. NULL gives ''."""
    c = F.coalesce(rx.col(c), F.lit(""))
    n = F.length(c)
    keep = f"[^{rx.char_class(keep_chars)}]" if keep_chars else "(?s)."
    by = mask_char.replace("\\", "\\\\").replace("$", "\\$")
    middle = F.regexp_replace(F.substring(c, F.lit(keep_first + 1), n - keep_first - keep_last), keep, by)
    tail = F.substring(c, n - keep_last + 1, F.lit(keep_last)) if keep_last else F.lit("")
    return F.when(n <= keep_first + keep_last, c).otherwise(F.concat(F.substring(c, 1, keep_first) if keep_first else F.lit(""), middle, tail))


def title_case(c: Column | str) -> Column:
    """First letter of each run of letters upper, the rest lower."""
    parts = F.regexp_extract_all(rx.col(c), F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.concat_ws("", F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))))
