"""Low-level string operators as column expressions. NULL and empty texts give empty strings unless
stated otherwise; everything is built in, so it stays in generated code and is pushed down."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from . import rx

#: Letters without their marks; all in Latin-1 and Latin Extended-A and -B whose base is a vowel, C or N.
_EXTRA = "ÅåÇçÑñ"
_PLAIN_FOR = {
    c: unicodedata.normalize("NFD", c)[0]
    for base in "AEIOUaeiou"
    for mark in "́̈̂̀̄̆"
    for c in [unicodedata.normalize("NFC", base + mark)]
    if len(c) == 1 and ord(c) < 0x180
} | {c: unicodedata.normalize("NFD", c)[0] for c in _EXTRA + "ÃÕŨãõũŐŰőűĄĘĮŲąęįųǍĚǏǑǓǎěǐǒǔĖė"}
_LIGATURES = {"ß": "ss", "ẞ": "SS", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}
_QUOTES, _DOUBLE, _DASHES = "´`‘’‡†Ž", "«»“”", "—–"
SPANISH = "ñÑáéíóúüÁÉÍÓÚÜçÇ"
DIVIDERS = " \t\n\r\x0c\x0b-()./,;:!?@#$%^&*+="
PATTERNS = {
    "text_in_parentheses": (r"\((.*?)\)", 1),
    "broad_email": (r"[a-zA-Z0-9_.%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0),
    "ipv4_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0),
    "basic_url": (r"https?://[^\s/$.?#].\S*", 0),
}
DIAL_CODES = dict(x.split(":") for x in "AR:54 BR:55 CL:56 CO:57 DE:49 ES:34 FR:33 GB:44 IT:39 MX:52 PT:351 US:1".split())


def _text(c: Column | str) -> Column:
    return F.coalesce(rx.col(c), F.lit(""))


def flat_vowels(c: Column | str) -> Column:
    """Accented letters as plain ones, ligatures as two letters."""
    out = F.translate(_text(c), "".join(_PLAIN_FOR), "".join(_PLAIN_FOR.values()))
    for a, b in _LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_spaces(c: Column | str) -> Column:
    return rx.squeeze(_text(c))


def erase_allspaces(c: Column | str) -> Column:
    return rx.sub(_text(c), r"[\s\x1c-\x1f]+")


def normalize_symbols(c: Column | str) -> Column:
    """Typographic quotes and dashes as ASCII, and two common misreadings mended."""
    return F.translate(_text(c), _QUOTES + _DOUBLE + _DASHES + "§¥", "'" * len(_QUOTES) + '"' * len(_DOUBLE) + "-" * len(_DASHES) + "ºÑ")


def erase_specialchar(c: Column | str, allowed: str = "") -> Column:
    return rx.sub(_text(c), f"[^a-zA-Z0-9 {SPANISH}{rx.char_class(allowed)}]", flags="")


def fix_spanish(c: Column | str, allowed: str = "") -> Column:
    return erase_specialchar(normalize_symbols(c), allowed)


def string_filter(c: Column | str, pattern: str, keep_spaces: bool = True) -> Column:
    """Characters outside the pattern become spaces; a pattern with ^ is used as it is."""
    full = pattern if "^" in pattern else f"[^{pattern}\\s]" if keep_spaces else f"[^{pattern}]"
    return rx.squeeze(rx.sub(_text(c), full, " "))


def string_aZ(c: Column | str, allowed: str = "", keep_spaces: bool = True) -> Column:
    return string_filter(c, f"a-zA-Z{SPANISH}{rx.char_class(allowed)}", keep_spaces)


def string_aZ09(c: Column | str, allowed: str = "", keep_spaces: bool = True) -> Column:
    return string_filter(c, f"a-zA-Z0-9{SPANISH}{rx.char_class(allowed)}", keep_spaces)


def reorder_comma_fullname(c: Column | str) -> Column:
    """'Last, First' as 'First Last'; NULL without a comma."""
    c = rx.col(c)
    at = F.instr(c, ",")
    last, first = F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.length(c))
    strip = lambda x: rx.sub(x, r"^\s+|\s+$")
    return F.when(at > 0, strip(F.concat(strip(first), F.lit(" "), strip(last))))


def split_all(c: Column | str, dividers: str = DIVIDERS) -> Column:
    """Pieces between any of the dividers, without empty ones."""
    return F.filter(F.split(_text(c), f"[{rx.char_class(dividers)}]", -1), lambda x: x != "")


def get_in_text_by_pattern(c: Column | str, name: str) -> Column:
    """All matches of a named pattern; an empty array for none and for unknown names."""
    if name not in PATTERNS:
        return F.array().cast("array<string>")
    pattern, group = PATTERNS[name]
    return F.coalesce(rx.find_all(c, pattern, group), F.array().cast("array<string>"))


def normalize_phone(c: Column | str, country: str = "ES") -> Column:
    """Digits with the country's dialling code; NULL stays NULL, blank stays as it is."""
    c = rx.col(c)
    clean = rx.sub(c, r"[\s().-]")
    code = DIAL_CODES.get(country.upper())
    local = clean if country.upper() == "US" else F.regexp_replace(clean, "^0", "")
    return F.when(clean == "", c).when(clean.startswith("+"), clean).otherwise(F.concat(F.lit("+" + code), local) if code else clean)
