"""Checksums, formats and types of values. Predicates are FALSE for what they reject and NULL for
NULL; what isn't defined for an input (a check digit of letters) is NULL."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from ..runtime import ship
from . import digits as D, rx

_IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL", 19: "MK SI", 20: "AT BA EE KZ XK LT LU", 21: "HR LV LI CH",
    22: "BH BG GE DE IE ME RS GB VA", 23: "TL GI IL AE", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "PT ST", 26: "IS TR",
    27: "FR GR IT MR MC SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN_SIZES[22] += " CR"
_IBAN_SIZES[23] += " IQ"
_IBAN_LENGTHS = {c: n for n, cs in _IBAN_SIZES.items() for c in cs.split()}
_CARDS = (("visa", "4"), ("mastercard", "5[1-5]|2221|2720"), ("amex", "3[47]"), ("discover", "6011|65|644|649"))
_VAT = {
    r"\d{8}": "DK FI HU LU MT SI", r"\d{9}": "DE EE EL PT", r"\d{10}": "PL SK", r"\d{11}": "HR IT LV", r"\d{12}": "SE", r"U\d{8}": "AT",
    r"[01]\d{9}": "BE", r"\d{9,10}": "BG", r"\d{8}[A-Z]": "CY", r"\d{8,10}": "CZ", r"[A-Z0-9]\d{7}[A-Z0-9]": "ES", r"[A-Z0-9]{2}\d{9}": "FR",
    r"\d[A-Z0-9+*]\d{5}[A-Z]": "IE", r"\d{9,12}": "LT", r"\d{9}B\d{2}": "NL", r"\d{2,10}": "RO", r"(?:\d{9}|\d{12}|GD\d{3}|HA\d{3})": "GB",
}
VAT_PATTERN = "^(?:" + "|".join(f"(?:{'|'.join(sorted(cs.split(), reverse=True))}){p}" for p, cs in sorted(_VAT.items())) + ")$"
_PHONES = {
    "US": ("1", r"[2-9]\d{9}"), "PT": ("351", r"[2-9]\d{8}"), "IT": ("39", r"0?[0-9]{6,12}"), "GB": ("44", r"0?[1-9]\d{9,10}"),
    "FR": ("33", r"0?[1-9]\d{8}"), "ES": ("34", r"[6-9]\d{8}"), "DE": ("49", r"0?[1-9]\d{4,14}"),
}
FREE_DOMAINS = sorted("yahoo.co.uk hotmail.co.uk yahoo.es hotmail.es gmx.net gmx.com proton.me protonmail.com yandex.com zoho.com mail.com icloud.com aol.com live.com outlook.com hotmail.com yahoo.com gmail.com".split(), key=len)
DISPOSABLE_DOMAINS = sorted("mailnesia.com fakeinbox.com temp-mail.org 10minutemail.com maildrop.cc trashmail.com dispostable.com grr.la guerrillamailblock.com sharklasers.com yopmail.com throwaway.email tempmail.com guerrillamail.com mailinator.com".split(), key=len)
CONFUSABLES = "".join(map(chr, (0x410, 0x412, 0x421, 0x415, 0x41D, 0x41A, 0x41C, 0x41E, 0x420, 0x422, 0x425, 0x430, 0x435, 0x43E, 0x440, 0x441, 0x443, 0x445, 0x456, 0x391, 0x392, 0x395, 0x397, 0x399, 0x39A, 0x39C, 0x39D, 0x39F, 0x3A1, 0x3A4, 0x3A7, 0x3BF)))


def _solid(c: Column | str) -> Column:
    return F.translate(rx.col(c), "- ", "")


def _digits(c: Column, n: str) -> Column:
    return F.rlike(c, F.lit(f"^[0-9]{{{n}}}$"))


def luhn_checksum(c: Column | str) -> Column:
    """Luhn check digit of a payload; NULL if it has anything but digits, hyphens and spaces."""
    s = _solid(c)
    return F.when(_digits(s, "1,"), (10 - D.luhn_sum(s, True) % 10) % 10)


def is_valid_luhn(c: Column | str) -> Column:
    """NULL for fewer than two digits or other characters."""
    return rx.let(_solid(c), lambda s: F.when(_digits(s, "2,"), D.luhn_sum(s, False) % 10 == 0))


def ean13_check_digit(c: Column | str) -> Column:
    s = _solid(c)
    return F.when(_digits(s, "12"), ((10 - D.weighted(s, [1, 3] * 6) % 10) % 10).cast("string"))


def is_valid_ean(c: Column | str) -> Column:
    """8 or 13 digits, weights 1 and 3 from the right."""
    total = lambda s: F.when(F.length(s) == 13, D.weighted(s, [1, 3] * 6 + [1])).otherwise(D.weighted(s, [3, 1] * 4))
    return rx.let(_solid(c), lambda s: F.when(_digits(s, "8") | _digits(s, "13"), total(s) % 10 == 0).when(s.isNotNull(), False))


def is_valid_isbn(c: Column | str) -> Column:
    def valid(s: Column) -> Column:
        last = F.when(F.upper(F.substring(s, 10, 1)) == "X", 10).otherwise(D.at(s, 9))
        ten = (D.weighted(s, list(range(10, 1, -1))) + last) % 11 == 0
        return F.when(F.rlike(s, F.lit("^[0-9]{9}[0-9Xx]$")), ten).when(_digits(s, "13"), D.weighted(s, [1, 3] * 6 + [1]) % 10 == 0).when(s.isNotNull(), False)

    return rx.let(_solid(c), valid)


def is_valid_iban(c: Column | str) -> Column:
    """Length of the country, where known, and remainder 1 modulo 97 of the letters as numbers."""
    s = F.upper(_solid(c))
    sizes = F.create_map(*[F.lit(x) for kv in _IBAN_LENGTHS.items() for x in kv])
    size = F.element_at(sizes, F.substring(s, 1, 2))
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    value = lambda x: F.instr(F.lit("0123456789" + D.ALPHABET), x) - 1
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise((a * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97))
    shape = F.rlike(s, F.lit("^[A-Z]{2}[A-Z0-9]{3,}$")) & F.coalesce(size == F.length(s), F.lit(True))
    return F.when(shape, rest == 1).when(s.isNotNull(), False)


def is_valid_credit_card(c: Column | str) -> Column:
    """Struct of valid and network (NULL if unknown or invalid)."""
    s = _solid(c)
    valid = F.coalesce(_digits(s, "12,19") & (D.luhn_sum(s, False) % 10 == 0), F.lit(False))
    network = reduce(lambda a, x: a.when(valid & F.rlike(s, F.lit(f"^(?:{x[1]})")), x[0]), _CARDS, F.when(F.lit(False), F.lit(None).cast("string")))
    return F.struct(valid.alias("valid"), network.alias("network"))


def is_valid_vat(c: Column | str) -> Column:
    return F.rlike(F.upper(F.replace(rx.col(c), F.lit(" "), F.lit(""))), F.lit(VAT_PATTERN))


def is_valid_swift_bic(c: Column | str) -> Column:
    s = F.upper(rx.sub(c, r"\A\s+|\s+\z"))
    return rx.has(s, r"\A\p{L}{6}[\p{L}\p{N}]{2}(?:[\p{L}\p{N}]{3})?\z")


def data_type_inference(c: Column | str) -> Column:
    """First of empty, boolean, integer, float, date, email, url that fits; else string."""
    s = rx.sub(c, r"\A\s+|\s+\z")
    number = r"(?:\d+(?:_\d+)*)"
    kinds = (
        ("empty", r"\A\z"),
        ("boolean", r"(?i)\A(?:true|false|yes|no|[10])\z"),
        ("integer", rf"\A[+-]?{number}\z"),
        ("float", rf"(?i)\A[+-]?(?:{number}\.?{number}?|\.{number})(?:e[+-]?{number})?\z|\A[+-]?(?:inf|infinity|nan)\z"),
        ("date", r"\A(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d-\d\d-\d{4}|\d{4}/\d\d/\d\d)\z"),
        ("email", r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"),
        ("url", r"(?i)\Ahttps?://\S+\z"),
    )
    out = reduce(lambda a, k: a.when(rx.has(s, k[1]), F.lit(k[0])), kinds, F.when(F.lit(False), F.lit(None).cast("string")))
    return out.otherwise(F.lit("string"))


def is_valid_phone_format(c: Column | str, country: str = "ES") -> Column:
    if country.upper() not in _PHONES:
        return F.lit(False)
    code, local = _PHONES[country.upper()]
    return rx.has(rx.sub(c, r"[\s()-]"), rf"\A(?:\+{code})?{local}\z")


def email_domain_type(c: Column | str) -> Column:
    s = F.lower(rx.sub(F.coalesce(rx.col(c), F.lit("")), r"\A\s+|\s+\z"))
    domain = F.substring_index(s, "@", -1)
    return F.when((F.instr(s, "@") == 0) | (domain == ""), "invalid").when(domain.isin(DISPOSABLE_DOMAINS), "disposable").when(domain.isin(FREE_DOMAINS), "free").otherwise("corporate")


def has_mixed_case_anomaly(c: Column | str) -> Column:
    """Whether a word is neither upper, lower, title nor camel case with few capitals."""
    parts = F.split(rx.squeeze(c), " ")
    word = lambda w: rx.sub(w, r"\P{L}")

    def odd(raw: Column) -> Column:
        w = word(raw)
        capitals = F.length(rx.sub(w, r"[^\p{Lu}]"))
        camel = rx.has(w, r"\A\p{Ll}") & (capitals > 0) & (capitals < F.length(w) / 2)
        plain = (w == F.upper(w)) | (w == F.lower(w)) | (w == F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
        return (F.length(w) >= 2) & ~plain & ~camel

    return F.exists(parts, odd)


def contains_repeated_words(c: Column | str) -> Column:
    """Whether a word follows itself, whatever its case."""
    w = F.split(F.lower(rx.squeeze(c)), " ")
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False)))
    return F.exists(pairs, lambda x: x)


def homoglyph_risk_score(c: Column | str) -> Column:
    """Share of letters and numbers that look like Latin letters but aren't."""
    c = rx.col(c)
    all_ = F.length(rx.sub(c, r"[^\p{L}\p{N}]"))
    return F.when(all_ > 0, (F.length(c) - F.length(F.translate(c, CONFUSABLES, ""))) / all_).when(c.isNotNull(), 0.0)


def detect_mixed_scripts(c: Column | str) -> Column:
    """Map of script -> its letters, sorted; scripts are the first words of the letters' names, which
    no built-in function knows: an Arrow function over batches."""
    import unicodedata

    ship()

    @F.pandas_udf(MapType(StringType(), ArrayType(StringType())))
    def scripts(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            out: dict[str, list[str]] = {}
            for ch in sorted({x for x in t if x.isalpha()}):
                out.setdefault((unicodedata.name(ch, "") or "UNKNOWN").split()[0], []).append(ch)
            return out

        return s.map(one)

    return scripts(rx.col(c))
