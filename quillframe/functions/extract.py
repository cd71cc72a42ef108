"""Extraction of what patterns describe. NULL gives NULL, no hit gives NULL (postal codes: [])."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import ops, rx

_SEPARATORS = " \t\n\r\x0c\x0b-()."

#: name -> pattern; each whole match counts.
PATTERNS: dict[str, str] = {
    "from_parentheses": r"\(.*?\)",
    "mentions": r"@\w+",
    "hashtags": r"#\w+",
    "currency": r"\b[£¥€$]\d+(?:\.\d{2})?\b",
    "percentages": r"\b\d+(?:\.\d+)?%\b",
    "numeric": r"\b\d+(?:\.\d+)?\b",
    "numeric_units": r"\b\d+(?:\.\d+)?\s*[a-zA-Z]+\b",
    "version_numbers": r"\b\d+(?:\.\d+)+\b",
    "credit_cards": r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    "ibans": r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b",
    "swift_bic": r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "custom_ids": r"\b[A-Z]+\d+\b",
    "patient_ids": r"\bPAT-\d+\b",
    "nif": r"\b\d{8}[A-Z]\b",
    "social_security": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip_addresses": ops.PATTERNS["ipv4_address"][0],
    "emails": ops.PATTERNS["broad_email"][0],
    "urls": ops.PATTERNS["basic_url"][0],
    "checksums": r"\b[a-fA-F0-9]{32,64}\b",
    "cve_ids": r"\bCVE-\d{4}-\d{4,7}\b",
    "patent_numbers": r"\b[A-Z]{2}\d+[A-Z]\d+\b",
    "isbns": r"\b(?:\d{9}[\dX]|\d{13})\b",
    "quotations": r"""(?:"[^"\n]*"|'[^'\n]*')""",
    "classification_tags": r"\[.*?\]",
    "dates": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "times": r"\b\d{1,2}:\d{2}(?:\s?[AP]M)?\b",
    "passwords": r"\b(?=.*[a-zA-Z])(?=.*\d)(?=.*[!@#$%^&*])[a-zA-Z\d!@#$%^&*]{6,}\b",
}

#: The same hits sooner. Word borders cost much: what a hit begins with is asked first. A run before an @
#: is read once, from its start or from where the last hit ended: if that doesn't lead to a hit, no later
#: start in it does.
_FASTER = {k: rf"(?={b}){p}" for k, p in PATTERNS.items() for b in [r"\d" if p.startswith((r"\b\d", r"\b(?:\d")) else "[A-Z]{2}" if p.startswith((r"\b[A-Z]{2}", r"\b[A-Z]{6}")) else "[A-Z]" if p.startswith(r"\b[A-Z]") else "[a-fA-F0-9]{32}" if k == "checksums" else ""] if b} | {
    "emails": r"(?:\G|(?<![a-zA-Z0-9_.%+-]))[a-zA-Z0-9_.%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
}


def extract(c: Column | str, kind: str, pattern: str | None = None) -> Column:
    """All hits of a kind in PATTERNS, or of an own pattern (its group 1 if it has groups)."""
    if pattern is not None:
        import re

        return rx.find_all(c, pattern, 1 if re.compile(pattern).groups else 0)
    if kind == "passwords":
        return _passwords(rx.col(c))
    return rx.find_all(c, _FASTER.get(kind, PATTERNS[kind]))


def _passwords(c: Column) -> Column:
    """The hits of the passwords' pattern in time that grows with the text: it looks ahead to the end of
    the line from each word, which is to ask whether a hit starts before the line's last letter, last
    digit and last sign. So lines are searched without looking ahead, and the first hits stay."""
    def pieces(x: Column, digit: str, flags: str) -> Column:
        sign, word, any_ = "[!@#$%^&*]", f"[a-zA-Z{digit}]", f"[a-zA-Z{digit}!@#$%^&*]"
        # within a run, borders are between words and signs; \b itself costs more than all the rest
        border = rf"(?:(?<!{any_})\b|(?<={sign})(?={word})|(?<={word})(?={sign}))"
        last = F.least(*[F.length(F.regexp_extract(x, f"{flags}^.*{e}", 0)) for e in (sign, f"[{digit}]", "[a-zA-Z]")])
        # gaps and hits in turn: no line has a line break
        split = F.split(rx.sub(x, rf"(?={any_}{{6}}){border}({any_}{{6,}})\b", "\n$1\n", flags), "\n", -1)
        return F.struct(split.alias("parts"), last.alias("last"))

    def of_line(x: Column) -> Column:
        # classes of ASCII alone are looked up in a table
        return rx.let(F.when(F.octet_length(x) == F.length(x), pieces(x, "0-9", "")).otherwise(pieces(x, r"\d", rx.UNICODE)), early)

    def early(t: Column) -> Column:
        whole = F.transform(t["parts"], lambda p, i: F.struct((i % 2 == 1).alias("hit"), F.length(p).alias("n"), p.alias("p")))
        begun = lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), (a["k"] + (x["hit"] & (a["at"] < t["last"])).cast("int")).alias("k"))
        first = F.aggregate(whole, F.struct(F.lit(0).alias("at"), F.lit(0).alias("k")), begun)["k"]
        return rx.let(first, lambda k: F.filter(t["parts"], lambda p, i: (i % 2 == 1) & (i < 2 * k)))

    has_all = lambda x: F.rlike(x, F.lit("[!@#$%^&*]")) & rx.has(x, r"\d") & F.rlike(x, F.lit("[a-zA-Z]"))
    lines = F.filter(F.regexp_extract_all(c, F.lit(".+"), F.lit(0)), has_all)
    return rx.some(F.when(has_all(c), F.flatten(F.transform(lines, of_line))))


def phones(c: Column | str, pattern: str | None = None, separators: str | list[str] | None = None) -> Column:
    """Digits of whatever looks like a phone number and has at least five."""
    if pattern is not None:
        return extract(c, "", pattern)
    own = ops.DIVIDERS if separators == "all" else "".join(separators) if separators else _SEPARATORS
    hits = F.regexp_extract_all(rx.col(c), F.lit(rf"(?U)\+?\d[{rx.char_class(_SEPARATORS + own)}\d]*\d"), F.lit(0))
    digits = F.filter(F.transform(hits, lambda x: F.regexp_replace(x, r"(?U)\D", "")), lambda x: F.length(x) >= 5)
    return F.when(F.size(digits) > 0, digits)


def postal_codes(c: Column | str, pattern: str | None = None) -> Column:
    """Five digits, or four if there are none; [] for no hit."""
    if pattern is not None:
        return extract(c, "", pattern)
    four = F.regexp_extract_all(rx.col(c), F.lit(r"(?U)\b\d{4}\b"), F.lit(0))
    return F.coalesce(rx.find_all(c, r"\b\d{5}\b"), four)


def paragraphs(c: Column | str) -> Column:
    """Pieces between blank lines, trimmed, without empty ones."""
    parts = F.transform(F.split(rx.col(c), "\n\n", -1), lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", ""))
    full = F.filter(parts, lambda p: p != "")
    return F.when(F.size(full) > 0, full)


def tokenize(c: Column | str) -> Column:
    tokens = ops.split_all(c)
    return F.when(rx.col(c).isNotNull() & (F.size(tokens) > 0), tokens)


def get_string_between(c: Column | str, delimiter: str) -> Column:
    """What is between the first two occurrences of a delimiter, else ''."""
    parts = F.split(rx.col(c), "\\Q" + delimiter + "\\E", 3)
    return F.when(F.size(parts) > 2, F.element_at(parts, 2)).when(rx.col(c).isNotNull(), F.lit(""))


def all_kinds(c: Column | str, kinds: list[str] | None = None) -> Column:
    """Map of kind -> hits, of the kinds that have any."""
    kinds = kinds or list(PATTERNS)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), extract(c, k).alias("value")) for k in kinds])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
