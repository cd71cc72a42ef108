"""Regular expressions on columns: Unicode classes on, no hit is NULL, whole matches by default."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNICODE = "(?U)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sub(c: Column | str, pattern: str, by: str = "", flags: str = UNICODE) -> Column:
    return F.regexp_replace(col(c), F.lit(flags + pattern), F.lit(by))


def has(c: Column | str, pattern: str, flags: str = UNICODE) -> Column:
    return F.rlike(col(c), F.lit(flags + pattern))


def find_all(c: Column | str, pattern: str, group: int = 0, flags: str = UNICODE) -> Column:
    """All matches; NULL for NULL and for no match."""
    return some(F.regexp_extract_all(col(c), F.lit(flags + pattern), F.lit(group)))


def some(hits: Column) -> Column:
    """An array that has elements, else NULL; computed once."""
    return F.get(F.filter(F.array(hits), lambda h: F.size(h) > 0), F.lit(0))


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(sub(c, r"[\s\x1c-\x1f]+", " "))


def char_class(chars: str) -> str:
    """The characters as the inside of a bracket expression."""
    return "".join("\\" + x if not x.isalnum() and x.isascii() and not x.isspace() else x for x in chars)
