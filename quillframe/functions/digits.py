"""Sums over the characters of identifiers, shared by all check digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def at(c: Column, i: int) -> Column:
    """Character i (from 0) of a text as its value: digits as they are, A as 10 and so on; -1 for others."""
    return F.instr(F.lit("0123456789" + ALPHABET), F.substring(c, i + 1, 1)) - 1


def weighted(c: Column, weights: list[int], start: int = 0) -> Column:
    """Sum of digits times weights, unrolled: no loop at run time."""
    return reduce(lambda a, b: a + b, [at(c, start + k) * w for k, w in enumerate(weights)])


def pick(letters: str, i: Column) -> Column:
    return F.substring(F.lit(letters), i.cast("int") + 1, F.lit(1))


def digit_at(c: Column, i: int, value: Column) -> Column:
    """Whether character i is the digit `value`."""
    return F.substring(c, i + 1, 1) == value.cast("string")


def reversed_sum(c: Column, weights: tuple[int, ...]) -> Column:
    """Sum of digits from the right, times weights that repeat."""
    chars = F.split(F.reverse(c), "")
    n = len(weights)
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.zip_with(chars, F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(c) - 1)), lambda x, i: (F.instr(F.lit("0123456789"), x) - 1) * F.element_at(w, (i % n).cast("int") + 1)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def luhn_sum(c: Column, double_first: bool) -> Column:
    """Luhn's sum of a string of digits; whether the rightmost digit is doubled."""
    chars = F.split(F.reverse(c), "")
    doubled = F.lit("0246813579")
    value = lambda x, i: F.when(i % 2 == (0 if double_first else 1), F.substring(doubled, F.instr(F.lit("0123456789"), x), F.lit(1)).cast("int")).otherwise(F.instr(F.lit("0123456789"), x) - 1)
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
