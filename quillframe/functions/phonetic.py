"""Phonetic codes. Soundex and match-rating codes are expressions; the metaphones are tables of rules
run over Arrow batches, once for each different value of a batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from ..runtime import ship
from . import rx


def soundex(c: Column | str) -> Column:
    """Letter and three digits; every other letter, H and W too, parts equal digits. '0000' if there
    is no letter."""
    w = rx.sub(F.upper(F.coalesce(rx.col(c), F.lit(""))), r"\P{L}")
    coded = F.translate(F.regexp_replace(w, "[^BFPVCGJKQSXZDTLMNR]", "0"), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    digits = F.regexp_replace(F.substring(F.regexp_replace(coded, "([0-9])\\1+", "$1"), F.lit(2), F.length(coded)), "0", "")
    return F.when(w == "", "0000").otherwise(F.rpad(F.concat(F.substring(w, 1, 1), digits), 4, "0"))


def mra_code(c: Column | str) -> Column:
    """Upper case, no vowels after the first character, no repetitions; of long codes both ends."""
    s = F.upper(rx.col(c))
    code = F.regexp_replace(F.concat(F.substring(s, 1, 1), F.translate(F.substring(s, F.lit(2), F.length(s)), "AEIOU", "")), "(?s)(.)\\1+", "$1")
    return F.when(F.length(code) > 6, F.concat(F.substring(code, 1, 3), F.substring(code, -3, 3))).otherwise(code)


class _Word:
    """A word under a cursor."""

    def __init__(self, text: str):
        self.w = "".join(filter(str.isalpha, text.upper()))
        self.n = len(self.w)

    def at(self, i: int) -> str:
        return self.w[i] if 0 <= i < self.n else ""

    def cut(self, i: int, size: int) -> str:
        return self.w[i : i + size]

    def starts(self, i: int, *options: str) -> bool:
        return any(self.w.startswith(o, i) for o in options) if i >= 0 else False


_SIMPLE = {"F": "F", "J": "J", "L": "L", "M": "M", "N": "N", "Q": "K", "R": "R", "V": "F", "X": "KS", "Z": "S"}
_SOFT = ("", "I", "E", "Y")  # the end of a word is soft, too


def metaphone_code(text: str) -> str:
    """Metaphone of one word or phrase, letters only."""
    x = _Word(text)
    if x.w[:2] in ("KN", "GN", "WR", "PN", "AE"):
        x = _Word(x.w[1:])
    if x.w[:1] == "X":
        x.w = "S" + x.w[1:]
    vowel = set("AEIOU").__contains__
    out: list[str] = []
    i = 0
    while i < x.n:
        c, before, after, then = x.at(i), x.at(i - 1), x.at(i + 1), x.at(i + 2)
        end = i + 1 == x.n - 1
        i += 1
        if vowel(c):
            if i == 1:
                out.append(c)
            continue
        if c == before != "C":
            continue
        if c in _SIMPLE:
            out.append(_SIMPLE[c])
        elif c in "CSTP" and after == "H":
            out.append({"C": "X", "S": "X", "T": "0", "P": "F"}[c])
            i += 1
        elif c in "ST":
            out.append("X" if after == "I" and then in ("", "A", "O", "AO") else c)
        elif c == "P":
            out.append("P")
        elif c == "B":
            if before != "M" or i != x.n:
                out.append("B")
        elif c == "C":
            out.append("S" if after in _SOFT else "K")
        elif c == "D":
            out.append("J" if after == "G" and then in _SOFT else "T")
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "G":
            silent = (after == "H" and (end or (i + 1 < x.n and not vowel(then)))) or (after == "N" and (end or (i + 1 == x.n - 1 and then in set("AEIOUNS"))))
            if not silent:
                out.append("J" if after in _SOFT else "K")
        elif c == "H":
            if vowel(after) and not vowel(before):
                out.append("H")
        elif c in "WY" and vowel(after):
            out.append(c)
    return "".join(out)


def _among(piece: str, *options: str) -> bool:
    return piece in options


class _Double(_Word):
    """Double Metaphone: one method a letter, which adds codes and says how far to go."""

    VOWELS = frozenset("AEIOUY")
    _TWICE = {"F": "F", "K": "K", "N": "N", "Q": "K", "V": "F"}

    def __init__(self, text: str):
        super().__init__(text)
        self.first: list[str] = []
        self.second: list[str] = []
        self.last = self.n - 1
        self.slavic = any(x in self.w for x in ("W", "K", "CZ"))
        self.german = self.w.startswith("SCH")

    def add(self, main: str, other: str | None = None) -> None:
        self.first.append(main)
        self.second.append(main if other is None else other)

    def vowel(self, i: int) -> bool:
        return self.at(i) in self.VOWELS

    def soft(self, i: int, letters: str) -> bool:
        """One of the letters, or past an end."""
        return self.at(i) == "" or self.at(i) in letters

    def codes(self) -> tuple[str, str]:
        if not self.n:
            return "", ""
        i = 0
        if _among(self.w[:2], "KN", "GN", "PN", "WR", "AE"):
            i = 1
        if self.w[0] == "X":
            self.add("S")
            i = 1
        while i < self.n:
            c = self.at(i)
            if c in self.VOWELS:
                if not i:
                    self.add("A")
                i += 1
            elif c in self._TWICE:
                self.add(self._TWICE[c])
                i += 1 + (self.at(i + 1) == c)
            else:
                i += getattr(self, "_" + c, lambda i: 1)(i) if c.isascii() else 1
        return "".join(self.first), "".join(self.second)

    def _B(self, i: int) -> int:
        self.add("P")
        return 1 + (self.at(i + 1) == "B")

    def _C(self, i: int) -> int:
        w = self
        hard = i > 1 and not w.vowel(i - 2) and w.cut(i - 1, 3) == "ACH" and w.at(i + 2) != "I"
        if hard and (w.at(i + 2) != "E" or _among(w.cut(i - 2, 6), "MACHER", "BACHER")):
            w.add("K")
            return 2
        if not i and w.w.startswith("CAESAR"):
            w.add("S")
            return 2
        pair = w.cut(i, 2)
        if pair == "CH":
            if i and w.cut(i, 4) == "CHAE":
                w.add("K", "X")
            elif w.german or (not i and _among(w.cut(1, 5), "HARIS", "HARAC", "HEM", "HIA", "HYM", "HOR")):
                w.add("K")
            elif i:
                w.add("X", "K")
            else:
                w.add("X")
            return 2
        if pair == "CZ" and _before(w, i, 2, 4) != "WICZ":
            w.add("S", "X")
            return 2
        if w.cut(i + 1, 3) == "CIA":
            w.add("X")
            return 3
        if pair == "CC" and not (i == 1 and w.at(0) == "M"):
            w.add("KS" if w.soft(i + 2, "IEH") and w.cut(i + 2, 2) != "HU" else "K")
            return 2
        if _among(pair, "CQ", "CG", "CK"):
            w.add("K")
            return 2
        if _among(pair, "CY", "CE", "CI"):
            w.add("S", "X" if _among(w.cut(i, 3), "CIA", "CIE", "CIO") else None)
            return 2
        w.add("K")
        return 2 if w.soft(i + 1, "CQ") else 1

    def _D(self, i: int) -> int:
        if self.at(i + 1) == "G":
            soft = self.soft(i + 2, "IEY")
            self.add("J" if soft else "TK")
            return 3 if soft else 2
        self.add("T")
        return 2 if _among(self.cut(i, 2), "DD", "DT") else 1

    def _G(self, i: int) -> int:
        w, after = self, self.at(i + 1)
        if after == "H":
            if i and not w.vowel(i - 1):
                w.add("K")
            elif not i:
                w.add("J" if w.at(2) == "I" else "K")
            elif not (i > 1 and (w.soft(i - 2, "BHD") or w.soft(i - 3, "BH") or w.soft(i - 4, "B"))):
                w.add("F")
            return 2
        if after == "N":
            if w.slavic:
                w.add("KN")
            elif i == 1 and w.vowel(0):
                w.add("KN", "N")
            elif w.cut(i + 2, 2) != "EY":
                w.add("N", "KN")
            else:
                w.add("KN")
            return 2
        if w.cut(i + 1, 2) == "LI" and not w.slavic:
            w.add("KL", "L")
            return 2
        if not i and (w.at(1) == "Y" or _among(w.cut(1, 2), "ER", "EI", "EY", "EL", "EB", "EP", "ES")):
            w.add("K", "J")
            return 2
        if (w.cut(i + 1, 2) == "ER" or after == "Y") and not w.starts(0, "MANGER", "RANGER", "DANGER") and not w.soft(i - 1, "EI") and not _among(_before(w, i, 1, 3), "OGY", "RGY"):
            w.add("K", "J")
            return 2
        if w.soft(i + 1, "EIY") or _among(_before(w, i, 1, 4), "OGGI", "AGGI"):
            if w.german or w.cut(i + 1, 2) == "ET":
                w.add("K")
            elif w.cut(i + 1, 4) in "IER ":
                w.add("J")
            else:
                w.add("J", "K")
            return 2
        w.add("K")
        return 2 if after == "G" else 1

    def _H(self, i: int) -> int:
        if self.vowel(i + 1) and not self.vowel(i - 1):
            self.add("H")
        return 1

    def _J(self, i: int) -> int:
        w = self
        if w.cut(i, 4) == "JOSE":
            w.add("J", "H")
        elif not i:
            w.add("J", "A")
        elif w.vowel(i - 1) and not w.slavic and w.soft(i + 1, "AO"):
            w.add("J", "H")
        elif i == w.last:
            w.add("", "J")
        elif not w.soft(i - 1, "SKLT") and not w.soft(i + 1, "SLTZ"):
            w.add("J")
        return 2 if w.at(i + 1) == "J" else 1

    def _L(self, i: int) -> int:
        w = self
        if w.at(i + 1) != "L":
            w.add("L")
            return 1
        around = _before(w, i, 1, 4)
        tail = _among(_before(w, w.last, 1, 2), "OS", "AS") or w.soft(w.last, "AO")
        spanish = (i == w.n - 3 and _among(around, "ALLE", "ILLA", "ILLO")) or (tail and around == "ALLE")
        w.add("L", "" if spanish else None)
        return 2

    def _M(self, i: int) -> int:
        self.add("M")
        return 2 if self.at(i + 1) == "M" or (self.at(i - 1) == "U" and self.at(i + 1) == "B") else 1

    def _P(self, i: int) -> int:
        if self.at(i + 1) == "H":
            self.add("F")
            return 2
        self.add("P")
        return 2 if self.soft(i + 1, "PB") else 1

    def _R(self, i: int) -> int:
        quiet = i == self.last and not self.slavic and _before(self, i, 2, 2) == "IE" and not _among(_before(self, i, 4, 2), "MA", "ME")
        self.add("" if quiet else "R", "R")
        return 2 if self.at(i + 1) == "R" else 1

    def _S(self, i: int) -> int:
        w = self
        if _among(_before(w, i, 1, 3), "YSL", "ISL"):
            return 1
        if not i and w.w.startswith("SUGAR"):
            w.add("X", "S")
            return 1
        if w.at(i + 1) == "H":
            w.add("S" if _among(w.cut(i + 1, 4), "HOLZ", "HOLM", "HOEK", "HEIM") else "X")
            return 2
        if _among(w.cut(i, 3), "SIA", "SIO"):
            w.add("S", None if w.slavic else "X")
            return 3
        if (not i and w.soft(1, "MNLW")) or w.at(i + 1) == "Z":
            w.add("S", "X")
            return 2 if w.at(i + 1) == "Z" else 1
        if w.at(i + 1) == "C":
            if w.at(i + 2) == "H":
                tail = w.cut(i + 3, 2)
                if _among(tail, "EN", "ER"):
                    w.add("X", "SK")
                elif _among(tail, "EM", "ED", "UY", "OO"):
                    w.add("SK")
                else:
                    w.add("X", "S")
            else:
                w.add("S" if w.soft(i + 2, "IEY") else "SK")
            return 3
        if i == w.last and _among(_before(w, i, 2, 2), "OI", "AI"):
            w.add("", "S")
            return 1
        w.add("S")
        return 2 if w.soft(i + 1, "SZ") else 1

    def _T(self, i: int) -> int:
        w = self
        if w.cut(i, 4) in ("TCH", "TIA", "TION"):
            w.add("X")
            return 3
        if w.at(i + 1) == "H" or w.cut(i, 3) == "TTH":
            if w.german or _among(w.cut(i + 2, 2), "AM", "OM"):
                w.add("T")
            else:
                w.add("0", "T")
            return 2
        w.add("T")
        return 2 if w.soft(i + 1, "TD") else 1

    def _W(self, i: int) -> int:
        w = self
        if w.at(i + 1) == "R":
            w.add("R")
            return 2
        if not i and (w.vowel(1) or w.at(1) == "H"):
            w.add("A", "F" if w.vowel(1) else None)
            return 1
        if (i == w.last and w.vowel(i - 1)) or w.german or _among(_before(w, i, 1, 5), "OWSKY", "OWSKI", "EWSKY", "EWSKI"):
            w.add("", "F")
            return 1
        if _among(w.cut(i, 4), "WITZ", "WICZ"):
            w.add("TS", "FX")
            return 4
        return 1

    def _X(self, i: int) -> int:
        french = i == self.last and (_among(_before(self, i, 3, 3), "EAU", "IAU") or _among(_before(self, i, 2, 2), "OU", "AU"))
        if not french:
            self.add("KS")
        return 2 if self.soft(i + 1, "CX") else 1

    def _Z(self, i: int) -> int:
        w = self
        if w.at(i + 1) == "H":
            w.add("J")
            return 2
        if _among(w.cut(i + 1, 2), "ZA", "ZI", "ZO") or (w.slavic and i and w.at(i - 1) != "T"):
            w.add("S", "TS")
            return 1
        w.add("S")
        return 2 if w.at(i + 1) == "Z" else 1


def _before(x: _Word, i: int, back: int, size: int) -> str:
    """Slice that starts `back` before i, with Python's meaning of negative starts."""
    return x.w[i - back : i - back + size]


def _batched(fn: Callable[[str], object], kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        known = {v: fn(v) for v in s.dropna().unique()}
        return s.map(lambda v: None if v is None else known[v])

    return run


def metaphone(c: Column | str) -> Column:
    ship()
    return _batched(metaphone_code, "string")(rx.col(c))


def double_metaphone(c: Column | str) -> Column:
    """Struct of primary and alternate code."""
    ship()

    @F.pandas_udf("primary string, alternate string")
    def run(s: pd.Series) -> pd.DataFrame:
        known = {v: _Double(v).codes() for v in s.dropna().unique()}
        return pd.DataFrame([known.get(v, (None, None)) for v in s], columns=["primary", "alternate"])

    return run(rx.col(c))
