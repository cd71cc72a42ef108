"""Repair of texts that were decoded with the wrong codec.

Spark knows neither the Windows nor the DOS code pages, so the repair is an Arrow function; rows in
which nothing is wrong never get there.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from ..runtime import ship
from . import rx

CODECS = ("cp1252", "latin-1", "iso-8859-15", "cp850", "cp437")
_TYPOGRAPHIC = "–—‘’‚“”„•…‰‹›€™ŒœŠšŽžŸƒˆ˜"
_PLAIN = {**dict.fromkeys("‘’‚`´", "'"), **dict.fromkeys("“”„«»", '"'), **dict.fromkeys("–—", "-"), "…": "..."}
_OWN = {
    "es": "áéíóúñüÁÉÍÓÚÑÜ¿¡", "pt": "áéíóúàâêôãõçÁÉÍÓÚÀÂÊÔÃÕÇ", "de": "äöüÄÖÜß", "it": "àèéìíòóùúÀÈÉÌÍÒÓÙÚ",
    "fr": "àâäæçéèêëîïôöùûüÿœÀÂÄÆÇÉÈÊËÎÏÔÖÙÛÜŸŒ",
}


def _as_cp1252(data: bytes) -> str:
    """Bytes as Windows shows them; the five that it has no character for stay controls."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)


@lru_cache(maxsize=1)
def garbled() -> dict[str, str]:
    """What was garbled -> what it was, longest first."""
    out: dict[str, str] = {}
    for b in range(0x80, 0xA0):
        if shown := bytes([b]).decode("cp1252", "ignore"):
            out[chr(b)] = shown
    for ch in [*map(chr, range(0x80, 0x100)), *_TYPOGRAPHIC]:
        data = ch.encode()
        for shown in (_as_cp1252(data), data.decode("latin-1")):
            if shown != ch and len(shown) > 1:
                out.setdefault(shown, ch)
    mark = "﻿".encode()
    out |= {_as_cp1252(mark): "", mark.decode("latin-1"): "", "﻿": "", "\r\n": "\n", "\r": "\n"}
    return dict(sorted(out.items(), key=lambda kv: -len(kv[0])))


@lru_cache(maxsize=1)
def _long() -> tuple[str, ...]:
    return tuple(k for k in garbled() if len(k) > 1)


def _mend(text: str) -> str:
    for bad, good in garbled().items():
        if bad in text:
            text = text.replace(bad, good)
    return text


def score(text: str, language: str | None = None) -> float:
    """How much a text looks like one: mean weight of its characters' categories."""
    if not text:
        return 0.0
    own = set(_OWN.get(language or "", ""))
    weight = {"L": 2.0, "P": 1.0, "S": 0.5, "C": -5.0}
    total = 0.0
    for ch in text:
        kind = unicodedata.category(ch)
        total += 2.0 if kind == "Nd" else weight.get(kind[0], 0.5)
        total += 0.5 if kind[0] == "L" and ch in own else 0.0
    return total / len(text)


def redecoded(text: str, language: str | None = None) -> tuple[str | None, str | None]:
    """The best reading of the text's bytes as UTF-8, and the codec by which they were misread."""
    best, how, top = None, None, score(text, language)
    for codec in CODECS:
        try:
            other = text.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
        if (s := score(other, language)) > top:
            best, how, top = other, codec, s
    return best, how


def fixed(text: str, language: str | None = None, normalize_quotes: bool = False) -> str:
    out = _mend(text)
    odd = any(k in out for k in _long())
    if odd or any("\x80" <= ch <= "\x9f" for ch in out):
        out = redecoded(out, language)[0] or out
    if any(k in out for k in _long()):
        out = _mend(out)
    if normalize_quotes:
        out = out.translate(str.maketrans(_PLAIN))
    return "".join(ch for ch in out if ch in "\t\n\r" or not (ch < " " or "\x7f" <= ch <= "\x9f"))


def has_mojibake(c: Column | str) -> Column:
    """Whether a garbled sequence is there. Carriage returns with line feeds count as one."""
    shown = lambda k: "".join(f"\\x{{{ord(x):x}}}" for x in k)
    branches = []
    firsts = sorted({k[0] for k in _long()})
    for first in firsts:
        rest = [k[1:] for k in _long() if k[0] == first]
        singles = "".join(shown(r) for r in rest if len(r) == 1)
        options = [f"[{singles}]"] * bool(singles) + [shown(r) for r in rest if len(r) > 1]
        branches.append(f"{shown(first)}(?:{'|'.join(options)})")
    # most characters start none of these
    return F.rlike(rx.col(c), F.lit(f"(?=[{''.join(map(shown, firsts))}])(?:{'|'.join(branches)})"))


def _suspect(c: Column) -> Column:
    return has_mojibake(c) | F.rlike(c, F.lit(r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0d}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{feff}]"))


def fix_encoding(c: Column | str, language: str | None = None, normalize_quotes: bool = False) -> Column:
    """Mended text; texts without anything suspicious skip the Arrow function."""
    ship()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fixed(t, language))

    c = rx.col(c)
    out = F.when(_suspect(c), run(F.when(_suspect(c), c))).otherwise(c)
    if normalize_quotes:
        out = F.replace(F.translate(out, "‘’‚`´“”„«»–—", "'''''\"\"\"\"\"--"), F.lit("…"), F.lit("..."))
    return out


def fix_language(c: Column | str, language: str = "en") -> Column:
    """Mended, two common misreadings of Romance texts put right, and white space collapsed."""
    out = fix_encoding(c, language)
    if language in ("es", "pt", "fr", "it"):
        out = F.translate(out, "§", "º")
    if language in ("es", "pt"):
        out = F.translate(out, "¥", "Ñ")
    return rx.squeeze(out)


def detect_encoding(c: Column | str, language: str | None = None) -> Column:
    """Struct of has_mojibake, likely_codec, sequences_found (20 at most), score_original, score_fixed."""
    ship()

    @F.pandas_udf("has_mojibake boolean, likely_codec string, sequences_found array<string>, score_original double, score_fixed double")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            if not t:
                rows.append((False, None, [], 0.0, 0.0))
                continue
            found = [k for k in _long() if k in t]
            how = redecoded(t, language)[1]
            rows.append((bool(found) or how is not None, how, found[:20], round(score(t, language), 3), round(score(fixed(t, language), language), 3)))
        return pd.DataFrame(rows, columns=["has_mojibake", "likely_codec", "sequences_found", "score_original", "score_fixed"])

    return run(rx.col(c))
