"""Similarity of two texts: built-in expressions where Spark has what it takes, Arrow batches for
Jaro-Winkler, longest common subsequences and matching blocks. Scores are in 0..1. NULL gives NULL."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, functions as F

from ..runtime import ship
from . import phonetic, rx


def _guard(a: Column, b: Column, score: Column, equal: float | None = 1.0) -> Column:
    """Equal texts score `equal`; else an empty one scores 0."""
    out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
    if equal is not None:
        out = out.when(a == b, F.lit(equal))
    return out.when((a == "") | (b == ""), F.lit(0.0)).otherwise(score)


def levenshtein_score(a: Column | str, b: Column | str) -> Column:
    a, b = rx.col(a), rx.col(b)
    return _guard(a, b, 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def jaro_winkler(s: str, t: str) -> float:
    """Jaro with a bonus of a tenth for each of up to four equal first characters, at any score."""
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    places: dict[str, list[int]] = {}
    for j, ch in enumerate(t):
        places.setdefault(ch, []).append(j)
    used: set[int] = set()
    mine = []
    for i, ch in enumerate(s):
        for j in places.get(ch, ()):
            if j > i + reach:
                break
            if j >= i - reach and j not in used:
                used.add(j)
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != t[j] for x, j in zip(mine, sorted(used)))
    jaro = (m / len(s) + m / len(t) + (m - swapped / 2) / m) / 3.0
    prefix = next((k for k, (x, y) in enumerate(zip(s[:4], t[:4])) if x != y), min(4, len(s), len(t)))
    return jaro + prefix * 0.1 * (1.0 - jaro)


def lcs_length(s: str, t: str) -> int:
    """Length of the longest common subsequence, by bit vectors (Hyyrö 2004)."""
    if len(s) < len(t):
        s, t = t, s
    masks: dict[str, int] = {}
    for i, ch in enumerate(t):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(t)) - 1
    v = full
    for ch in s:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(t) - v.bit_count()


def _pairs(fn, kind: str):
    """A function of two texts over Arrow batches; pairs that come again in a batch are computed once."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = dict.fromkeys(zip(a, b))
        for x, y in known:
            known[x, y] = None if x is None or y is None else fn(x, y)
        return pd.Series([known[p] for p in zip(a, b)], dtype=object)

    return run


def jaro_winkler_score(a: Column | str, b: Column | str) -> Column:
    ship()
    return _pairs(jaro_winkler, "double")(rx.col(a), rx.col(b))


def ratcliff_obershelp_score(a: Column | str, b: Column | str) -> Column:
    """Twice the characters in matching blocks over all characters; 0 if one is empty."""
    ship()
    return _pairs(lambda x, y: difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0, "double")(rx.col(a), rx.col(b))


def lcs_count(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence."""
    ship()
    return _pairs(lcs_length, "int")(rx.col(a), rx.col(b))


def lcs_score(a: Column | str, b: Column | str) -> Column:
    """Struct of lcs_length, similarity (by the longer text) and score (in 0..100)."""
    a, b = rx.col(a), rx.col(b)
    n = lcs_count(a, b)
    sim = _guard(a, b, n / F.greatest(F.length(a), F.length(b)), None)
    return F.struct(n.alias("lcs_length"), sim.alias("similarity"), (sim * 100.0).alias("score"))


def _sets(a: Column, b: Column) -> tuple[Column, Column]:
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def jaccard_similarity(a: Column | str, b: Column | str, mode: str = "char") -> Column:
    """Of the sets of characters, or of white-space separated tokens."""
    a, b = rx.col(a), rx.col(b)
    parts = (lambda x: F.filter(F.split(rx.squeeze(x), " "), lambda t: t != "")) if mode == "token" else (lambda x: F.split(x, ""))
    both, any_ = _sets(parts(a), parts(b))
    return _guard(a, b, F.when(any_ > 0, both / any_).otherwise(0.0), None)


def bigrams(c: Column) -> Column:
    """Different pairs of neighbouring characters."""
    starts = lambda t: F.sequence(F.lit(1), F.length(t) - 1)
    pairs = rx.let(c, lambda t: F.when(F.length(t) > 1, F.transform(starts(t), lambda i: F.substring(t, i, F.lit(2)))).when(t.isNotNull(), F.array().cast("array<string>")))
    return F.array_distinct(pairs)


def sorensen_dice_coefficient(a: Column | str, b: Column | str) -> Column:
    """Of the sets of bigrams; each text and each set is computed once."""

    def of_sets(g: Column) -> Column:
        total = F.size(g["x"]) + F.size(g["y"])
        return F.when(total > 0, 2.0 * F.size(F.array_intersect(g["x"], g["y"])) / total).otherwise(0.0)

    def of_texts(t: Column) -> Column:
        score = rx.let(F.struct(bigrams(t["a"]).alias("x"), bigrams(t["b"]).alias("y")), of_sets)
        return F.when(t["a"].isNull() | t["b"].isNull(), None).when((t["a"] == "") | (t["b"] == ""), 0.0).when(t["a"] == t["b"], 1.0).otherwise(score)

    return rx.let(F.struct(rx.col(a).alias("a"), rx.col(b).alias("b")), of_texts)


def hamming(a: Column | str, b: Column | str, mode: str = "null") -> Column:
    """How many places differ; texts of unequal lengths give NULL, or an error if mode is 'fail'."""
    a, b = rx.col(a), rx.col(b)
    diff = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    other = F.raise_error(F.lit("texts differ in length")).cast("int") if mode == "fail" else F.lit(None)
    return F.when(F.length(a) == F.length(b), diff).when(a.isNotNull() & b.isNotNull(), other)


def mra_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaro-Winkler of the two match-rating codes; 0 if their lengths differ by more than two."""
    a, b = rx.col(a), rx.col(b)
    x, y = phonetic.mra_code(a), phonetic.mra_code(b)
    near = F.abs(F.length(x) - F.length(y)) <= 2
    return _guard(a, b, F.when(near, jaro_winkler_score(x, y)).otherwise(0.0), None)


def are_equivalent(a: Column | str, b: Column | str, levenshtein_threshold: float = 0.85, jaro_winkler_threshold: float = 0.9, metaphone_required: bool = True) -> Column:
    """Struct of is_match and its measures; if a text is empty there is no match and no measure."""
    a, b = rx.col(a), rx.col(b)
    return equivalence(a, b, jaro_winkler_score(a, b), mra_similarity(a, b), levenshtein_threshold, jaro_winkler_threshold, metaphone_required)


def equivalence(a: Column, b: Column, jw: Column, mra: Column, levenshtein_threshold: float, jaro_winkler_threshold: float, metaphone_required: bool) -> Column:
    """are_equivalent() of two texts whose Jaro-Winkler and match-rating scores are known."""
    lev = levenshtein_score(a, b)
    phonetic_match = mra >= 0.8
    close, near = lev >= levenshtein_threshold, jw >= jaro_winkler_threshold
    match = (phonetic_match | (close & near)) if metaphone_required else (close | near)
    ok = (F.length(a) > 0) & (F.length(b) > 0)
    return F.struct(
        F.coalesce(ok & match, F.lit(False)).alias("is_match"), F.when(ok, lev).alias("levenshtein_ratio"), F.when(ok, jw).alias("jaro_winkler_score"),
        F.when(ok, phonetic_match).alias("phonetic_match"), F.when(ok, mra).alias("mra_similarity"),
    )


def similarity(a: Column | str, b: Column | str, algorithm: str = "levenshtein") -> Column:
    """Struct of similarity and score (in 0..100) by one of nine algorithms."""
    codes = {"soundex": phonetic.soundex, "metaphone": phonetic.metaphone}
    kinds = {"levenshtein": levenshtein_score, "jaro_winkler": jaro_winkler_score, "jaccard": jaccard_similarity, "sorensen_dice": sorensen_dice_coefficient, "mra": mra_similarity}
    name = algorithm.lower().replace("-", "_")
    if name in kinds:
        sim = kinds[name](a, b)
    elif name == "lcs":
        sim = lcs_score(a, b)["similarity"]
    elif name in codes:
        sim = (codes[name](a) == codes[name](b)).cast("double")
    elif name == "double_metaphone":
        x, y = phonetic.double_metaphone(a), phonetic.double_metaphone(b)
        pick = lambda s: (s["primary"], s["alternate"])
        sim = F.greatest(*[(p == q).cast("double") for p in pick(x) for q in pick(y)])
    else:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return F.struct(sim.alias("similarity"), (1.0 - sim).alias("distance"), (sim * 100.0).alias("score"))
