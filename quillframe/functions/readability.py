"""Readability indices and flags of text quality, as expressions of counts that Arrow batches give."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..runtime import ship
from . import rx

_VOWELS = "aeiouyàáâãäåèéêëìíîïòóôõöùúûüæœ"
COMMON_BIGRAMS = sorted("al an ar as at co de ea ed en er es ha he hi ic in io is it le me nd ne ng nt of on or ou re ri ro se st te th ti to ve".split(), key=lambda x: x[::-1])
PLACEHOLDERS = sorted("n/a|na|tba|tbd|fixme|todo|testing|test|xxx|abc|aaa|asdf|baz|bar|foo|example|sample|dummy|placeholder|tmp|temp|null|none|undefined|pending|lorem ipsum".split("|"), key=lambda x: (len(x), x[::-1]))


def count_syllables(c: Column | str, lang: str = "en") -> Column:
    """Vowel groups; in English three letters are one syllable and a final e is silent, but not le."""
    w = F.lower(F.trim(rx.col(c)))
    if lang != "en":
        return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(w, F.lit(f"[{_VOWELS}]+"))))
    w = F.regexp_replace(w, "[^a-z]", "")
    spoken = F.regexp_replace(w, "(?<!l)e$", "")
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(spoken, F.lit("[aeiouy]+"))))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(rx.col(c), F.lit("[a-zA-Z]+"), F.lit(0))


def count_sentences(c: Column | str) -> Column:
    """Pieces between ends of sentences that aren't blank; 1 at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(rx.col(c), "[.!?]+", -1), lambda s: rx.has(s, r"\S"))))


_BLANKS = frozenset([b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80", *(bytes([0xE2, 0x80, k]) for k in range(0x80, 0x8B))])
_COUNTS = "words int, letters bigint, sentences int, syllables bigint, hard int, different int"
#: Bytes of a text that are counted at a time, and classes of bytes: letter, vowel, end of sentence, blank.
_PART = 1 << 20


def _classes():
    import numpy as np

    t = np.zeros(256, np.uint8)
    for bit, chars in ((1, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "aeiouyAEIOUY"), (4, ".!?"), (8, "\t\n\x0b\x0c\r ")):
        t[list(chars.encode())] |= bit
    return t


def _counts_of(texts: list[bytes], table) -> list:
    """The counts of some texts, as rows of an array, by one pass over all their bytes: words are runs of
    ASCII letters, sentences what is between ends and has anything but white space."""
    import numpy as np

    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    kind = table[data]
    kind[ends - 1] |= 4  # a text's end ends a sentence; the byte isn't one of the text
    for lead in np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))):
        if (seq := data[lead : lead + (2 if data[lead] == 0xC2 else 3)].tobytes()) in _BLANKS:
            kind[lead : lead + len(seq)] = 8
    letter = (kind & 1).astype(bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter))))
    first, after = edge[0::2], edge[1::2]
    vowel = (kind & 2).astype(bool)
    begun = vowel.copy()
    begun[1:] &= ~vowel[:-1]
    groups = np.concatenate(([0], np.cumsum(begun, dtype=np.int32)))
    # words begin at letters, so no group reaches over a word's start or end
    size, n = after - first, groups[after] - groups[first]
    low = data | 0x20
    long = size > 3
    last, before = low[after - 1], after - np.minimum(size, 2)
    silent = long & (last == ord("e")) & (low[before] != ord("l")) & ~vowel[before]
    n = np.where(long, np.maximum(1, n - silent), 1)
    upto = lambda v: np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(v, dtype=np.int64)))[np.searchsorted(first, ends)])))
    solid = np.flatnonzero(kind & 12 == 0)
    stops = np.flatnonzero(kind & 4)
    full = np.diff(np.concatenate(([0], np.searchsorted(solid, stops)))) > 0
    spoken = np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(full)))[np.searchsorted(stops, ends)])))
    return [upto(np.ones(len(n), np.int8)), upto(size), np.maximum(1, spoken), upto(n), upto(n >= 3)]


def counts(c: Column | str, different: bool = False) -> Column:
    """Struct of what the indices are made of: words (runs of ASCII letters), their letters, sentences,
    syllables in English, words of three syllables at least, different words (if asked for). NULL gives
    NULL. Arrow batches: each text is read once, some at a time."""
    ship()

    @F.arrow_udf(_COUNTS)
    def run(texts):
        import re

        import numpy as np
        import pyarrow as pa

        table, word, rows, part, held = _classes(), re.compile(rb"[a-z]+"), [], [], 0
        for t in texts:
            part.append(t.as_py().encode() if t.is_valid else b"")
            held += len(part[-1])
            if held > _PART:
                rows.append(_counts_of(part, table))
                rows[-1].append([len(set(word.findall(x.lower()))) for x in part] if different else np.zeros(len(part)))
                part, held = [], 0
        if part:
            rows.append(_counts_of(part, table))
            rows[-1].append([len(set(word.findall(x.lower()))) for x in part] if different else np.zeros(len(part)))
        names, kinds = [f.split()[0] for f in _COUNTS.split(", ")], [pa.int64() if "bigint" in f else pa.int32() for f in _COUNTS.split(", ")]
        cols = [pa.array(np.concatenate([r[k] for r in rows]) if rows else [], pa.int64()).cast(kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(cols, names=names, mask=texts.is_null())

    return run(rx.col(c))


def _ratio(c: Column | str, formula, m: Column | None = None) -> Column:
    """The formula of the counts and, as doubles, of words and sentences; 0 without words."""
    m = counts(c) if m is None else m
    return F.when(m["words"] == 0, F.lit(0.0)).when(m["words"].isNotNull(), formula(m, m["words"].cast("double"), m["sentences"].cast("double")))


def flesch_reading_ease(c: Column | str, m: Column | None = None) -> Column:
    return _ratio(c, lambda m, n, s: 206.835 - 1.015 * (n / s) - 84.6 * (m["syllables"] / n), m)


def flesch_kincaid_grade(c: Column | str) -> Column:
    return _ratio(c, lambda m, n, s: 0.39 * (n / s) + 11.8 * (m["syllables"] / n) - 15.59)


def gunning_fog_index(c: Column | str) -> Column:
    return _ratio(c, lambda m, n, s: 0.4 * (n / s + 100 * (m["hard"] / n)))


def coleman_liau_index(c: Column | str, m: Column | None = None) -> Column:
    return _ratio(c, lambda m, n, s: 0.0588 * (m["letters"].cast("double") / n * 100) - 0.296 * (s / n * 100) - 15.8, m)


def automated_readability_index(c: Column | str, m: Column | None = None) -> Column:
    return _ratio(c, lambda m, n, s: 4.71 * (m["letters"].cast("double") / n) + 0.5 * (n / s) - 21.43, m)


def lexical_diversity(c: Column | str, m: Column | None = None) -> Column:
    return _ratio(c, lambda m, n, s: m["different"] / n, counts(c, True) if m is None else m)


def text_complexity_score(c: Column | str) -> Column:
    """Struct of three rounded indices, lexical diversity and their weighed sum."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    m = counts(c, True)
    fre, cli, ari, lex = (index(c, m) for index in (flesch_reading_ease, coleman_liau_index, automated_readability_index, lexical_diversity))
    score = 0.4 * clamp(100.0 - fre) + 0.2 * clamp(cli * 5.0) + 0.2 * clamp(ari * 5.0) + 0.2 * (lex * 100.0)
    return F.struct(
        F.round(fre, 2).alias("flesch"), F.round(cli, 2).alias("coleman_liau"), F.round(ari, 2).alias("ari"),
        F.round(lex, 4).alias("lexical_diversity"), F.when(m["words"] == 0, 0.0).otherwise(F.round(score, 2)).alias("complexity_score"),
    )


def is_gibberish(c: Column | str, threshold: float = 0.35) -> Column:
    """Mean of three penalties above the threshold: share of vowels, of common letter pairs, of
    different letters. Blank and nearly letterless texts are gibberish; NULL is."""
    m = _letter_counts(F.lower(rx.sub(F.coalesce(rx.col(c), F.lit("")), r"\P{L}+")))
    n = m["n"]
    vowels, common, different = m["vowels"] / n, m["common"] / (n - 1), m["different"] / n
    score = (F.when((vowels >= 0.2) & (vowels <= 0.6), 0.0).otherwise(1.0) + (1.0 - common) + F.when(different > 0.8, different).otherwise(0.0)) / 3.0
    return F.when(n < 3, True).otherwise(score > threshold)


def _letter_counts(c: Column) -> Column:
    """Struct of the letters of a text that has nothing else: how many, vowels, common pairs, different."""
    ship()

    @F.arrow_udf("n int, vowels int, common int, different int")
    def run(texts):
        import numpy as np
        import pyarrow as pa

        common = np.zeros(1 << 16, bool)
        common[[p.encode()[0] << 8 | p.encode()[1] for p in COMMON_BIGRAMS]] = True
        rows = []
        for t in texts:
            t = t.as_py()
            raw = t.encode()
            codes = np.frombuffer(raw, np.uint8).astype(np.uint16)
            rows.append((len(t), len(raw) - len(raw.translate(None, b"aeiou")), int(common[codes[:-1] << 8 | codes[1:]].sum()), len(set(t))))
        cols = np.array(rows, np.int32).reshape(-1, 4)
        return pa.StructArray.from_arrays([pa.array(cols[:, k].copy()) for k in range(4)], names=["n", "vowels", "common", "different"])

    return run(c)


def is_placeholder_text(c: Column | str) -> Column:
    t = F.lower(rx.sub(F.coalesce(rx.col(c), F.lit("")), r"\A\s+|\s+\z"))
    solid = F.replace(t, F.lit(" "), F.lit(""))
    single = F.length(F.replace(solid, F.substring(solid, 1, 1), F.lit(""))) == 0
    return (t == "") | t.isin(PLACEHOLDERS) | t.startswith("lorem ipsum") | single


def text_density_score(c: Column | str) -> Column:
    """Letters and numbers among all characters, to 4 places; '' and NULL give 0. The ten-thousandths
    are rounded as numbers, as in SQL: round() goes by the digits that are written (57 of 800, say)."""
    c = F.coalesce(rx.col(c), F.lit(""))
    whole = lambda y: F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)
    share = F.length(rx.sub(c, r"[^\p{L}\p{N}]+")) / F.length(c)
    return F.when(c == "", 0.0).otherwise(rx.let(share * 10000.0, whole) / 10000.0)
