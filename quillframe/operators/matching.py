"""Matching of texts: pairs, best matches, duplicates.

Joins on similarity are lossless: a score of at least t means at most d = (1 - t) * longer length
edits, and different texts meet in tries that are given up beyond that (see tries.py). Texts that many
rows have, or that share most of their characters, don't make all pairs meet.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions import normalize, ops, phonetic, rx, similarity as S
from ..runtime import ship
from . import tries
from .components import connected_components

_NICK = {
    "es": "FCO:FRANCISCO PACO:FRANCISCO PACO:FRAN PEPE:JOSE MA:MARIA Mª:MARIA MANOLO:MANUEL JAVI:JAVIER NACHO:IGNACIO LOLA:DOLORES QUIQUE:ENRIQUE TOÑO:ANTONIO CHEMA:JOSE RAFA:RAFAEL PILI:PILAR CONCHA:CONCEPCION",
    "en": "BILL:WILLIAM WILL:WILLIAM BOB:ROBERT ROB:ROBERT DICK:RICHARD RICK:RICHARD JIM:JAMES JACK:JOHN MIKE:MICHAEL TOM:THOMAS LIZ:ELIZABETH BETH:ELIZABETH KATE:KATHERINE PEGGY:MARGARET TED:EDWARD CHUCK:CHARLES TONY:ANTHONY",
    "fr": "JO:JOSEPH MANU:EMMANUEL FRED:FREDERIC ALEX:ALEXANDRE NICO:NICOLAS PHIL:PHILIPPE KATI:CATHERINE GUI:GUILLAUME",
    "de": "HANS:JOHANNES FRITZ:FRIEDRICH KLAUS:NIKOLAUS SEPP:JOSEF UWE:ULRICH KATHI:KATHARINA GRETE:MARGARETE HEINZ:HEINRICH",
    "it": "BEPPE:GIUSEPPE PEPPE:GIUSEPPE GIGI:LUIGI TONI:ANTONIO NINO:ANTONINO LELLA:RAFFAELLA PINO:GIUSEPPE DINO:BERNARDINO",
    "pt": "ZE:JOSE CHICO:FRANCISCO TONHO:ANTONIO BETO:ROBERTO NANDO:FERNANDO GUTO:AUGUSTO DUDA:EDUARDO LENA:HELENA",
}


def nicknames(language: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for pair in _NICK.get(language, "").split():
        a, b = pair.split(":")
        out.setdefault(a, []).append(b)
    return out


@dataclass(frozen=True)
class MatcherConfig:
    levenshtein_threshold: float = 0.85
    jaro_winkler_threshold: float = 0.90
    metaphone_required: bool = True
    remove_accents: bool = True
    normalize_whitespace: bool = True
    normalize_punctuation: bool = True
    normalize_parentheses: bool = False

    def __post_init__(self):
        if not (0 <= self.levenshtein_threshold <= 1 and 0 <= self.jaro_winkler_threshold <= 1):
            raise ValueError("thresholds are from 0 to 1")

    @classmethod
    def strict(cls):
        return cls(0.95, 0.95, True)

    @classmethod
    def default(cls):
        return cls()

    @classmethod
    def lenient(cls):
        return cls(0.75, 0.80, False)

    @classmethod
    def fuzzy(cls):
        return cls(0.65, 0.70, False)

    def to_dict(self) -> dict:
        return asdict(self)

    def with_(self, **changes) -> "MatcherConfig":
        return replace(self, **changes)


DEFAULT = MatcherConfig()


def normalize_for_match(c: Column | str, config: MatcherConfig = DEFAULT, for_names: bool = False, case_mode: str = "lower") -> Column:
    """Text in the form in which it is compared."""
    if case_mode not in ("upper", "lower", "title", "none"):
        raise ValueError("case_mode is upper, lower, title or none")
    if for_names:
        out = rx.squeeze(rx.sub(F.upper(rx.col(c)), r"[^a-zA-ZÀ-ɏḀ-ỿ\s'-]"))
    else:
        out = normalize.normalize_text(c, case_mode == "lower", config.normalize_punctuation, config.normalize_whitespace, config.remove_accents, config.normalize_parentheses)
    return {"upper": F.upper, "lower": F.lower, "title": normalize.title_case, "none": lambda x: x}[case_mode](out)


# --- pairs of columns


def pattern_string(a: Column | str, b: Column | str) -> Column:
    """Equal characters as they are, a dot for each place that differs."""
    x, y = F.split(rx.col(a), ""), F.split(rx.col(b), "")
    return F.concat_ws("", F.zip_with(x, y, lambda p, q: F.when(p == q, p).otherwise(F.lit("."))))


def similarity_percentage(a: Column | str, b: Column | str) -> Column:
    """100 for equal texts, the ratio of lengths if one contains the other, else equal places of the
    longer text's characters that aren't blanks."""
    a, b = rx.squeeze(a), rx.squeeze(b)
    short, long = F.when(F.length(a) > F.length(b), b).otherwise(a), F.when(F.length(a) > F.length(b), a).otherwise(b)
    dots = F.length(F.regexp_replace(F.replace(pattern_string(short, long), F.lit(" "), F.lit("")), r"[^.]", ""))
    solid = F.length(F.replace(long, F.lit(" "), F.lit("")))
    return F.when(a == b, 100.0).when(F.instr(long, short) > 0, F.length(short) / F.length(long) * 100.0).otherwise((solid - dots) / solid * 100.0)


def same_chars(a: Column | str, b: Column | str) -> Column:
    """Equal characters as often, whatever their order, accents and case."""
    form = lambda x: F.array_sort(F.split(F.upper(F.replace(ops.flat_vowels(x), F.lit(" "), F.lit(""))), ""))
    return (F.length(rx.col(a)) > 0) & (F.length(rx.col(b)) > 0) & (form(a) == form(b))


def same_chars_similarity(a: Column | str, b: Column | str) -> Column:
    return S.jaccard_similarity(F.upper(ops.flat_vowels(a)), F.upper(ops.flat_vowels(b)))


def _is_subsequence(short: Column, long: Column) -> Column:
    """Whether the tokens occur in order."""
    at = F.aggregate(long, F.lit(1), lambda i, x: F.when((i <= F.size(short)) & (x == F.try_element_at(short, i)), i + 1).otherwise(i))
    return at > F.size(short)


def compare_tokens(a: Column | str, b: Column | str, keep_order: bool = True, require_same_len: bool = False) -> Column:
    """As many tokens: all in common. Else one more, of four at least, and the others in order (or,
    without keep_order, as often)."""
    a, b = rx.col(a), rx.col(b)
    x, y = F.split(rx.squeeze(a), " "), F.split(rx.squeeze(b), " ")
    common = F.size(F.array_intersect(x, y))
    n, m = F.size(x), F.size(y)
    short, long = F.when(n < m, x).otherwise(y), F.when(n < m, y).otherwise(x)
    more = (F.greatest(n, m) >= 4) & (F.abs(n - m) == 1) & (common == F.least(n, m))
    order = _is_subsequence(short, long) if keep_order else _is_subsequence(F.array_sort(short), F.array_sort(long))
    unequal = F.lit(False) if require_same_len else more & order
    return F.when((a == "") | (b == ""), False).when(a == b, True).when(n == m, common == n).otherwise(unequal)


def compare_phrases(a: Column | str, b: Column | str, threshold: float = 0.8, config: MatcherConfig = DEFAULT) -> Column:
    """Struct: Dice of bigrams, and sorted words in common and in one phrase only. Each phrase is
    normalised once, and what is compared of it is computed once."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold is from 0 to 1")

    def measured(t: Column) -> Column:
        words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
        return rx.let(F.struct(S.sorensen_dice_coefficient(t["x"], t["y"]).alias("sim"), words(t["x"]).alias("u"), words(t["y"]).alias("v")), told)

    def told(m: Column) -> Column:
        sim, u, v = m["sim"], m["u"], m["v"]
        return F.struct(
            (sim >= threshold).alias("is_match"), sim.alias("similarity"), (1.0 - sim).alias("distance"), (sim * 100.0).alias("score"),
            F.array_sort(F.array_intersect(u, v)).alias("common_words"), F.array_sort(F.array_except(u, v)).alias("unique_to_phrase1"), F.array_sort(F.array_except(v, u)).alias("unique_to_phrase2"),
        )

    return rx.let(F.struct(normalize_for_match(a, config).alias("x"), normalize_for_match(b, config).alias("y")), measured)


def find_common_patterns(a: Column | str, b: Column | str, min_length: int = 3, config: MatcherConfig = DEFAULT) -> Column:
    if min_length < 1:
        raise ValueError("min_length is at least 1")
    x, y = normalize_for_match(a, config), normalize_for_match(b, config)
    # lengths and count in one struct, and what follows from them: texts are normalised for these alone
    parts = F.struct(F.length(x).alias("n"), F.length(y).alias("m"), S.lcs_count(x, y).alias("lcs"))

    def told(t: Column) -> Column:
        n, m, lcs = t["n"], t["m"], t["lcs"]
        sim = F.when(n.isNull() | m.isNull(), F.lit(None).cast("double")).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(lcs / F.greatest(n, m))
        ratio = F.when(n + m > 0, lcs / ((n + m) / 2.0)).otherwise(0.0)
        return F.struct(lcs.alias("lcs_length"), ratio.alias("lcs_ratio"), sim.alias("similarity"), (sim * 100.0).alias("score"), ((lcs >= min_length) & (ratio >= 0.3)).alias("has_significant_overlap"))

    return rx.let(parts, told)


def compare_text(a: Column | str, b: Column | str) -> Column:
    a, b = rx.col(a), rx.col(b)
    same = a == b
    return F.struct(F.when(same, 1.0).otherwise(S.sorensen_dice_coefficient(a, b)).alias("sorensen_dice"), F.when(same, 1.0).otherwise(S.ratcliff_obershelp_score(a, b)).alias("ratcliff_obershelp"), same.alias("exact_match"))


def is_abbreviation(c: Column | str) -> Column:
    """Three characters at most, not counting dots at the end."""
    c = rx.col(c)
    return (c != "") & (F.length(F.regexp_replace(c, r"\.+$", "")) <= 3)


def _undotted(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\.+$", ""))


def compare_with_abbreviation(a: Column | str, b: Column | str, language: str = "es") -> Column:
    """1 for a nickname or an abbreviation of the other word, 0 for another abbreviation, else
    Jaro-Winkler."""
    a, b = rx.col(a), rx.col(b)
    parts = F.struct(a.alias("a"), b.alias("b"), _undotted(a).alias("x"), _undotted(b).alias("y"), S.jaro_winkler_score(_undotted(a), _undotted(b)).alias("jw"))
    return rx.let(parts, lambda t: _abbreviation(t["a"], t["b"], t["x"], t["y"], t["jw"], language))


def _abbreviation(a: Column, b: Column, x: Column, y: Column, jw: Column, language: str) -> Column:
    nick = F.lit(False)
    for k, full in nicknames(language).items():
        nick = nick | ((x == k) & y.isin(full)) | ((y == k) & x.isin(full))
    p, q = is_abbreviation(a), is_abbreviation(b)
    return F.when((a == "") | (b == ""), 0.0).when(nick, 1.0).when(p & ~q, y.startswith(x).cast("double")).when(q & ~p, x.startswith(y).cast("double")).otherwise(jw)


def compare_names(a: Column | str, b: Column | str, strict: bool | None = False, config: MatcherConfig = DEFAULT, language: str = "es") -> Column:
    """Struct of is_match, how, and the measures of the normalised names, which are normalised for the
    Python functions and once for all else."""
    a, b = rx.col(a), rx.col(b)
    x, y = (normalize_for_match(t, config, True, "title") for t in (a, b))
    required = config.metaphone_required if strict is None else strict
    parts = F.struct(
        a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y"), _undotted(x).alias("u"), _undotted(y).alias("v"),
        S.jaro_winkler_score(x, y).alias("jw"), S.jaro_winkler_score(_undotted(x), _undotted(y)).alias("ju"), S.mra_similarity(x, y).alias("mra"),
    )

    def measured(t: Column) -> Column:
        eq = S.equivalence(t["x"], t["y"], t["jw"], t["mra"], config.levenshtein_threshold, config.jaro_winkler_threshold, required)
        short = _abbreviation(t["x"], t["y"], t["u"], t["v"], t["ju"], language) == 1.0
        return rx.let(F.struct(t["a"].alias("a"), t["b"].alias("b"), eq.alias("eq"), short.alias("short")), told)

    def told(t: Column) -> Column:
        ok = (F.length(t["a"]) > 0) & (F.length(t["b"]) > 0)
        how = F.when(~ok, "empty").when(t["a"] == t["b"], "exact").when(t["short"], "abbreviation").when(t["eq"]["is_match"], "similar").otherwise("none")
        return rx.let(F.struct(how.alias("how"), t["eq"].alias("eq")), lambda h: result(h["how"], h["eq"]))

    def result(how: Column, eq: Column) -> Column:
        sure = how.isin("exact", "abbreviation")
        return F.struct((sure | (how == "similar")).alias("is_match"), how.alias("how"), F.when(sure, 1.0).otherwise(eq["levenshtein_ratio"]).alias("levenshtein_ratio"), F.when(sure, 1.0).otherwise(eq["jaro_winkler_score"]).alias("jaro_winkler_score"))

    return rx.let(parts, measured)


def _words_equal(w1: str, w2: str, nick: dict[str, list[str]], fuzzy: bool) -> bool:
    if w1 == w2:
        return True
    u, v = w1.rstrip(".").upper(), w2.rstrip(".").upper()
    if v in nick.get(u, ()) or u in nick.get(v, ()):
        return True
    p, q = len(u) <= 3, len(v) <= 3
    if p != q and (v.startswith(u) if p else u.startswith(v)):
        return True
    if not fuzzy:
        return False
    n = max(len(w1), len(w2))
    return S.jaro_winkler(w1, w2) >= 0.85 or 1 - _distance(w1, w2) / n >= 0.8


def _distance(s: str, t: str) -> int:
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def align(x: list[str], y: list[str], nick: dict[str, list[str]], fuzzy: bool = False) -> list[tuple[str | None, str | None]]:
    """Both lists next to each other in order: words that match face each other, others None."""
    out, i, j = [], 0, 0
    same = lambda p, q: _words_equal(p, q, nick, fuzzy)
    while i < len(x) and j < len(y):
        if same(x[i], y[j]):
            out.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif any(same(x[i], w) for w in y[j + 1 :]):
            out.append((None, y[j]))
            j += 1
        else:
            out.append((x[i], None))
            i += 1
    return out + [(w, None) for w in x[i:]] + [(None, w) for w in y[j:]]


def compare_name_bytokens(a: Column | str, b: Column | str, keep_order: bool = True, normalize_names: bool = True, fuzzy_align: bool = False, config: MatcherConfig = DEFAULT, language: str = "es") -> Column:
    """Struct of is_match, rule, coincidences and the aligned words."""
    ship()
    nick = nicknames(language)

    def similar(p: str, q: str) -> bool:
        if p == q or _words_equal(p, q, nick, False):
            return True
        n = max(len(p), len(q))
        return 1 - _distance(p, q) / n >= config.levenshtein_threshold or S.jaro_winkler(p, q) >= config.jaro_winkler_threshold

    @F.pandas_udf("is_match boolean, rule int, coincidences int, words1 array<string>, words2 array<string>")
    def run(s: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(s, t):
            if not p or not q:
                rows.append((False, None, 0, [], []))
                continue
            x, y = p.split(), q.split()
            if p == q:
                rows.append((True, 0, len(x), x, y))
                continue
            if not keep_order:
                x, y = sorted(x), sorted(y)
            pairs = align(x, y, nick, fuzzy_align)
            hits = sum(1 for u, v in pairs if u and v and similar(u.title(), v.title()))
            rule = None
            if len(x) == len(y) == hits:
                rule = 1
            elif min(len(x), len(y)) > 2 and hits > 2 and abs(len(x) - len(y)) == max(len(x), len(y)) - hits:
                rule = 2
            rows.append((rule is not None, rule, hits, [u for u, _ in pairs], [v for _, v in pairs]))
        return pd.DataFrame(rows, columns=["is_match", "rule", "coincidences", "words1", "words2"])

    form = (lambda c: normalize_for_match(c, config, True, "upper")) if normalize_names else (lambda c: F.upper(rx.col(c)))
    return run(form(a), form(b))


_COMMENT = {"python": "#[^\n]*", "ruby": "#[^\n]*", "sql": r"--[^\n]*|/\*.*?\*/", "php": r"(?:#|//)[^\n]*|/\*.*?\*/", **dict.fromkeys(("java", "javascript", "c", "cpp"), r"//[^\n]*|/\*.*?\*/")}
_DETAIL = "ratio double, score double, matching_blocks array<struct<text1_start:int,text2_start:int,length:int>>, opcodes array<struct<operation:string,text1_start:int,text1_end:int,text2_start:int,text2_end:int,text1_content:string,text2_content:string>>, lines_added int, lines_removed int, lines_changed int, total_lines_text1 int, total_lines_text2 int, diff string"


def detailed(s: str, t: str, case_sensitive: bool = False, show_diff: bool = True, context_lines: int = 3) -> tuple:
    x, y = (s, t) if case_sensitive else (s.lower(), t.lower())
    m = difflib.SequenceMatcher(None, x, y)
    ops_ = m.get_opcodes()
    lines = [v.splitlines(keepends=True) for v in (x, y)]
    tally = dict.fromkeys(("insert", "delete", "replace"), 0)
    for op, i, i2, j, j2 in difflib.SequenceMatcher(None, *lines).get_opcodes():
        if op in tally:
            tally[op] += max(i2 - i, j2 - j)
    shown = [(op, i, i2, j, j2, s[i:i2] if op in ("delete", "replace") else "", t[j:j2] if op in ("insert", "replace") else "") for op, i, i2, j, j2 in ops_]
    diff = "\n".join(difflib.unified_diff(s.splitlines(keepends=True), t.splitlines(keepends=True), "text1", "text2", lineterm="", n=context_lines)) if show_diff else None
    return (m.ratio(), m.ratio() * 100.0, [tuple(b) for b in m.get_matching_blocks()], shown, tally["insert"], tally["delete"], tally["replace"], len(lines[0]), len(lines[1]), diff)


def compare_text_detailed(a: Column | str, b: Column | str, case_sensitive: bool = False, show_diff: bool = True, context_lines: int = 3) -> Column:
    """Struct: ratio, matching blocks, operations, counts of changed lines, unified diff."""
    ship()
    kind = StructType.fromDDL(_DETAIL)

    @F.arrow_udf(kind)
    def run(s, t):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        # pairs that come again in a batch are compared, and made into Arrow's nested lists, once
        places: dict[tuple, int] = {}
        at = [places.setdefault(p, len(places)) for p in zip(s.to_pylist(), t.to_pylist())]
        names = kind.fieldNames()
        inner = {n: kind[n].dataType.elementType.fieldNames() for n in ("matching_blocks", "opcodes")}
        rows = []
        for p, q in places:
            r = dict.fromkeys(names) if p is None or q is None else dict(zip(names, detailed(p, q, case_sensitive, show_diff, context_lines)))
            rows.append({n: [dict(zip(inner[n], x)) for x in v] if n in inner and v is not None else v for n, v in r.items()})
        return pa.array(rows, to_arrow_type(kind)).take(pa.array(at, pa.int64()))

    return run(rx.col(a), rx.col(b))


def normalize_code(c: Column | str, language: str = "python", ignore_whitespace: bool = True, ignore_comments: bool = False) -> Column:
    out = rx.col(c)
    if ignore_comments and language.lower() in _COMMENT:
        out = F.regexp_replace(out, "(?s)" + _COMMENT[language.lower()], "")
    if ignore_whitespace:
        lines = F.transform(F.split(out, r"\r\n|[\n\r]", -1), lambda x: rx.sub(x, r"\A\s+|\s+\z"))
        out = F.concat_ws("\n", F.filter(lines, lambda x: x != ""))
    return out


def compare_code_blocks(a: Column | str, b: Column | str, language: str = "python", ignore_whitespace: bool = True, ignore_comments: bool = False) -> Column:
    """Struct of the detailed comparison of the normalised code and the score of the code as it is."""
    x, y = (normalize_code(c, language, ignore_whitespace, ignore_comments) for c in (a, b))
    d = compare_text_detailed(x, y, True)
    return F.struct(d.alias("normalized"), d["score"].alias("structural_similarity"), (S.ratcliff_obershelp_score(a, b) * 100.0).alias("original_similarity"))


# --- comparators of one's own


class Comparators:
    """Named functions (a, b) -> column. They build expressions, so they run where the built-in ones do;
    a pandas_udf will do as well."""

    def __init__(self):
        self._own: dict[str, Callable[[Column, Column], Column]] = {}

    def register(self, name: str, fn: Callable[[Column, Column], Column]) -> None:
        if not name or not callable(fn):
            raise TypeError("a comparator has a name, takes two columns and returns one")
        self._own[name] = fn

    def unregister(self, name: str) -> bool:
        return self._own.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._own)

    def run(self, name: str, a: Column | str, b: Column | str) -> Column:
        if name not in self._own:
            raise KeyError(f"no comparator {name!r}; there are {self.names()}")
        return self._own[name](rx.col(a), rx.col(b))


def explained(a: Column | str, b: Column | str, config: MatcherConfig = DEFAULT) -> Column:
    """Struct: the result of are_equivalent on normalised texts, these texts, the thresholds, and the
    reason in words."""
    x, y = normalize_for_match(a, config), normalize_for_match(b, config)

    def told(t: Column) -> Column:
        r = S.are_equivalent(t["x"], t["y"], config.levenshtein_threshold, config.jaro_winkler_threshold, config.metaphone_required)
        close, near = r["levenshtein_ratio"] >= config.levenshtein_threshold, r["jaro_winkler_score"] >= config.jaro_winkler_threshold
        reason = (
            F.when((t["x"] == "") | (t["y"] == ""), "empty text").when(t["x"] == t["y"], "equal when normalised").when(r["is_match"] & r["phonetic_match"] & config.metaphone_required, "alike in sound")
            .when(r["is_match"], "alike in letters").when(close | near, "only one measure is high enough").otherwise("no measure is high enough")
        )
        return F.struct(r.alias("result"), t["x"].alias("normalized1"), t["y"].alias("normalized2"), F.lit(config.levenshtein_threshold).alias("levenshtein_threshold"), F.lit(config.jaro_winkler_threshold).alias("jaro_winkler_threshold"), reason.alias("reason"))

    return told({"x": x, "y": y})


PRESETS = {"default": MatcherConfig, "strict": MatcherConfig.strict, "lenient": MatcherConfig.lenient, "fuzzy": MatcherConfig.fuzzy}


# --- tables


def batch_compare(pairs: DataFrame, a: str, b: str, config: MatcherConfig = DEFAULT) -> DataFrame:
    """pairs with `result`: the struct of are_equivalent on normalised texts. Rows are independent;
    each text is normalised once, in a projection of its own."""
    x, y = (n + "_" * (max(map(len, pairs.columns)) + 1) for n in ("x", "y"))
    forms = pairs.withColumns({x: normalize_for_match(a, config), y: normalize_for_match(b, config)})
    eq = S.are_equivalent(x, y, config.levenshtein_threshold, config.jaro_winkler_threshold, config.metaphone_required)
    return forms.withColumn("result", eq).drop(x, y)


def similarity_pairs(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(id1, id2, score) of all pairs of (id, s) tables with Levenshtein score >= threshold, equal
    texts included, empty ones only with empty ones. Without right: pairs within left, id1 < id2."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold is above 0 and at most 1")

    both = left if right is None else right
    x, y = (df.where("s <> ''").select("s").distinct() for df in (left, both))
    near = tries.near_texts(x, y, threshold)
    c = near.join(left.select(F.col("id").alias("i"), F.col("s").alias("x")), "x").join(both.select(F.col("id").alias("j"), F.col("s").alias("y")), "y")
    none = left.where("s = ''").select(F.col("id").alias("i")).crossJoin(both.where("s = ''").select(F.col("id").alias("j")))
    if right is None:
        c, none = c.where("i < j"), none.where("i < j")
    scored = c.select(F.col("i").alias("id1"), F.col("j").alias("id2"), (1.0 - F.col("d") / F.greatest(F.length("x"), F.length("y"))).alias("score")).where(F.col("score") >= threshold)
    return scored.union(none.select("i", "j", F.lit(1.0)))


def _items(df: DataFrame, id_col: str, text_col: str, config: MatcherConfig) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), normalize_for_match(text_col, config).alias("s")).where("id is not null and s is not null")


#: Ids of rows with equal texts that are held together.
LIST = 512


def detect_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.85, config: MatcherConfig = DEFAULT) -> DataFrame:
    """(id1, id2, score) of all pairs of rows whose normalised texts score at least threshold. Different
    texts are joined once each; the rows of a text are dealt into lists of about LIST ids, and pairs of
    lists are spread over all tasks, so what a task holds doesn't grow with the copies of a text."""
    items = _items(df, id_col, text_col, config)
    texts = items.groupBy("s").agg(F.ceil(F.count("*") / LIST).cast("int").alias("lists"))
    dealt = items.join(texts, "s").withColumn("k", F.pmod(F.xxhash64("id"), F.col("lists")).cast("int"))
    lists = dealt.groupBy("s", "k").agg(F.collect_list("id").alias("ids"))
    near = similarity_pairs(texts.select(F.col("s").alias("id"), "s"), None, threshold).select(F.col("id1").alias("s1"), F.col("id2").alias("s2"), "score")
    same = texts.select(F.col("s").alias("s1"), F.col("s").alias("s2"), F.lit(1.0).alias("score"))
    of = lambda n: texts.select(F.col("s").alias(f"s{n}"), F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias(f"k{n}"))
    pairs = near.union(same).join(of(1), "s1").join(of(2), "s2").where("s1 <> s2 or k1 <= k2")
    for n, ids in ((1, "a"), (2, "b")):
        pairs = pairs.join(lists.select(F.col("s").alias(f"s{n}"), F.col("k").alias(f"k{n}"), F.col("ids").alias(ids)), [f"s{n}", f"k{n}"])
    # a number of tasks of its own: these rows are few and small, what is made of them isn't
    spread = pairs.select("a", "b", "score", (F.expr("s1 = s2 and k1 = k2")).alias("own")).repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.select(F.explode("a").alias("x"), "b", "score", "own").select("x", F.explode("b").alias("y"), "score", "own").where("x < y or x > y and not own")
    return rows.select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), "score")


def find_best_match(targets: DataFrame, candidates: DataFrame, target_id: str, target: str, candidate_id: str, candidate: str, threshold: float = 0.85, config: MatcherConfig = DEFAULT) -> DataFrame:
    """(target_id, candidate_id, score): for each target the equal candidate, else the one that is
    equal when normalised, else the most similar; the least candidate id wins ties. Targets without
    a candidate of the threshold have NULL and score 0."""
    ids = compare_lists(targets, candidates, target_id, target, candidate_id, candidate, 1, threshold, config)
    return targets.select(F.col(target_id).alias("target_id")).distinct().join(ids.drop("rank"), "target_id", "left").select("target_id", "candidate_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def compare_lists(targets: DataFrame, candidates: DataFrame, target_id: str, target: str, candidate_id: str, candidate: str, top_k: int | None = None, threshold: float = 0.85, config: MatcherConfig = DEFAULT) -> DataFrame:
    """(target_id, candidate_id, score, rank): all candidates of the threshold, best first (raw equals
    before others of score 1, then by id), top_k a target."""
    if top_k is not None:  # of rows with one text, the least ids come first
        least = Window.partitionBy(candidate).orderBy(candidate_id)
        candidates = candidates.where(F.col(candidate_id).isNotNull()).select(candidate_id, candidate, F.row_number().over(least).alias("row_")).where(F.col("row_") <= top_k).drop("row_")
    pairs = similarity_pairs(_items(targets, target_id, target, config), _items(candidates, candidate_id, candidate, config), threshold)
    raw = targets.select(F.col(target_id).alias("id1"), F.col(target).alias("r")).join(candidates.select(F.col(candidate_id).alias("id2"), F.col(candidate).alias("r")), "r").select("id1", "id2", F.lit(True).alias("raw"))
    best = pairs.join(raw.distinct(), ["id1", "id2"], "left")
    w = Window.partitionBy("id1").orderBy(F.desc("score"), F.col("raw").isNull(), "id2")
    ranked = best.withColumn("rank", F.row_number().over(w))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.select(F.col("id1").alias("target_id"), F.col("id2").alias("candidate_id"), "score", "rank")


def _shared_characters(code: Column, threshold: float) -> Column:
    """Keys by which codes of Jaro-Winkler >= threshold meet: a score of t means a Jaro of at least
    (t - 0.4) / 0.6, so texts of n and m characters have at least (3 j - 1) n m / (n + m) of them in
    common: they share a sorted choice of as many (of three at most, that is enough)."""
    j = max(0.0, (threshold - 0.4) / 0.6)
    least = lambda n, m: min(3, max(1, math.ceil((3 * j - 1) * n * m / (n + m) - 1e-9)))
    chars = F.array_sort(F.split(code, ""))
    rest = lambda i: F.slice(chars, i + 2, F.greatest(F.size(chars) - i - 1, F.lit(0)))
    pairs = F.flatten(F.transform(chars, lambda x, i: F.transform(rest(i), lambda y: F.concat(x, y))))
    triples = F.flatten(F.flatten(F.transform(chars, lambda x, i: F.transform(rest(i), lambda y, k: F.transform(rest(i + k + 1), lambda z: F.concat(x, y, z))))))
    out = F.array().cast("array<string>")
    for k, keys in ((1, chars), (2, pairs), (3, triples)):
        lengths = [n for n in range(1, 7) if any(least(n, m) == k for m in range(max(1, n - 2), min(6, n + 2) + 1))]
        out = F.concat(out, F.when(F.length(code).isin(lengths), keys).otherwise(F.array().cast("array<string>"))) if lengths else out
    return F.array_distinct(out)


def find_phonetic_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, use_mra: bool = True) -> DataFrame:
    """(id, group): names that sound alike, joined by chains; groups of one are left out. With MRA,
    codes of at least the threshold's Jaro-Winkler are alike; else equal metaphones."""
    items = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t <> ''")
    if not use_mra:
        coded = items.select("id", phonetic.metaphone("t").alias("code"))
        return coded.withColumn("group", F.min("id").over(Window.partitionBy("code"))).withColumn("n", F.count("*").over(Window.partitionBy("code"))).where("n > 1").select("id", "group")
    codes = items.select("id", phonetic.mra_code("t").alias("code"))
    kinds = codes.groupBy("code").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    keyed = kinds.select("code", "rep", F.explode(_shared_characters(F.col("code"), threshold)).alias("key"))
    x, y = (keyed.select(F.col("code").alias(f"c{k}"), F.col("rep").alias(f"r{k}"), "key") for k in (1, 2))
    near = x.join(y, "key").where("c1 < c2 and abs(length(c1) - length(c2)) <= 2").select("c1", "r1", "c2", "r2").distinct()
    edges = near.where(S.jaro_winkler_score("c1", "c2") >= threshold).select(F.col("r1").alias("a"), F.col("r2").alias("b"))
    groups = connected_components(edges)
    placed = kinds.join(groups, kinds["rep"] == groups["node"], "left").select("code", F.coalesce("group", "rep").alias("root"))
    out = codes.join(placed, "code").withColumn("n", F.count("*").over(Window.partitionBy("root"))).withColumn("group", F.min("id").over(Window.partitionBy("root")))
    return out.where("n > 1").select("id", "group")
