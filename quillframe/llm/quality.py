"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every rule bounds one measure of a text and applies from a number of words on. Measures are built-in
expressions: counts of words and lines, symbols and punctuation against words, stop words against
words, repeated lines against lines. A text passes if no rule fails.

Defined results: NULL, empty and blank texts have 0 words and NULL for the other measures, and fail
`n_words`. Texts of any length are measured whole, and none fails for its length: the ratio of
distinct words, which falls as any prose grows, is the mean over consecutive blocks of BLOCK words of
the whole text. Rows are independent; repeated rows get repeated results, an empty table an empty
one. Columns of df named like a measure, `failed` or `keep` are replaced by measure();
drop_low_quality() returns df's own columns untouched.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

STOP_WORDS = (
    "the of and to in a is that for it on was with be as by are this from at or an have not which he you his they we but had has were their all can there been if more when will would who so no "
    "de la le et les des en un une du que qui dans pour par sur est pas au avec il elle ne se ce sont plus el los las y del con para su al lo como o pero sus "
    "der die und den das von zu mit sich dem nicht ein eine auf für ist im auch es als aus er dass sie nach wird bei einer um am sind noch wie einem über que os uma não di il che è per non sono"
).split()
SYMBOLS = "#$%&*|~^<>{}=_@+!"
_BLANK = "[ \\t\\n\\r\\f]+"


class Rule(NamedTuple):
    measure: str
    low: float | None
    high: float | None
    from_words: int = 0


RULES = (
    Rule("n_words", 1, None),
    Rule("mean_word_length", 2, 12, 5),
    Rule("symbol_ratio", None, 0.25, 5),
    Rule("upper_ratio", None, 0.7, 5),
    Rule("alpha_word_ratio", 0.7, None, 10),
    Rule("stop_word_ratio", 0.06, None, 20),
    Rule("unique_word_ratio", 0.15, None, 20),
    Rule("repeated_line_ratio", None, 0.4),
    Rule("bullet_line_ratio", None, 0.9, 20),
    Rule("ellipsis_line_ratio", None, 0.3, 20),
)
MEASURES = tuple(r.measure for r in RULES)
#: Words of a block; texts of no more words have the ratio of all their words.
BLOCK = 1000


def _parts(text: str) -> dict[str, str]:
    """Arrays and strings that several measures use."""
    return {
        "_words": f"filter(split({text}, r'{_BLANK}'), w -> w <> '')",
        "_plain": f"regexp_replace(lower({text}), r'[^\\p{{L}}]+', ' ')",
        "_lines": f"filter(transform(split({text}, r'\\n'), l -> trim(BOTH ' \t\r\f' FROM l)), l -> l <> '')",
        "_chars": f"length({text})",
        "_bare": f"length(translate({text}, '{SYMBOLS}', ''))",
        "_upper": f"length({text}) - length(regexp_replace({text}, r'\\p{{Lu}}', ''))",
        "_solid": f"length(translate({text}, ' \t\n\r' || chr(12), ''))",
    }


def _measures() -> dict[str, str]:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    n = "nullif(size(_words), 0)"
    lines = "nullif(size(_lines), 0)"
    return {
        "n_words": "cast(coalesce(greatest(size(_words), 0), 0) as bigint)",
        "mean_word_length": f"_solid / {n}",
        "symbol_ratio": f"(_chars - _bare) / {n}",
        "upper_ratio": "_upper / nullif(length(translate(_plain, ' ', '')), 0)",
        "alpha_word_ratio": f"size(filter(_words, w -> w rlike r'\\p{{L}}')) / {n}",
        "stop_word_ratio": f"size(filter(split(_plain, ' '), w -> w in ({stop}))) / {n}",
        "unique_word_ratio": f"size(array_distinct(transform(_words, (w, i) -> concat(i div {BLOCK}, ' ', w)))) / {n}",
        "repeated_line_ratio": f"1 - size(array_distinct(_lines)) / {lines}",
        "bullet_line_ratio": f"size(filter(_lines, l -> substr(l, 1, 1) in ('-', '*', '•'))) / {lines}",
        "ellipsis_line_ratio": f"size(filter(_lines, l -> l like '%...' or l like '%…')) / {lines}",
    }


def fails(rule: Rule) -> str:
    """SQL that is true where a rule fails (any dialect)."""
    bounds = [f"{rule.measure} < {rule.low}"] * (rule.low is not None) + [f"{rule.measure} > {rule.high}"] * (rule.high is not None)
    return f"(n_words >= {rule.from_words} and ({' or '.join(bounds)}))"


def _measured(df: DataFrame, text_col: str, rules: tuple[Rule, ...], *carried) -> DataFrame:
    """The carried columns, all measures and `failed`."""
    own = [c for c, _ in carried]
    held = df.select(*[value.alias(c) for c, value in carried], F.col(f"`{text_col}`").alias("_text"))
    first = held.select(*own, *[F.expr(e).alias(n) for n, e in _parts("_text").items()])
    second = first.select(*own, *[F.expr(e).alias(n) for n, e in _measures().items()])
    return second.withColumn("failed", F.concat_ws(",", *[F.when(F.expr(fails(r)), F.lit(r.measure)) for r in rules]))


def measure(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with all measures, `failed` (names of failed rules, comma-separated) and `keep`."""
    names = {*MEASURES, "failed", "keep"}
    cols = [c for c in df.columns if c.lower() not in names]
    done = _measured(df, text_col, rules, *[(f"_c{i}", F.col(f"`{c}`")) for i, c in enumerate(cols)])
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], *MEASURES, "failed", (F.col("failed") == "").alias("keep"))


def drop_low_quality(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df whose texts pass all rules: the projection of measure(), whose good rows are
    then generated from arrays of one row or none. A filter would be pushed below the projection and
    compute every measure again for each rule."""
    done = _measured(df, text_col, rules, ("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    good = done.select(F.explode(F.when(F.col("failed") == "", F.array("_row")).otherwise(F.slice(F.array("_row"), 1, 0))).alias("row"))
    return good.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def oracle_sql(source: str = "documents") -> str:
    """The same in DuckDB's SQL, over doc_id and text."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    n, lines = "nullif(len(w), 0)", "nullif(len(l), 0)"
    return rf"""
with parts as (
  select doc_id, text,
    list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') as w,
    regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g') as plain,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12))), lambda x: x <> '') as l
  from {source}
), m as (
  select doc_id, coalesce(len(w), 0)::bigint as n_words,
    length(regexp_replace(text, '[ \t\n\r\f]', '', 'g')) / {n} as mean_word_length,
    (length(text) - length(translate(text, '{SYMBOLS}', ''))) / {n} as symbol_ratio,
    (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g'))) / nullif(length(replace(plain, ' ', '')), 0) as upper_ratio,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / {n} as alpha_word_ratio,
    len(list_filter(string_split(plain, ' '), lambda x: x in ({stop}))) / {n} as stop_word_ratio,
    len(list_distinct(list_transform(w, lambda x, i: concat((i - 1) // {BLOCK}, ' ', x)))) / {n} as unique_word_ratio,
    1 - len(list_distinct(l)) / {lines} as repeated_line_ratio,
    len(list_filter(l, lambda x: x[1] in ('-', '*', '•'))) / {lines} as bullet_line_ratio,
    len(list_filter(l, lambda x: x like '%...' or x like '%…')) / {lines} as ellipsis_line_ratio
  from parts
), f as (
  select *, concat_ws(',', {", ".join(f"case when {fails(r)} then '{r.measure}' end" for r in RULES)}) as failed from m
)
select *, failed = '' as keep from f"""
