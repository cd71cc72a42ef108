"""SQL of queries whose rules take more than an expression, in DuckDB's dialect. It says what the
rules are, in other words than the code: characters are walked, offsets summed, overlaps resolved in
lists. Parts have few different names, so rules of pairs are worked out once a pair of names."""

from __future__ import annotations

from ..functions import extract, language, reduction
from ..operators.privacy import Anonymizer

#: Letters beyond ASCII that documents have. RE2's word borders know only ASCII: in `bordered` texts
#: each such letter is a word of ASCII word characters, put back by `plain`.
_LETTERS = "éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍáúàâîôûïëÁÚÀùìòãõ"


def bordered(x: str) -> str:
    for ch in _LETTERS:
        x = f"replace({x}, '{ch}', '_{ord(ch):x}_')"
    return x


def plain(x: str) -> str:
    for ch in _LETTERS:
        x = f"replace({x}, '_{ord(ch):x}_', '{ch}')"
    return x


#: The same with one '_' for each letter, so that offsets stay.
def flat(x: str) -> str:
    return f"translate({x}, '{_LETTERS}', '{'_' * len(_LETTERS)}')"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x1c-\x1f]+', ' ', 'g'))"


_MARKS = ".,;:!?¡¿"


def _normalized(x: str, aggressive: bool = False) -> str:
    """select doc_id, out: brackets, quotes, accents, case, lone marks, other characters, white space."""
    if aggressive:
        for p in (r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}"):
            x = f"regexp_replace({x}, '{p}', '', 'g')"
    x = f"translate({x}, '\"''“”‘’', '')"
    if aggressive:
        x = f"strip_accents({x})"
    word = r"regexp_matches({}, '[\p{{L}}\p{{M}}\p{{N}}_]')"
    before, after = word.format("c[i - 1]"), word.format("c[i + 1]")
    lone = f"list_transform(range(1, len(c) + 1), lambda i: case when contains('{_MARKS}', c[i]) and not coalesce({before}, false) and not coalesce({after}, false) then ' ' else c[i] end)"
    out = f"array_to_string({lone}, '')"
    out = rf"regexp_replace(regexp_replace(regexp_replace({out}, '[{_MARKS}]+(\n?)$', '\1'), '^[{_MARKS}]+', ''), '\s+[{_MARKS}]+\s+', ' ', 'g')"
    if aggressive:
        out = rf"regexp_replace({out}, '[^a-zA-Z0-9\s]', ' ', 'g')"
    return rf"select doc_id, case when regexp_matches(text, '\S') then {_squeeze(out)} else '' end as out from (select doc_id, text, string_split(lower({x}), '') as c from documents)"


def _title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), lambda p: upper(p[1]) || lower(p[2:])), '')"


def _upper(x: str) -> str:
    return f"replace(replace(upper({x}), 'ß', 'SS'), 'ẞ', 'SS')"


def _reduced(lang: str, level: int) -> str:
    x = _upper("text")
    if lang == "de":
        x = f"replace(replace(replace({x}, 'Ä', 'AE'), 'Ö', 'OE'), 'Ü', 'UE')"
    x = f"upper(strip_accents({x}))"
    for rule in " ".join(reduction._RULES[lang][:level]).split():
        a, b = rule.split(">")
        x = f"replace({x}, '{a}', '{'' if b == '-' else b}')"
    return rf"""select doc_id, case when not regexp_matches(text, '\p{{L}}') then lower(r) when text = up then r
      when text = t and text <> lower(text) then {_title("r")} else lower(r) end as out
      from (select doc_id, text, {x} as r, {_upper("text")} as up, {_title("text")} as t from documents)"""


def _without_small_words(lang: str) -> str:
    words = sorted(reduction._SMALL[lang].split(), key=lambda w: (-len(w), w))
    pattern = r"\b(?:" + "|".join(words) + r")\b"
    elided = reduction._ELIDED.get(lang)
    x = "text"
    for p in ([r"\b" + elided] if elided else []) + [pattern]:
        coded = "".join(f"(?:_{ord(ch):x}_|_{ord(ch.upper()):x}_)" if ch in _LETTERS else ch for ch in p).replace("'", "''")
        x = plain(f"regexp_replace({bordered(x)}, '(?i){coded}', '', 'g')")
    return f"select doc_id, {_squeeze(x)} as out from documents"


def _language_normalized(lang: str) -> str:
    x = bordered("text")
    for p, full in language.abbreviations(lang).items():
        x = f"regexp_replace({x}, '(?i){p}', '{full}', 'g')"
    x = f"lower({plain(x)})"
    for p in {"es": "ñn", "de": "äae öoe üue ßss"}[lang].split():
        x = f"replace({x}, '{p[0]}', '{p[1:]}')"
    x = f"replace({x}, '-', ' ')"
    if lang != "de":
        x = f"replace({x}, '''', '')"
    return rf"select doc_id, case when regexp_matches(text, '\S') then {_squeeze(f'strip_accents({x})')} end as out from documents"


_WORDS = r"""w as (select doc_id, text, regexp_extract_all(text, '[a-zA-Z]+') as w, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))))::double as s from documents),
  y as (select doc_id, w, len(w)::double as n, s, list_transform(list_transform(w, lambda x: lower(x)), lambda x: case when length(x) <= 3 then 1
    else greatest(1, len(regexp_extract_all(case when right(x, 1) = 'e' and right(x, 2) <> 'le' then x[:-2] else x end, '[aeiouy]+'))) end) as k from w)"""
_READABLE = {
    "flesch_reading_ease": "206.835 - 1.015 * (n / s) - 84.6 * (list_sum(k) / n)",
    "flesch_kincaid": "0.39 * (n / s) + 11.8 * (list_sum(k) / n) - 15.59",
    "gunning_fog": "0.4 * (n / s + 100 * (len(list_filter(k, lambda x: x >= 3)) / n))",
    "coleman_liau": "0.0588 * (length(array_to_string(w, '')) / n * 100) - 0.296 * (s / n * 100) - 15.8",
    "ari": "4.71 * (length(array_to_string(w, '')) / n) + 0.5 * (n / s) - 21.43",
    "diversity": "len(list_distinct(list_transform(w, lambda x: lower(x)))) / n",
}


def _readable(name: str) -> str:
    return f"with {_WORDS} select doc_id, case when n = 0 then 0.0::double else ({_READABLE[name]})::double end as out from y"


def _complexity() -> str:
    each = ", ".join(f"case when n = 0 then 0.0::double else ({_READABLE[k]})::double end as {v}" for k, v in (("flesch_reading_ease", "f"), ("coleman_liau", "c"), ("ari", "a"), ("diversity", "d")))
    clamp = "greatest(0.0, least(100.0, {}))".format
    score = f"0.4 * {clamp('100.0 - f')} + 0.2 * {clamp('c * 5.0')} + 0.2 * {clamp('a * 5.0')} + 0.2 * (d * 100.0)"
    half_up = "round(({})::double::varchar::decimal(38, 20), {})::double".format
    return f"with {_WORDS}, v as (select doc_id, n, {each} from y) select doc_id, {half_up('f', 2)} as flesch, {half_up('c', 2)} as coleman_liau, {half_up('a', 2)} as ari, {half_up('d', 4)} as lexical_diversity, case when n = 0 then 0.0::double else {half_up(score, 2)} end as complexity_score from v"


_GIBBERISH = r"""
with a as (select doc_id, string_split(lower(regexp_replace(text, '[^\p{L}]', '', 'g')), '') as c from documents),
b as (select doc_id, c, len(list_filter(c, lambda x: x <> ''))::double as n from a),
p as (select doc_id, n, len(list_filter(c, lambda x: contains('aeiou', x))) / n as v,
  len(list_filter(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), lambda x: x in (PAIRS))) / (n - 1) as k, len(list_distinct(c)) / n as d from b where n >= 3),
s as (select doc_id, ((case when v between 0.2 and 0.6 then 0 else 1 end) + (1 - k) + (case when d > 0.8 then d else 0 end)) / 3.0 > 0.35 as out from p)
select b.doc_id, coalesce(s.out, true) as out from b left join s using (doc_id)"""

_PAIRS = "al an ar as at co de ea ed en er es ha he hi ic in io is it le me nd ne ng nt of on or ou re ri ro se st te th ti to ve"
_HOLDERS = "n/a na tba tbd fixme todo testing test xxx abc aaa asdf baz bar foo example sample dummy placeholder tmp temp null none undefined pending"

TEXT: dict[str, str] = {
    "text_normalize_text": _normalized("text"),
    "text_normalize_text_aggressive": _normalized("text", True),
    "text_mixed_case": r"""select doc_id, (len(list_filter(list_transform(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: regexp_replace(x, '[^\p{L}]', '', 'g')), lambda x: length(x) >= 2
      and x <> upper(x) and x <> lower(x) and x <> upper(x[1]) || lower(x[2:])
      and not (regexp_matches(x, '^\p{Ll}') and length(regexp_replace(x, '[^\p{Lu}]', '', 'g')) < length(x) / 2))) > 0)::varchar as out from documents""",
    "text_language_normalize_es": _language_normalized("es"),
    "text_language_normalize_de": _language_normalized("de"),
    "text_remove_articles_en": _without_small_words("en"),
    "text_remove_articles_fr": _without_small_words("fr"),
    "text_reduce_letters_es": _reduced("es", 3),
    "text_reduce_letters_de": _reduced("de", 2),
    "value_flesch_reading_ease": _readable("flesch_reading_ease"),
    "value_flesch_kincaid": _readable("flesch_kincaid"),
    "value_gunning_fog": _readable("gunning_fog"),
    "text_complexity": _complexity(),
    "value_gibberish": _GIBBERISH.replace("PAIRS", ", ".join(f"'{p}'" for p in _PAIRS.split())),
    "value_placeholder": r"""with t as (select doc_id, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') as t from documents)
      select doc_id, t = '' or t in (HOLDERS) or starts_with(t, 'lorem ipsum') or length(replace(replace(t, ' ', ''), replace(t, ' ', '')[1], '')) = 0 as out from t""".replace("HOLDERS", ", ".join(f"'{p}'" for p in _HOLDERS.split())),
    "value_data_type": r"""with t as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents)
      select doc_id, case when t = '' then 'empty' when lower(t) in ('true', 'false', 'yes', 'no', '1', '0') then 'boolean' when regexp_full_match(t, '[+-]?\d+(_\d+)*') then 'integer'
        when try_cast(t as double) is not null then 'float' when regexp_full_match(t, '\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d-\d\d-\d{4}|\d{4}/\d\d/\d\d') then 'date'
        when regexp_full_match(t, '[^@\s]+@[^@\s]+\.[^@\s]+') then 'email' when regexp_full_match(t, '(?i)https?://\S+') then 'url' else 'string' end as out from t""",
    # documents are whole UTF-8, so nothing is to be mended; read as Latin-1, every letter beyond ASCII is
    "text_fix_encoding": "select doc_id, text as out from documents",
    "encoding_detect": r"select doc_id, regexp_matches(text, '[^\x00-\x7F]') as bad, true as mended from documents",
    "extract_postal_codes": rf"select doc_id, (case when len(f) > 0 then len(f) else len(g) end)::bigint as n from (select doc_id, regexp_extract_all(t, '\b\d{{5}}\b') as f, regexp_extract_all(t, '\b\d{{4}}\b') as g from (select doc_id, {flat('text')} as t from documents))",
}


def extracted(kind: str) -> str:
    """Hits of a pattern in documents; none of the patterns takes letters beyond ASCII into a hit, but
    for brackets, quotations and words after a sign, whose letters are put back."""
    p = extract.PATTERNS[kind].replace("'", "''")
    return f"select doc_id, len(h)::bigint as n, {plain('array_to_string(h, chr(124))')} as hits from (select doc_id, regexp_extract_all({bordered('text')}, '{p}') as h from documents) where len(h) > 0"


# --- pairs of part names

_PAIRS_OF_PARTS = "(select p.p_partkey, p.p_name as a, q.p_name as b from part p join part q on q.p_partkey = p.p_partkey + 1)"
_KINDS = f"k as (select distinct a, b from {_PAIRS_OF_PARTS})"


def _by_pair(ctes: str, cols: str, recursive: bool = False) -> str:
    """Pairs of parts with what ctes (the last named `r`, by a and b) say of their names."""
    return f"with {'recursive ' * recursive}{_KINDS}, {ctes} select p.p_partkey, {cols} from {_PAIRS_OF_PARTS} p join r using (a, b)"


#: Jaro: i takes the first free equal place of b within reach. taken: places of b, in order of a.
def jaro(x: str = "a", y: str = "b", source: str = "k", out: str = "r", name: str = "jw") -> str:
    reach = "greatest(greatest(length(x), length(y)) // 2 - 1, 0)"
    took = f"list_reduce(list_transform(range(1, length(x) + 1), lambda i: [i]), lambda t, e: list_concat(t, coalesce([list_filter(range(greatest(1, e[1] - {reach}), least(length(y), e[1] + {reach}) + 1), lambda j: y[j] = x[e[1]] and not list_contains(t, j))[1]], [])), []::bigint[])"
    return f"""{out}0 as (select a, b, {x} as x, {y} as y from {source}),
      {out}1 as (select *, list_filter({took}, lambda j: j is not null) as t from {out}0),
      {out}2 as (select *, len(t)::double as m, list_filter(range(1, length(x) + 1), lambda i: true) as ii from {out}1),
      {out}3 as (select *, list_reduce(list_transform(range(1, length(x) + 1), lambda i: [i]), lambda t2, e: case when len(t2) < len(t) and x[e[1]] = y[t[len(t2) + 1]] then list_append(t2, e[1]) else t2 end, []::bigint[]) as mine from {out}2),
      {out}4 as (select *, len(list_filter(range(1, len(t) + 1), lambda i: y[t[i]] <> y[list_sort(t)[i]])) as swapped from {out}3),
      {out}5 as (select *, case when x = y then 1.0 when m = 0 then 0.0 else (m / length(x) + m / length(y) + (m - swapped / 2) / m) / 3.0 end as j,
        coalesce(list_min(list_filter(range(0, 4), lambda i: x[i + 1] <> y[i + 1] or x[i + 1] = '' or y[i + 1] = '')), 4) as pre from {out}4),
      {out} as (select a, b, (case when x = y then 1.0 else j + pre * 0.1 * (1.0 - j) end)::double as {name} from {out}5)"""


#: Twice the characters in matching blocks: the longest, then left and right of it.
_BLOCKS = """
  e as (
    select a, b, 0 as al, length(a) as ah, 0 as bl, length(b) as bh, null::bigint as size from k
    union all
    select a, b, s.al, s.ah, s.bl, s.bh, s.size from (
      select a, b, unnest([{'al': al, 'ah': best[2], 'bl': bl, 'bh': best[3], 'size': best[1]}, {'al': best[2] + best[1], 'ah': ah, 'bl': best[3] + best[1], 'bh': bh, 'size': null}]) as s from (
        select *, list_reduce(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j:
          [len(list_filter(range(1, least(ah - i, bh - j) + 1), lambda n: substr(a, (i + 1)::bigint, n) = substr(b, (j + 1)::bigint, n))), i, j]))), lambda p, q: case when q[1] > p[1] then q else p end) as best
        from e where ah > al and bh > bl)
      where best[1] > 0)
  )"""

#: Longest common subsequence, row by row of the table.
_LCS = """list_reduce(list_transform(range(1, length({0}) + 1), lambda i: [i]), lambda row, e: list_reduce(list_transform(range(1, length({1}) + 1), lambda j: [j]),
  lambda n, f: list_append(n, case when {0}[e[1]] = {1}[f[1]] then row[f[1]] + 1 else greatest(row[f[1] + 1], n[f[1]]) end), [0::bigint]), list_transform(range(0, length({1}) + 1), lambda z: 0::bigint))[-1]"""


def mra(x: str) -> str:
    """Match rating: vowels but for the first character go, of equal neighbours one stays, of more than
    six characters the first and the last three."""
    code = f"(upper({x})[1] || translate(upper({x})[2:], 'AEIOU', ''))"
    for ch in " BCDFGHJKLMNPQRSTVWXYZ":
        code = f"regexp_replace({code}, '{ch}{ch}+', '{ch}', 'g')"
    return f"list_transform([{code}], lambda v: case when length(v) > 6 then v[:3] || right(v, 3) else v end)[1]"


_LEV = "(case when a = b then 1.0 else 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) end)::double"
_BG = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_DICE = f"(case when a = b then 1.0 else 2.0 * len(list_intersect({_BG.format('a')}, {_BG.format('b')})) / (len({_BG.format('a')}) + len({_BG.format('b')})) end)::double"
_TOKENS = "string_split({}, ' ')"
_SAME_TOKENS = f"len(list_intersect(list_distinct({_TOKENS.format('a')}), list_distinct({_TOKENS.format('b')})))"

PARTS: dict[str, str] = {
    "similarity_jaro_winkler": _by_pair(jaro(), "jw as score"),
    "similarity_ratcliff_obershelp": _by_pair(_BLOCKS + ", r as (select a, b, 2.0::double * coalesce(sum(size), 0)::bigint / (length(a) + length(b)) as score from e group by a, b)", "score", True),
    "compare_text_detailed": _by_pair(
        _BLOCKS + """, u as (select a, b, al + 0 as i, bl + 0 as j, size from e where size is not null),
      o as (select a, b, ah as i, bh as j, size from e where size is not null),
      g as (select *, lag(i + size, 1, 0) over w as pi, lag(j + size, 1, 0) over w as pj from o window w as (partition by a, b order by i)),
      c as (select a, b, sum(size)::bigint as m, sum(case when i = pi and j = pj and pi + pj > 0 then 0 when i > pi or j > pj then 2 else 1 end)::bigint as n, max(i + size) as li, max(j + size) as lj from g group by a, b),
      r as (select k.a, k.b, 2.0::double * coalesce(m, 0) / (length(k.a) + length(k.b)) as ratio, (coalesce(n, 0) + case when coalesce(li, 0) < length(k.a) or coalesce(lj, 0) < length(k.b) then 1 else 0 end)::int as n_opcodes from k left join c using (a, b))""",
        "ratio, n_opcodes", True,
    ),
    "similarity_lcs": _by_pair(f"r as (select a, b, ({_LCS.format('a', 'b')} / greatest(length(a), length(b)))::double as score from k)", "score"),
    "find_common_patterns": _by_pair(
        f"l as (select a, b, {_LCS.format('a', 'b')}::int as n from k), r as (select *, (n / ((length(a) + length(b)) / 2.0))::double as ratio, (n / greatest(length(a), length(b)))::double as sim from l)",
        "n as lcs_length, ratio as lcs_ratio, sim as similarity, sim * 100.0 as score, n >= 3 and ratio >= 0.3 as has_significant_overlap",
    ),
    "similarity_percentage": _by_pair(
        """s as (select a, b, case when length(a) > length(b) then b else a end as x, case when length(a) > length(b) then a else b end as y from k),
      d as (select *, len(list_filter(range(1, length(y) + 1), lambda i: i > length(x) or x[i] <> y[i])) as dots, length(replace(y, ' ', '')) as solid from s),
      r as (select a, b, (case when a = b then 100.0 when contains(y, x) then length(x) / length(y) * 100.0 else (solid - dots) / solid * 100.0 end)::double as score from d)""",
        "score",
    ),
    "compare_tokens": f"select p_partkey, case when a = b then true when len({_TOKENS.format('a')}) = len({_TOKENS.format('b')}) then {_SAME_TOKENS} = len({_TOKENS.format('a')}) else false end as same from {_PAIRS_OF_PARTS}",
    "compare_phrases": f"""select p_partkey, {_DICE} >= 0.8 as is_match, {_DICE} as similarity, 1.0 - {_DICE} as distance, {_DICE} * 100.0 as score,
      list_sort(list_filter(list_distinct({_TOKENS.format('a')}), lambda w: list_contains({_TOKENS.format('b')}, w))) as common_words,
      list_sort(list_filter(list_distinct({_TOKENS.format('a')}), lambda w: not list_contains({_TOKENS.format('b')}, w))) as unique_to_phrase1,
      list_sort(list_filter(list_distinct({_TOKENS.format('b')}), lambda w: not list_contains({_TOKENS.format('a')}, w))) as unique_to_phrase2 from {_PAIRS_OF_PARTS}""",
    "similarity_mra": _by_pair(f"c as (select a, b, {mra('a')} as x, {mra('b')} as y from k), {jaro('x', 'y', 'c', 'q')}, r as (select a, b, (case when abs(length(x) - length(y)) <= 2 then jw else 0.0 end)::double as score from c join q using (a, b))", "score"),
    "are_equivalent": _by_pair(
        f"c as (select a, b, {mra('a')} as x, {mra('b')} as y from k), {jaro('x', 'y', 'c', 'q', 'code')}, {jaro('a', 'b', 'k', 'v')},"
        f" m as (select a, b, (case when abs(length(x) - length(y)) <= 2 then code else 0.0 end)::double as s, jw from c join q using (a, b) join v using (a, b)), r as (select *, {_LEV} as lev from m)",
        "s >= 0.8 or (lev >= 0.85 and jw >= 0.9) as is_match, lev as levenshtein_ratio, jw as jaro_winkler_score, s >= 0.8 as phonetic_match, s as mra_similarity",
    ),
}

def _title_words(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


PARTS |= {
    # part names have neither nicknames nor words of three letters at most as a whole
    "compare_names": _by_pair(
        f"k2 as (select a, b, {_title_words('a')} as x, {_title_words('b')} as y from k), {jaro('x', 'y', 'k2', 'v')},"
        " m as (select a, b, jw, (case when x = y then 1.0 else 1.0 - levenshtein(x, y) / greatest(length(x), length(y)) end)::double as lev from k2 join v using (a, b)),"
        " r as (select *, case when a = b then 'exact' when lev >= 0.85 or jw >= 0.9 then 'similar' else 'none' end as how from m)",
        "how <> 'none' as is_match, how, (case when how = 'exact' then 1.0 else lev end)::double as levenshtein_ratio, (case when how = 'exact' then 1.0 else jw end)::double as jaro_winkler_score",
    ),
    # names of two words: only equal words at equal places face each other, so both must be equal
    "compare_name_bytokens": f"""select p_partkey, a = b as is_match, case when a = b then 0 end::int as rule,
      ((split_part(a, ' ', 1) = split_part(b, ' ', 1))::int + (split_part(a, ' ', 2) = split_part(b, ' ', 2))::int)::int as coincidences from {_PAIRS_OF_PARTS}""",
    "phonetic_duplicates": f"""with recursive n as (select distinct p_name, {mra("p_name")} as code from part), k as (select distinct x.code as a, y.code as b from n x, n y where x.code < y.code),
      {jaro()}, g as (select a, b from r where jw >= 0.9 and abs(length(a) - length(b)) <= 2), w as (select a, b from g union select b, a from g union select code, code from n),
      c as (select a, b from w union select c.a, w.b from c join w on c.b = w.a), root as (select a as code, min(b) as root from c group by a),
      m as (select p_partkey, root from part join n using (p_name) join root using (code)), z as (select root, min(p_partkey) as grp, count(*) as n from m group by root)
      select p_partkey as id, grp as "group" from m join z using (root) where z.n > 1""",
    "find_best_match": """with s as (select s_suppkey, c_custkey, 1.0::double - levenshtein(lower(s_name), lower(c_name)) / greatest(length(s_name), length(c_name)) as score from supplier, customer),
      b as (select *, row_number() over (partition by s_suppkey order by score desc, c_custkey) as r from s where score >= 0.7)
      select s.s_suppkey as target_id, b.c_custkey as candidate_id, coalesce(b.score, 0.0)::double as score from supplier s left join b on b.s_suppkey = s.s_suppkey and b.r = 1""",
    "compare_lists": """with s as (select x.n_nationkey as target_id, y.n_nationkey as candidate_id, case when x.n_name = y.n_name then 1.0 else 1.0 - levenshtein(lower(x.n_name), lower(y.n_name)) / greatest(length(x.n_name), length(y.n_name)) end::double as score, x.n_name = y.n_name as raw from nation x, nation y)
      select * exclude (raw) from (select *, (row_number() over (partition by target_id order by score desc, raw desc, candidate_id))::int as rank from s where score >= 0.4) where rank <= 3""",
}
#: Companies made of supplier names: the form is told by the key, the name keeps its own letters.
TEXT |= {
    "company_parse": r"""select s_suppkey, upper(regexp_replace(s_name, '[^A-Za-z0-9]', ' ')) as name, case s_suppkey % 3 when 0 then 'SL' when 1 then 'SA' end as form,
      upper(regexp_replace(s_name, '[^A-Za-z0-9]', ' ')) || case s_suppkey % 3 when 0 then ' S.L.' when 1 then ' S.A.' else '' end as shown from supplier""",
}

# --- personal data


def _entities(locale: str) -> str:
    """CTEs up to kept(doc_id, lang, text, kept): entities {s, e, kind, conf} in order of their places."""
    rules = Anonymizer(locale)._rules()
    each = " union all ".join(
        f"select doc_id, '{kind}' as kind, {conf}::double as conf, {k} as prio, regexp_extract_all(t, '{p}') as h, regexp_split_to_array(t, '{p}') as g from m" for k, (kind, p, conf) in enumerate((a, b.replace("'", "''"), c) for a, b, c in rules)
    )
    upto = "coalesce(list_sum(list_transform({0}[1:{1}], lambda x: length(x))), 0)::bigint"
    return f"""m as (select doc_id, {flat("text")} as t from documents), h as ({each}),
  p as (select doc_id, kind, conf, prio, i, {upto.format("g", "i")} + {upto.format("h", "i - 1")} as s, length(h[i]) as n from (select *, unnest(range(1, len(h) + 1)) as i from h where len(h) > 0)),
  o as (select doc_id, list({{'s': s, 'e': s + n, 'kind': kind, 'conf': conf}} order by conf desc, prio, i) as es from p group by doc_id),
  chosen as (select doc_id, list_reduce(list_transform(es, lambda x: [x]), lambda a, x: case when len(list_filter(a, lambda q: x[1].s < q.e and q.s < x[1].e)) > 0 then a else list_concat(a, x) end) as es from o),
  kept as (select d.doc_id, d.lang, d.text, coalesce(list_sort(c.es), []) as es from documents d left join chosen c using (doc_id))"""


_DIGITS = r"regexp_replace(v, '[^0-9]', '', 'g')"
_STARRED = "array_to_string(list_transform(string_split(trim(regexp_replace(v, '\\s+', ' ', 'g')), ' '), lambda w: case when length(w) > 1 then w[1] || repeat('*', length(w) - 1) else '*' end), ' ')"
#: What stands for the text v of a kind.
REPLACED: dict[str, str] = {
    "redact": "'[' || kind || ']'",
    "suppress": "''",
    "hash": "substr(sha256(v), 1, 12)",
    "mask": f"""case when kind = 'EMAIL' and len(string_split(v, '@')) = 2 then case when split_part(v, '@', 1) = '' then '***' else v[1] || repeat('*', length(split_part(v, '@', 1)) - 1) end || '@' || repeat('*', length(split_part(split_part(v, '@', 2), '.', 1))) || '.***'
      when kind in ('PHONE', 'CREDIT_CARD') and length({_DIGITS}) > 4 then repeat('*', length({_DIGITS}) - 4) || right({_DIGITS}, 4) when kind in ('EMAIL', 'PHONE', 'CREDIT_CARD') then repeat('*', length(v))
      when kind = 'NAME' then {_STARRED} when length(v) > 2 then v[1] || repeat('*', length(v) - 2) || right(v, 1) else repeat('*', length(v)) end""",
    "generalize": r"""case when kind = 'DATE' then coalesce(nullif(regexp_extract(v, '\b((?:19|20)\d{2})\b', 1), ''), nullif(regexp_extract(v, '\d{1,2}[/.-]\d{1,2}[/.-](\d{2,4})', 1), ''), v)
      when kind in ('ADDRESS', 'LOCATION') then trim(split_part(v, ',', 1)) when kind = 'EMAIL' then '***@' || array_to_string(string_split(split_part(v, '@', 2), '.')[-2:], '.')
      when length(v) > 4 then v[1:2] || '...' || right(v, 2) else '***' end""",
}


def _rewritten(strategy: str) -> str:
    return f"""with {_entities("es_ES")},
  x as (select doc_id, unnest(range(1, len(es) + 1)) as i, es, text from kept),
  y as (select doc_id, i, es[i].kind as kind, substr(text, es[i].s + 1, es[i].e - es[i].s) as v, substr(text, coalesce(es[i - 1].e, 0) + 1, es[i].s - coalesce(es[i - 1].e, 0)) as before from x),
  z as (select doc_id, string_agg(before || ({REPLACED[strategy]}), '' order by i) as head from y group by doc_id)
select k.doc_id, coalesce(z.head, '') || substr(k.text, coalesce(k.es[-1].e, 0) + 1) as anonymized, len(k.es)::int as n_entities from kept k left join z using (doc_id)"""


PII: dict[str, str] = {
    "pii_entities": f"with {_entities('es_ES')}, x as (select doc_id, text, unnest(es) as e from kept) select doc_id, substr(text, e.s + 1, e.e - e.s) as text, e.kind as pii_type, e.s::int as start, e.e::int as end, e.conf as confidence, 'regex' as source from x",
    "pii_summary": f"with {_entities('en_US')}, x as (select lang, unnest(es) as e from kept) select lang, e.kind as pii_type, count(*)::bigint as n_entities from x group by 1, 2",
    **{f"anonymize_{name}": _rewritten(name) for name in REPLACED},
}


def all_sql() -> dict[str, str]:
    found = TEXT | PARTS | PII
    return found | {f"extract_{k}": extracted(k) for k in extract.PATTERNS if k != "passwords"}
