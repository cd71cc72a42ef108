"""All queries of the library's own operators, and their SQL. Every query reads whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import encoding, extract, ids, language, names, normalize, ops, phonetic, readability, reduction, similarity, validate

from ..operators import generate, matching, privacy

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return put


_L = r"\p{L}\p{N}_"
_SP = "a-zA-ZñÑáéíóúüÁÉÍÓÚÜçÇ"
_DUCK_FLAT = "replace(replace(replace(replace(replace(replace(translate(text, '{a}', '{b}'), 'ß', 'ss'), 'ẞ', 'SS'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE')".format(a="".join(ops._PLAIN_FOR), b="".join(ops._PLAIN_FOR.values()))


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


#: documents.text -> a string, as a column and as SQL
_TEXT: dict[str, tuple[Callable, str | None]] = {
    "flat_vowels": (ops.flat_vowels, _DUCK_FLAT),
    "normalize_spaces": (ops.normalize_spaces, _squeeze("text")),
    "erase_allspaces": (ops.erase_allspaces, r"regexp_replace(text, '\s+', '', 'g')"),
    "normalize_symbols": (ops.normalize_symbols, "translate(text, '´`‘’‡†Ž«»“”—–§¥', '''''''''''''''\"\"\"\"--ºÑ')"),
    "erase_specialchar": (ops.erase_specialchar, f"regexp_replace(text, '[^0-9 {_SP}]', '', 'g')"),
    "fix_spanish": (ops.fix_spanish, f"regexp_replace(translate(text, '—–', '--'), '[^0-9 {_SP}]', '', 'g')"),
    "string_aZ": (ops.string_aZ, _squeeze(rf"regexp_replace(text, '[^{_SP}\s]', ' ', 'g')")),
    "string_aZ09": (ops.string_aZ09, _squeeze(rf"regexp_replace(text, '[^0-9{_SP}\s]', ' ', 'g')")),
    "strip_accents": (normalize.strip_accents, "strip_accents(text)"),
    "remove_punctuation_marks": (normalize.remove_punctuation_marks, "translate(text, '.,;:!?¡¿', '')"),
    "remove_special_characters": (normalize.remove_special_characters, _squeeze(r"regexp_replace(text, '[^a-zA-Z0-9\s]', ' ', 'g')")),
    "remove_parentheses": (normalize.remove_parentheses_and_content, _squeeze(r"regexp_replace(regexp_replace(regexp_replace(text, '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g'), '\{[^}]*\}', '', 'g')")),
    "strip_quotes": (normalize.strip_quotes, "replace(translate(text, '\"''', ''), ', ', '')"),
    "mask_text": (normalize.mask_text, "case when length(text) <= 2 then text else substr(text, 1, 1) || repeat('*', length(text) - 2) || right(text, 1) end"),
    "normalize_text": (normalize.normalize_text, None),
    "normalize_text_aggressive": (lambda c: normalize.prepare_for_comparison(c, True), None),
    "mixed_case": (lambda c: validate.has_mixed_case_anomaly(c).cast("string"), None),
    "language_normalize_es": (lambda c: language.LanguageNormalizer("es").normalize(c), None),
    "language_normalize_de": (lambda c: language.LanguageNormalizer("de").normalize(c), None),
    "remove_articles_en": (lambda c: reduction.remove_articles(c, "en"), None),
    "remove_articles_fr": (lambda c: reduction.remove_articles(c, "fr"), None),
    "reduce_letters_es": (lambda c: reduction.reduce_letters(c, "es", 3), None),
    "reduce_letters_de": (lambda c: reduction.reduce_letters(c, "de", 2), None),
    "fix_encoding": (encoding.fix_encoding, None),
    "fix_language_es": (lambda c: encoding.fix_language(c, "es"), None),
    "get_string_between": (lambda c: extract.get_string_between(c, '"'), """case when length(text) - length(replace(text, '"', '')) >= 2 then string_split(text, '"')[2] else '' end"""),
    "reorder_comma_fullname": (ops.reorder_comma_fullname, r"case when contains(text, ',') then regexp_replace(regexp_replace(substr(text, instr(text, ',') + 1), '^\s+|\s+$', '', 'g') || ' ' || regexp_replace(substr(text, 1, instr(text, ',') - 1), '^\s+|\s+$', '', 'g'), '^\s+|\s+$', '', 'g') end"),
}


def _text_query(fn: Callable) -> Query:
    return lambda spark, d: _t(spark, d, "documents").select("doc_id", fn(F.col("text")).alias("out"))


for _name, (_fn, _sql) in _TEXT.items():
    query(f"text_{_name}", _sql and f"select doc_id, {_sql} as out from documents")(_text_query(_fn))

#: documents.text -> number or flag
_VALUE: dict[str, tuple[Callable, str | None]] = {
    "contains_repeated_words": (validate.contains_repeated_words, r"with w as (select doc_id, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') as w from documents) select doc_id, coalesce(list_bool_or(list_transform(range(1, len(w)), lambda i: w[i] = w[i + 1] and w[i] <> '')), false) as out from w"),
    "homoglyph_risk": (validate.homoglyph_risk_score, rf"select doc_id, case when length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) > 0 then (length(text) - length(translate(text, '{validate.CONFUSABLES}', ''))) / length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) else 0.0 end as out from documents"),
    "text_density": (readability.text_density_score, r"select doc_id, round(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / length(text), 4) as out from documents"),
    "placeholder": (readability.is_placeholder_text, None),
    "gibberish": (readability.is_gibberish, None),
    "data_type": (validate.data_type_inference, None),
    "sentences": (lambda c: readability.count_sentences(c).cast("bigint"), r"select doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))))::bigint as out from documents"),
    "coleman_liau": (readability.coleman_liau_index, r"with w as (select doc_id, regexp_extract_all(text, '[a-zA-Z]+') as w, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))))::double as s from documents) select doc_id, case when len(w) = 0 then 0.0::double else 0.0588::double * (length(list_aggregate(w, 'string_agg', ''))::double / len(w)::double * 100) - 0.296::double * (s / len(w)::double * 100) - 15.8::double end as out from w"),
    "automated_readability": (readability.automated_readability_index, r"with w as (select doc_id, regexp_extract_all(text, '[a-zA-Z]+') as w, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))))::double as s from documents) select doc_id, case when len(w) = 0 then 0.0::double else 4.71::double * (length(list_aggregate(w, 'string_agg', ''))::double / len(w)::double) + 0.5::double * (len(w)::double / s) - 21.43::double end as out from w"),
    "flesch_reading_ease": (readability.flesch_reading_ease, None),
    "flesch_kincaid": (readability.flesch_kincaid_grade, None),
    "gunning_fog": (readability.gunning_fog_index, None),
}
for _name, (_fn, _sql) in _VALUE.items():
    query(f"value_{_name}", _sql)(_text_query(_fn))


@query("text_complexity")
def text_complexity(spark, d):
    return _t(spark, d, "documents").select("doc_id", readability.text_complexity_score("text").alias("s")).select("doc_id", "s.*")


#: extraction from documents and from derived texts; arrays are joined to compare them
_RE2 = {k: v for k, v in extract.PATTERNS.items() if k not in ("quotations", "passwords", "from_parentheses")}
_DERIVED = (
    "concat('On ', strftime(o_orderdate, '%d/%m/%Y'), ' at ', strftime(o_orderdate, '%H:%M'), ' paid x$', cast(cast(floor(o_totalprice) as bigint) as varchar), ' and 12%a of #tag', o_custkey, ' [ref ', o_orderkey, '] by NIF ', lpad(cast(o_custkey as varchar), 8, '0'), 'T or SSN 123-45-', lpad(cast(o_orderkey % 10000 as varchar), 4, '0'), '; CVE-2021-', 1000 + o_orderkey % 9000, ' v1.', o_orderkey % 7, '.2 ES76', lpad(cast(o_orderkey as varchar), 20, '0'), ' ABCDESMM http://x.example.com/', o_orderkey, ' EP', o_orderkey, 'B1 9780', lpad(cast(o_orderkey as varchar), 9, '0'), ' PAT-', o_custkey, ' tel +34 6', lpad(cast(o_custkey as varchar), 8, '0'),"
    " ' (note ', o_orderkey, ') @user', o_custkey, ' card 4111 1111 1111 ', 1000 + o_orderkey % 9000, ' ip 10.', o_custkey % 256, '.', o_orderkey % 256, '.7 mail who', o_custkey, '@mail.example.org said \"so it is\" sum ', md5(cast(o_orderkey as varchar)))"
)
_DERIVED_SPARK = _DERIVED.replace("strftime(o_orderdate, '%d/%m/%Y')", "date_format(o_orderdate, 'dd/MM/yyyy')").replace("strftime(o_orderdate, '%H:%M')", "date_format(o_orderdate, 'HH:mm')").replace("varchar", "string")


def _derived(spark, d) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", F.expr(_DERIVED_SPARK).alias("text"))


def _extract_query(kind: str, derived: bool) -> Query:
    def run(spark, d):
        src, key = (_derived(spark, d), "o_orderkey") if derived else (_t(spark, d, "documents"), "doc_id")
        # a generator, so that texts are searched once: a condition on n would search them again
        found = F.filter(F.array(extract.extract("text", kind)), lambda h: F.size(h) > 0)
        return src.select(key, F.inline(F.transform(found, lambda h: F.struct(F.size(h).cast("bigint").alias("n"), F.concat_ws("|", h).alias("hits")))))

    return run


for _kind in extract.PATTERNS:
    for _derived_ in (False, True):
        _key, _from = ("o_orderkey", f"(select o_orderkey, {_DERIVED} as text from orders)") if _derived_ else ("doc_id", "documents")
        _pattern = extract.PATTERNS[_kind].replace("'", "''")
        # ASCII word borders of RE2 are the same where letters next to a hit are ASCII: the derived texts
        _ok = _derived_ and _kind != "passwords"
        query(f"extract_{_kind}" + ("_derived" if _derived_ else ""), f"select {_key}, len(h)::bigint as n, array_to_string(h, '|') as hits from (select {_key}, regexp_extract_all(text, '{_pattern}') as h from {_from}) where len(h) > 0" if _ok else None)(_extract_query(_kind, _derived_))


@query("extract_phones_derived", r"select o_orderkey, array_to_string(list_filter(list_transform(regexp_extract_all(text, '\+?\d[-\s().\d\v]*\d'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) >= 5), '|') as hits from (select o_orderkey, " + _DERIVED + " as text from orders)")
def extract_phones_derived(spark, d):
    return _derived(spark, d).select("o_orderkey", F.concat_ws("|", extract.phones("text")).alias("hits"))


@query("extract_postal_codes")
def extract_postal_codes(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(extract.postal_codes("text")).cast("bigint").alias("n"))


@query("extract_paragraphs", r"select doc_id, len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''))::bigint as n from documents where regexp_matches(text, '\S')")
def extract_paragraphs(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(extract.paragraphs("text")).cast("bigint").alias("n")).where("n > 0")


@query("tokenize", r"select doc_id, count(*)::bigint as n from (select doc_id, unnest(regexp_split_to_array(text, '[-\s().,/;:!?@#$%^&*+=]')) as w from documents) where w <> '' group by doc_id")
def tokenize(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(extract.tokenize("text")).cast("bigint").alias("n")).where("n > 0")


@query("detect_language", "with w as (select doc_id, lang, list_distinct(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) as w from documents), s as (select doc_id, lang, " + ", ".join(f"len(list_intersect(w, [{', '.join(chr(39) + x + chr(39) for x in v)}])) as {k}" for k, v in language.STOP_WORDS.items()) + " from w) select doc_id, lang, case when greatest(en, es, fr, de, it, pt) = 0 then 'unknown' " + " ".join(f"when {k} = greatest(en, es, fr, de, it, pt) then '{k}'" for k in language.STOP_WORDS) + " end as detected from s")
def detect_language(spark, d):
    return _t(spark, d, "documents").select("doc_id", "lang", language.detect_language("text").alias("detected"))


@query("language_confusion", "select lang, detected, count(*)::bigint as n from (" + _SQL["detect_language"] + ") group by lang, detected")
def language_confusion(spark, d):
    return detect_language(spark, d).groupBy("lang", "detected").agg(F.count("*").alias("n"))


# --- identifiers made from keys by arithmetic that both dialects have; what is right follows in SQL

_KEY = "o_orderkey"


def _num(n: int, by: int) -> str:
    """n digits that look random."""
    return f"lpad(cast(cast(o_orderkey as bigint) * {by} % {10**n} as varchar({n})), {n}, '0')"


def _one(chars: str, by: int) -> str:
    """One of some characters."""
    return f"substr('{chars}', cast(cast(o_orderkey as bigint) * {by} % {len(chars)} as int) + 1, 1)"


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _weighed(weights: list[int], s: str = "s") -> str:
    return "(" + " + ".join(f"{w} * {s}[{k}]::int" for k, w in enumerate(weights, 1) if w) + ")"


def _luhn(n: int) -> str:
    return "(" + " + ".join(f"s[{k}]::int" if (n - k) % 2 == 0 else f"(2 * s[{k}]::int) // 10 + (2 * s[{k}]::int) % 10" for k in range(1, n + 1)) + ") % 10 = 0"


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NIF = "TRWAGMYFPDXBNJZSQVHLCKE"
_REST = "({0} * 10 % 11 % 10)".format
_BELOW = "case when {0} % 11 < 2 then 0 else 11 - {0} % 11 end".format
#: The odd places of an Italian code.
_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
_ITALIAN = " + ".join(
    (f"[{', '.join(map(str, _ODD))}][{{0}} + 1]" if k % 2 else "{0}").format(f"(case when s[{k}] between '0' and '9' then s[{k}]::int else ascii(s[{k}]) - 65 end)") for k in range(1, 16)
)

#: kind -> (what is checked, the check, SQL of what is valid)
_CHECKS: dict[str, tuple[str, Callable, str]] = {
    "luhn": (_num(13, 982451653), validate.is_valid_luhn, _luhn(13)),
    "credit_card": (_cat("'4'", _num(15, 32416190071)), lambda c: validate.is_valid_credit_card(c)["valid"], _luhn(16)),
    "iban": (_cat("'ES'", _num(2, 7), _num(10, 982451653), _num(10, 32416190071)), validate.is_valid_iban, "(s[5:] || '1428' || s[3:4])::hugeint % 97 = 1"),
    "ean": (_num(13, 982451653), validate.is_valid_ean, _weighed([1, 3] * 6 + [1]) + " % 10 = 0"),
    "isbn10": (_cat(_num(9, 982451653), _one("0123456789X", 13)), validate.is_valid_isbn, "(" + _weighed(list(range(10, 1, -1))) + " + case when s[10] = 'X' then 10 else s[10]::int end) % 11 = 0"),
    "isbn13": (_cat("'978'", _num(10, 982451653)), validate.is_valid_isbn, _weighed([1, 3] * 6 + [1]) + " % 10 = 0"),
    "dni": (_cat(_num(8, 982451653), _one(_NIF, 13)), ids.is_valid_dni, f"s not in ('99999999R', '00000001R', '00000000T') and substr('{_NIF}', (s[1:8]::int % 23) + 1, 1) = s[9]"),
    "nie": (_cat(_one("XYZ", 7), _num(7, 982451653), _one(_NIF, 13)), ids.is_valid_nie, f"substr('{_NIF}', ((instr('XYZ', s[1]) - 1 || s[2:8])::int % 23) + 1, 1) = s[9]"),
    "cif": (_cat(_one("ABCDEFGHJNPQRSUVW", 7), _num(7, 982451653), _one("0123456789ABCDEFGHIJ", 13)), ids.is_valid_cif, f"case when s[1] in ('A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', 'J') then s[9] = ({_weighed([1] * 7, 's[2:8]')} % 10)::varchar else s[9] = substr('{_AZ}', {_weighed([1] * 7, 's[2:8]')} % 10 + 1, 1) end"),
    "cpf": (_num(11, 982451653), ids.is_valid_cpf, f"s[10]::int = {_REST(_weighed(list(range(10, 1, -1))))} and s[11]::int = {_REST(_weighed(list(range(11, 1, -1))))} and replace(s, s[1], '') <> ''"),
    "cnpj": (_cat(_num(12, 982451653), _num(2, 17)), ids.is_valid_cnpj, f"s[13]::int = {_BELOW(_weighed([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]))} and s[14]::int = {_BELOW(_weighed([6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]))} and replace(s, s[1], '') <> ''"),
    "ptnif": (_num(9, 982451653), ids.is_valid_portuguese_nif, f"s[1] <> '0' and s[9]::int = {_BELOW(_weighed(list(range(9, 1, -1))))}"),
    "rut": (_cat(_num(8, 982451653), "'-'", _one("0123456789K", 13)), ids.is_valid_rut, f"s[10] = substr('0123456789K0', 11 - {_weighed([3, 2, 7, 6, 5, 4, 3, 2])} % 11 + 1, 1)"),
    "cuil": (_num(11, 982451653), ids.is_valid_cuil, f"s[11]::int = case 11 - {_weighed([5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 when 11 then 0 when 10 then 9 else 11 - {_weighed([5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 end"),
    "codice_fiscale": (_cat("'RSSMRA'", _num(2, 7), "'A'", _num(2, 13), "'H'", _num(3, 982451653), _one(_AZ, 11)), ids.is_valid_codice_fiscale, f"substr('{_AZ}', ({_ITALIAN}) % 26 + 1, 1) = s[16]"),
    "nino": (_cat(_one(_AZ, 7), _one(_AZ, 11), _num(6, 982451653), _one("ABCDE", 13)), ids.is_valid_nino, "s[1] not in ('D', 'F', 'I', 'Q', 'U', 'V') and s[2] not in ('D', 'F', 'I', 'Q', 'U', 'V', 'O') and s[1:2] not in ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ') and s[9] <> 'E'"),
    "curp": (_cat("'GODE'", _num(6, 982451653), _one("HMX", 7), "'DF'", _one("ABCD", 11), "'NN'", _one("A0-", 13), _num(1, 3)), ids.is_valid_curp, "s[11] <> 'X' and s[14] <> 'A' and s[17] <> '-'"),
    "swift_bic": (_cat("'BANK'", _one("AB1", 7), "'S'", _num(2, 13), _one("XY-", 11), _one("0Z_", 5), _one("9 ", 3)), validate.is_valid_swift_bic, "s[5] <> '1' and s[9] <> '-' and s[10] <> '_' and s[11] = '9'"),
    "phone_format": (_cat(_one("+6789015", 7), "'34 6'", _num(8, 982451653)), lambda c: validate.is_valid_phone_format(c, "ES"), r"regexp_full_match(replace(s, ' ', ''), '(\+34)?[6-9][0-9]{8}')"),
}


def _check_query(kind: str) -> Query:
    made, fn, _ = _CHECKS[kind]
    return lambda spark, d: _t(spark, d, "orders").select(_KEY, F.expr(re.sub(r"varchar\(\d+\)", "string", made)).alias("s")).select(_KEY, "s", fn("s").alias("valid"))


for _kind, (_made, _, _valid) in _CHECKS.items():
    query(f"validate_{_kind}", f"select o_orderkey, s, {_valid} as valid from (select o_orderkey, {re.sub(r'varchar[(][0-9]+[)]', 'varchar', _made)} as s from orders)")(_check_query(_kind))


def _ids(spark, d, *kinds: str) -> DataFrame:
    g = generate.Generator(_KEY, "es_ES", 3)
    o = _t(spark, d, "orders").select(_KEY)
    # the last character goes one on for odd keys
    spoilt = lambda c: F.when(F.col(_KEY) % 2 == 0, c).otherwise(F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.translate(F.substring(c, -1, 1), "TRWAGMYFPDXBNJZSQVHLCKE", "RWAGMYFPDXBNJZSQVHLCKET")))
    return o.select(_KEY, *[getattr(g, k)().alias(k) for k in kinds]).select(_KEY, *[spoilt(F.col(k)).alias(k) for k in kinds])


#: Generated documents are valid, and no longer so with another last character.
_MADE = {"card": ("credit_card_number", validate.is_valid_luhn), "iban": ("iban", validate.is_valid_iban), "ean": ("ean13", validate.is_valid_ean), "isbn10": ("isbn10", validate.is_valid_isbn), "isbn13": ("isbn13", validate.is_valid_isbn), "dni": ("dni", ids.is_valid_dni), "nie": ("nie", ids.is_valid_nie), "cpf": ("cpf", ids.is_valid_cpf), "cnpj": ("cnpj", ids.is_valid_cnpj), "ptnif": ("portuguese_nif", ids.is_valid_portuguese_nif), "rut": ("rut", ids.is_valid_rut), "cuil": ("cuil", ids.is_valid_cuil)}


@query("generated_documents", "select o_orderkey, " + ", ".join(f"true as {k}" for k in _MADE) + " from orders")
def generated_documents(spark, d):
    g = generate.Generator(_KEY, "es_ES", 3)
    made = _t(spark, d, "orders").select(_KEY, *[getattr(g, name)().alias(k) for k, (name, _) in _MADE.items()])
    return made.select(_KEY, *[fn(k).alias(k) for k, (_, fn) in _MADE.items()])


def _digits_sql(n: int, expr: str) -> str:
    return f"lpad(cast({expr} as varchar), {n}, '0')"


@query("validate_luhn_sql", "with c as (select o_orderkey, lpad(cast(o_orderkey * 7919 as varchar), 12, '0') as s from orders) select o_orderkey, list_sum(list_transform(range(1, 13), lambda i: case when (12 - i) % 2 = 1 then (case when 2 * s[i]::int > 9 then 2 * s[i]::int - 9 else 2 * s[i]::int end) else s[i]::int end)) % 10 = 0 as valid from c")
def validate_luhn_sql(spark, d):
    c = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 12, "0")
    return _t(spark, d, "orders").select("o_orderkey", validate.is_valid_luhn(c).alias("valid"))


@query("validate_dni_sql", "with c as (select o_orderkey, lpad(cast(o_orderkey * 37 % 100000000 as varchar), 8, '0') as s from orders) select o_orderkey, s || substr('TRWAGMYFPDXBNJZSQVHLCKE', (s::bigint % 23)::int + 1, 1) as dni from c")
def validate_dni_sql(spark, d):
    c = F.lpad((F.col("o_orderkey") * 37 % 100000000).cast("string"), 8, "0")
    return _t(spark, d, "orders").select("o_orderkey", ids.nif_letter(c).alias("dni"))


@query("validate_ssn", r"with c as (select o_orderkey, lpad(cast(o_orderkey * 104729 % 1000000000 as varchar), 9, '0') as s from orders) select o_orderkey, not (s[1:3] in ('000', '666') or s[1] = '9' or s[4:5] = '00' or s[6:9] = '0000') as valid from c")
def validate_ssn(spark, d):
    c = F.lpad((F.col("o_orderkey") * 104729 % 1000000000).cast("string"), 9, "0")
    return _t(spark, d, "orders").select("o_orderkey", ids.is_valid_ssn(c).alias("valid"))


@query("validate_bsn", "with c as (select o_orderkey, lpad(cast(o_orderkey * 104729 % 1000000000 as varchar), 9, '0') as s from orders) select o_orderkey, (list_sum(list_transform(range(1, 9), lambda i: s[i]::int * (10 - i))) - s[9]::int) % 11 = 0 as valid from c")
def validate_bsn(spark, d):
    c = F.lpad((F.col("o_orderkey") * 104729 % 1000000000).cast("string"), 9, "0")
    return _t(spark, d, "orders").select("o_orderkey", ids.is_valid_bsn(c).alias("valid"))


@query("detect_mixed_scripts", "select o_orderkey, o_orderkey % 4 in (2, 3) or (o_orderkey % 4 = 1 and o_orderkey % 3 = 2) as mixed from orders")
def detect_mixed_scripts(spark, d):
    text = F.expr("concat(case o_orderkey % 4 when 0 then '12 ' when 1 then 'Привет ' when 2 then 'Παπa ' else 'abcд ' end, case o_orderkey % 3 when 0 then '--' when 1 then '42' else 'z' end)")
    return _t(spark, d, "orders").select("o_orderkey", (F.size(validate.detect_mixed_scripts(text)) > 1).alias("mixed"))


@query("validate_vat", "select o_orderkey, o_orderkey % 3 = 0 or o_orderkey % 3 = 1 and o_orderkey % 2 = 0 as valid from orders")
def validate_vat(spark, d):
    """German numbers have nine digits, Dutch ones a B before the last two."""
    vat = F.expr("concat(case o_orderkey % 3 when 0 then 'DE 123 ' when 1 then 'NL123' else 'DE12' end, lpad(cast(o_orderkey as string), 6, '0'), case when o_orderkey % 3 <> 1 then '' when o_orderkey % 2 = 0 then 'B01' else 'C01' end)")
    return _t(spark, d, "orders").select("o_orderkey", validate.is_valid_vat(vat).alias("valid"))


@query("parse_nif")
def parse_nif(spark, d):
    return _ids(spark, d, "dni").select(_KEY, ids.nif_parse("dni").alias("parsed"), ids.european_nif("dni")["type"].alias("kind"), ids.validate_id_document("dni", "ES").alias("valid"))


@query("email_domains", "select c_custkey, case c_custkey % 4 when 0 then 'free' when 1 then 'disposable' when 2 then 'corporate' else 'invalid' end as kind from customer")
def email_domains(spark, d):
    domain = F.expr("case c_custkey % 4 when 0 then '@Gmail.com' when 1 then '@yopmail.com ' when 2 then '@firm.example' else '' end")
    return _t(spark, d, "customer").select("c_custkey", validate.email_domain_type(F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), domain)).alias("kind"))


@query("normalize_phones", "select c_custkey, '+34' || '6' || lpad(cast(c_custkey as varchar), 8, '0') as phone from customer")
def normalize_phones(spark, d):
    raw = F.concat(F.lit("0(6) "), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return _t(spark, d, "customer").select("c_custkey", ops.normalize_phone(raw, "ES").alias("phone"))


# --- similarity of part names


def _pairs(spark, d) -> DataFrame:
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    # as many tasks as asked for: pairs are small, so they would be put into one or two, but comparing them is work
    return p.join(q, "p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


_PAIRS = "(select p.p_partkey, p.p_name as a, q.p_name as b from part p join part q on q.p_partkey = p.p_partkey + 1)"
_bg = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_SIM: dict[str, tuple[Callable, str | None]] = {
    "levenshtein": (similarity.levenshtein_score, "case when a = b then 1.0 else 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) end"),
    "jaccard": (similarity.jaccard_similarity, "len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(list_concat(string_split(a, ''), string_split(b, ''))))"),
    "jaccard_token": (lambda a, b: similarity.jaccard_similarity(a, b, "token"), "len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))"),
    "dice": (similarity.sorensen_dice_coefficient, f"case when a = b then 1.0 else 2.0::double * len(list_intersect({_bg.format('a')}, {_bg.format('b')})) / (len({_bg.format('a')}) + len({_bg.format('b')})) end"),
    "jaro_winkler": (similarity.jaro_winkler_score, None), "ratcliff_obershelp": (similarity.ratcliff_obershelp_score, None), "mra": (similarity.mra_similarity, None),
    "lcs": (lambda a, b: similarity.lcs_score(a, b)["similarity"], None), "percentage": (matching.similarity_percentage, None),
}


def _sim_query(fn: Callable) -> Query:
    return lambda spark, d: _pairs(spark, d).select("p_partkey", fn("p_name", "other").cast("double").alias("score"))


for _name, (_fn, _sql) in _SIM.items():
    query(f"similarity_{_name}", _sql and f"select p_partkey, ({_sql})::double as score from {_PAIRS}")(_sim_query(_fn))


@query("similarity_hamming", f"select p_partkey, hamming(a, b)::bigint as distance from {_PAIRS} where length(a) = length(b)")
def similarity_hamming(spark, d):
    return _pairs(spark, d).select("p_partkey", similarity.hamming("p_name", "other").cast("bigint").alias("distance")).where("distance is not null")


@query("are_equivalent")
def are_equivalent(spark, d):
    return matching.batch_compare(_pairs(spark, d), "p_name", "other").select("p_partkey", "result.*")


@query("compare_names")
def compare_names(spark, d):
    return _pairs(spark, d).select("p_partkey", matching.compare_names("p_name", "other").alias("r")).select("p_partkey", "r.*")


@query("compare_tokens")
def compare_tokens(spark, d):
    return _pairs(spark, d).select("p_partkey", matching.compare_tokens("p_name", "other").alias("same"))


@query("compare_name_bytokens")
def compare_name_bytokens(spark, d):
    return _pairs(spark, d).select("p_partkey", matching.compare_name_bytokens("p_name", "other").alias("r")).select("p_partkey", "r.is_match", "r.rule", "r.coincidences")


@query("compare_phrases")
def compare_phrases(spark, d):
    return _pairs(spark, d).select("p_partkey", matching.compare_phrases("p_name", "other").alias("r")).select("p_partkey", "r.*")


@query("find_common_patterns")
def find_common_patterns(spark, d):
    return _pairs(spark, d).select("p_partkey", matching.find_common_patterns("p_name", "other").alias("r")).select("p_partkey", "r.*")


@query("compare_text_detailed")
def compare_text_detailed(spark, d):
    return _pairs(spark, d).select("p_partkey", matching.compare_text_detailed("p_name", "other").alias("r")).select("p_partkey", "r.ratio", F.size("r.opcodes").alias("n_opcodes"))


@query("same_chars", f"select p_partkey, list_sort(string_split(upper(replace(a, ' ', '')), '')) = list_sort(string_split(upper(replace(b, ' ', '')), '')) as same from {_PAIRS}")
def same_chars(spark, d):
    return _pairs(spark, d).select("p_partkey", matching.same_chars("p_name", "other").alias("same"))


@query("phonetic_codes")
def phonetic_codes(spark, d):
    return _t(spark, d, "part").select("p_partkey", phonetic.soundex("p_name").alias("soundex"), phonetic.metaphone("p_name").alias("metaphone"), phonetic.double_metaphone("p_name").alias("dm"), phonetic.mra_code("p_name").alias("mra")).select("p_partkey", "soundex", "metaphone", "dm.primary", "dm.alternate", "mra")


_NORM = "trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g'))"


@query("detect_duplicates", f"with i as (select p_partkey as id, {_NORM} as s from part) select a.id as id1, b.id as id2, case when a.s = b.s then 1.0::double else 1.0::double - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) end as score from i a join i b on a.id < b.id where 1.0::double - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s), 1) >= 0.85")
def detect_duplicates(spark, d):
    return matching.detect_duplicates(_t(spark, d, "part"), "p_partkey", "p_name", 0.85)


@query("find_best_match")
def find_best_match(spark, d):
    return matching.find_best_match(_t(spark, d, "supplier"), _t(spark, d, "customer"), "s_suppkey", "s_name", "c_custkey", "c_name", 0.7)


@query("compare_lists")
def compare_lists(spark, d):
    return matching.compare_lists(_t(spark, d, "nation"), _t(spark, d, "nation"), "n_nationkey", "n_name", "n_nationkey", "n_name", 3, 0.4)


@query("phonetic_duplicates")
def phonetic_duplicates(spark, d):
    return matching.find_phonetic_duplicates(_t(spark, d, "part"), "p_partkey", "p_name", 0.9)


@query("phonetic_duplicates_metaphone")
def phonetic_duplicates_metaphone(spark, d):
    return matching.find_phonetic_duplicates(_t(spark, d, "part"), "p_partkey", "p_name", use_mra=False)


# --- personal data


@query("pii_summary")
def pii_summary(spark, d):
    return privacy.Anonymizer("en_US").summary(_t(spark, d, "documents"), "text", "lang")


@query("pii_entities")
def pii_entities(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(privacy.Anonymizer("es_ES").detect("text")).alias("e")).select("doc_id", "e.*")


def _strategy(name: str) -> Query:
    return lambda spark, d: _t(spark, d, "documents").select("doc_id", privacy.Anonymizer("es_ES", name).anonymize_text("text").alias("r")).select("doc_id", "r.anonymized", F.size("r.entities").alias("n_entities"))


for _name in privacy.STRATEGIES:
    query(f"anonymize_{_name}")(_strategy(_name))


@query("anonymize_columns", "select c_custkey, substr(sha256(c_name), 1, 12) as name, c_mktsegment from customer")
def anonymize_columns(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment")
    return privacy.Anonymizer(strategy="hash").anonymize_columns(c)


@query("obfuscate_email", "select c_custkey, case when length(c_name) <= 1 then c_name || '@x.com' else substr(c_name, 1, 1) || '***@x.com' end as email from customer")
def obfuscate_email(spark, d):
    return _t(spark, d, "customer").select("c_custkey", privacy.obfuscate_email(F.concat("c_name", F.lit("@x.com"))).alias("email"))


def _people(spark, d) -> DataFrame:
    return _t(spark, d, "customer").select("c_mktsegment", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).cast("bigint").alias("band"))


_PEOPLE = "(select c_mktsegment, c_nationkey, floor(c_acctbal / 1000)::bigint as band from customer)"


@query("privacy_measures", f"with c as (select c_mktsegment, c_nationkey, count(*) as n, count(distinct band) as l from {_PEOPLE} group by 1, 2), v as (select band, row_number() over (order by band) as r, sum(count(*)) over (order by band) / sum(count(*)) over () as cum from {_PEOPLE} group by band), g as (select c.c_mktsegment, c.c_nationkey, v.r, v.cum, (select count(*) from {_PEOPLE} p where p.c_mktsegment = c.c_mktsegment and p.c_nationkey = c.c_nationkey and p.band <= v.band) / c.n as own from c, v), t as (select c_mktsegment, c_nationkey, sum(abs(own - cum)) / ((select count(*) from v) - 1) as t from g group by 1, 2) select (select min(n) from c)::bigint as k_anonymity, (select min(l) from c)::bigint as l_diversity, (select sum(n) from c)::bigint as rows, round((select max(t) from t), 9) as t_closeness")
def privacy_measures(spark, d):
    return privacy.measure_privacy(_people(spark, d), ["c_mktsegment", "c_nationkey"], ["band"]).withColumn("t_closeness", F.round("t_closeness", 9))


#: The same with NULL for a sixth of the segments and nations: a class and a value like others.
_HOLED = "(select nullif(c_mktsegment, 'BUILDING') as c_mktsegment, nullif(c_nationkey, 3) as c_nationkey, floor(c_acctbal / 1000)::bigint as band from customer)"


@query("privacy_measures_nulls", f"""with c as (select c_mktsegment, c_nationkey, count(*) as n, count(distinct band) as l from {_HOLED} group by 1, 2),
  v as (select band, row_number() over (order by band) as r, sum(count(*)) over (order by band) / sum(count(*)) over () as f from {_HOLED} group by band),
  g as (select c.c_mktsegment, c.c_nationkey, v.r, v.f, (select count(*) from {_HOLED} p where p.c_mktsegment is not distinct from c.c_mktsegment and p.c_nationkey is not distinct from c.c_nationkey and p.band <= v.band) / c.n as own from c, v),
  t as (select sum(abs(own - f)) / ((select count(*) from v) - 1) as t from g group by c_mktsegment, c_nationkey)
  select (select min(n) from c)::bigint as k_anonymity, (select min(l) from c)::bigint as l_diversity, (select sum(n) from c)::bigint as rows, round((select max(t) from t), 9)::double as t_closeness""")
def privacy_measures_nulls(spark, d):
    p = _people(spark, d).select(F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"), F.expr("nullif(c_nationkey, 3)").alias("c_nationkey"), "band")
    return privacy.measure_privacy(p, ["c_mktsegment", "c_nationkey"], ["band"]).withColumn("t_closeness", F.round("t_closeness", 9))


@query("suppress_classes", f"select p.* from {_PEOPLE} p join (select c_mktsegment, c_nationkey, band from {_PEOPLE} group by 1, 2, 3 having count(*) >= 3) using (c_mktsegment, c_nationkey, band)")
def suppress_classes(spark, d):
    return privacy.suppress_classes(_people(spark, d), ["c_mktsegment", "c_nationkey", "band"], 3)


@query("k_anonymize")
def k_anonymize(spark, d):
    steps = {"band": [lambda c: F.floor(c / 5), lambda c: F.lit(0).cast("bigint")], "c_nationkey": [lambda c: (c / 5).cast("int")]}
    return privacy.k_anonymize(_t(spark, d, "customer").select("c_name", "c_mktsegment", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).cast("bigint").alias("band")), ["c_name"], ["c_mktsegment", "c_nationkey", "band"], 5, 10, steps)


# --- names, encodings, generation


@query("company_parse")
def company_parse(spark, d):
    s = _t(spark, d, "supplier")
    name = F.concat(F.regexp_replace("s_name", "[^A-Za-z0-9]", " "), F.expr("case s_suppkey % 3 when 0 then ' S.L.' when 1 then ' Sociedad Anonima' else '' end"))
    p = s.select("s_suppkey", names.parse_company(F.upper(name)).alias("p"))
    return p.select("s_suppkey", "p.name", "p.form", names.format_companyname("p.name", "p.form").alias("shown"))


@query("encoding_detect")
def encoding_detect(spark, d):
    bad = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return _t(spark, d, "documents").select("doc_id", encoding.has_mojibake(bad).alias("bad"), (encoding.fix_encoding(bad) == F.col("text")).alias("mended"))


@query("generate_profiles")
def generate_profiles(spark, d):
    return _t(spark, d, "customer").select("c_custkey", generate.Generator("c_custkey").profile_data().alias("p")).select("c_custkey", "p.*")


@query("generate_keys", "select count(*)::bigint as rows, count(*)::bigint as keys from customer")
def generate_keys(spark, d):
    k = _t(spark, d, "customer").select(generate.Generator("c_custkey").unique_key(6).alias("k"))
    return k.agg(F.count("*").alias("rows"), F.count_distinct("k").alias("keys"))


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.all_sql() | _SQL


