"""Which similarity suits two texts: a chain of rules on two columns, and what each case recommends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rx

#: use case -> (primary, secondary, expected gain, thresholds)
CASES: dict[str, tuple[str, list[str], float, dict[str, float]]] = {
    "email": ("levenshtein", [], 1.0, {"levenshtein": 0.95}),
    "phone": ("hamming", ["levenshtein"], 8.0, {"hamming": 0.85, "levenshtein": 0.9}),
    "postal_code": ("hamming", ["levenshtein"], 10.0, {"hamming": 0.9, "levenshtein": 0.95}),
    "license_plate": ("hamming", ["levenshtein"], 10.0, {"hamming": 0.85, "levenshtein": 0.9}),
    "product_code": ("hamming", ["levenshtein"], 9.0, {"hamming": 0.9, "levenshtein": 0.95}),
    "invoice_number": ("levenshtein", ["hamming"], 1.2, {"levenshtein": 0.9, "hamming": 0.85}),
    "address": ("token_based", ["levenshtein"], 1.8, {"levenshtein": 0.75, "token_overlap": 0.8}),
    "company_name": ("token_based", ["levenshtein", "jaro_winkler"], 1.5, {"levenshtein": 0.8, "jaro_winkler": 85.0}),
    "person_name": ("jaro_winkler", ["metaphone", "levenshtein"], 2.0, {"levenshtein": 0.85, "jaro_winkler": 90.0}),
    "city": ("jaro_winkler", ["metaphone", "levenshtein"], 2.2, {"levenshtein": 0.85, "jaro_winkler": 90.0}),
    "short_text": ("jaro_winkler", ["levenshtein"], 2.5, {"jaro_winkler": 90.0, "levenshtein": 0.85}),
    "long_text": ("token_based", ["levenshtein"], 2.0, {"token_overlap": 0.75, "levenshtein": 0.7}),
    "general": ("levenshtein", ["jaro_winkler"], 1.0, {"levenshtein": 0.85, "jaro_winkler": 90.0}),
}
PHONETIC = {"person_name", "city", "general"}
SPEED = {"hamming": 10.0, "metaphone": 8.0, "jaro_winkler": 2.0, "token_based": 1.5, "levenshtein": 1.0}
_ADDRESS = sorted("st ste suite street rd road ln lane dr drive ave avenue apt apartment blvd boulevard".split(), key=len)
_COMPANY = sorted("ag sa inc ltd llc plc srl corp gmbh".split(), reverse=True)


def detect_use_case(a: Column | str, b: Column | str) -> Column:
    """First rule that fits both texts."""
    a, b = rx.col(a), rx.col(b)
    both = F.concat_ws(" ", a, b)
    low, up, solid = F.lower(both), F.upper(both), F.length(F.replace(both, F.lit(" "), F.lit("")))
    n_digits, n_letters = F.regexp_count(low, F.lit(r"(?U)\d")), F.regexp_count(low, F.lit("[a-z]"))
    share = lambda n: n / F.greatest(solid, F.lit(1))
    each = lambda pattern: rx.has(F.upper(a), pattern) & rx.has(F.upper(b), pattern)
    sizes = lambda low_, high: F.size(F.split(rx.squeeze(a), " ")).between(low_, high) & F.size(F.split(rx.squeeze(b), " ")).between(low_, high)
    longest = F.greatest(F.length(a), F.length(b))
    plate = r"[A-Z]{2,4}\s*\d{2,4}|\d{2,4}\s*[A-Z]{2,4}"
    contains = lambda words: rx.has(low, "|".join(words))
    rules = (
        ("email", rx.has(low, r"\b\S+@\S+\.\S+\b")),
        ("phone", rx.has(low, r"[\d\s()-]{7,}") & (n_digits >= 7) & (share(n_digits) > 0.6)),
        ("postal_code", (longest <= 10) & each(r"\A[A-Z0-9\s-]{3,10}\z")),
        ("license_plate", (longest <= 12) & each(r"\A[A-Z0-9\s-]{4,12}\z") & (rx.has(F.upper(a), plate) | rx.has(F.upper(b), plate))),
        ("product_code", rx.has(up, "[A-Z0-9]+-[A-Z0-9]+-[A-Z0-9]+")),
        ("invoice_number", rx.has(up, r"(?:INV|ORD|PO|REF|NO)[-\s]*\d+")),
        ("address", contains(_ADDRESS)),
        ("company_name", contains(_COMPANY)),
        ("person_name", sizes(2, 4) & (share(n_letters) > 0.85)),
        ("city", sizes(1, 3) & (longest <= 30) & (share(n_letters) > 0.9)),
        ("short_text", F.length(a) + F.length(b) <= 40),
        ("long_text", F.length(a) + F.length(b) >= 200),
    )
    out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("string"))
    for name, rule in rules:
        out = out.when(rule, F.lit(name))
    return out.otherwise(F.lit("general"))


def get_optimal_config(a: Column | str, b: Column | str, use_case: str | None = None) -> Column:
    """Struct of use case, algorithms, thresholds and expected gain."""
    case = F.lit(use_case) if use_case else detect_use_case(a, b)
    pick = lambda f: F.element_at(F.create_map(*[x for k, v in CASES.items() for x in (F.lit(k), f(k, v))]), case)
    return F.struct(
        case.alias("use_case"), pick(lambda k, v: F.lit(v[0])).alias("primary"), pick(lambda k, v: F.array(*map(F.lit, v[1])).cast("array<string>")).alias("secondary"),
        pick(lambda k, v: F.create_map(*[F.lit(x) for kv in v[3].items() for x in kv])).alias("thresholds"), pick(lambda k, v: F.lit(v[2])).alias("expected_gain"),
        case.isin(*PHONETIC).alias("metaphone_required"),
    )


def explain_selection(a: Column | str, b: Column | str) -> Column:
    c = get_optimal_config(a, b)
    return F.format_string("use case %s: %s, then %s; expected gain %.1f", c["use_case"], c["primary"], F.array_join(c["secondary"], ", "), c["expected_gain"])


def all_use_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v[0], v[1], v[2]) for k, v in CASES.items()], "use_case string, primary string, secondary array<string>, expected_gain double")
