"""Personal data: detection with offsets, seven ways to anonymise, and the privacy of tables.

Detection and rewriting are one projection of built-in expressions; nothing is shuffled. The
measures of tables are groupings by the quasi-identifiers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import rx
from ..locales import LOCALES

TYPES = "NAME EMAIL PHONE ADDRESS ID_DOCUMENT CREDIT_CARD IBAN IP_ADDRESS DATE URL ORGANIZATION LOCATION NUMBER CURRENCY CUSTOM".split()
STRATEGIES = "mask replace hash redact generalize pseudonymize suppress".split()
ENTITY = "struct<text:string,pii_type:string,start:int,end:int,confidence:double,source:string>"

#: In the order in which equals are preferred.
UNIVERSAL = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b"),
    ("CREDIT_CARD", r"\b(?:4\d{3}|5[1-5]\d\d|3[47]\d\d|6(?:011|5\d\d))[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{2,4}\b"),
    ("IBAN", r"\b[A-Z]{2}\d\d\s?[\dA-Z]{4}\s?(?:[\dA-Z]{4}\s?){2,7}[\dA-Z]{1,4}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:[\da-fA-F]{1,4}:){7}[\da-fA-F]{1,4}\b"),
    ("URL", r"""(?:https?://|www\.)[^\s<>"']+"""),
    ("DATE", r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\b\d{4}[/.-]\d{1,2}[/.-]\d{1,2}\b"),
    ("CURRENCY", r"[R$€£¥₹]\s?\d[\d.,]*\d|\d[\d.,]*\d\s?(?:[$€£¥₹]|(?:EUR|USD|GBP|BRL|MXN|ARS|COP|CLP)\b)"),
)
_BY_FIELD = {
    "NAME": "name nombre full_name fullname first_name firstname last_name lastname surname apellido", "EMAIL": "email correo mail email_address",
    "PHONE": "phone telefono phone_number mobile telephone tel", "ADDRESS": "address direccion street street_address postcode zip_code zip codigo_postal",
    "LOCATION": "city ciudad state provincia country pais", "CREDIT_CARD": "credit_card tarjeta card_number", "IBAN": "iban bban", "IP_ADDRESS": "ip ip_address",
    "ID_DOCUMENT": "dni nif ssn id_document document documento passport pasaporte curp rfc cpf cnpj", "URL": "url website web",
    "DATE": "date_of_birth dob birth_date birthdate fecha_nacimiento", "ORGANIZATION": "company empresa organization",
}
FIELD_TYPES = {name: kind for kind, names in _BY_FIELD.items() for name in names.split()}


#: Characters or strings of which a text must have one to match a universal pattern; patterns with a
#: digit outside brackets need a digit.
_NEEDS = {"EMAIL": "@", "URL": "http www.", "IP_ADDRESS": "digit :"}


def possible(c: Column, pattern: str, kind: str, digit: Column) -> Column:
    """False where a text certainly has no match: most texts are not searched at all."""
    needs = _NEEDS.get(kind, "digit" if r"\d" in re.sub(r"\[[^\]]*\]", "", pattern) and kind != "CUSTOM" else "").split()
    return reduce(lambda a, b: a | b, [digit if n == "digit" else F.contains(c, F.lit(n)) for n in needs]) if needs else F.lit(True)


def hits(c: Column, pattern: str, kind: str, confidence: float, source: str = "regex", may: Column | None = None) -> Column:
    """Array of entities: what lies between the matches gives their offsets."""
    found = F.regexp_extract_all(c, F.lit(rx.UNICODE + pattern), F.lit(0))
    gaps = F.split(c, rx.UNICODE + pattern, -1)
    state = F.aggregate(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{ENTITY}>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(s["out"], F.array(F.struct(x["m"].alias("text"), F.lit(kind).alias("pii_type"), (s["at"] + F.length(x["g"])).alias("start"), (s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source")).cast(ENTITY))).alias("out"),
        ),
    )
    # texts without a match stop after one search
    found_any = F.rlike(c, F.lit(rx.UNICODE + pattern))
    return F.when(found_any if may is None else F.when(may, found_any).otherwise(False), state["out"]).otherwise(F.array().cast(f"array<{ENTITY}>"))


@dataclass
class Anonymizer:
    """Settings of detection and replacement; every method builds expressions.

    detectors: further sources of entities, each a function of the text column that gives an array of
    entities (a named-entity model behind a pandas_udf, for instance).
    mask_functions: type (or "*" for all) -> function of a column, used by the mask strategy.
    """

    locale: str = "es_ES"
    strategy: str = "redact"
    seed: int = 0
    mask_char: str = "*"
    strategies: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    mask_functions: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    detectors: list[Callable[[Column], Column]] = field(default_factory=list)

    def __post_init__(self):
        if len(self.mask_char) != 1:
            raise ValueError("mask_char is one character")
        for s in (self.strategy, *self.strategies.values()):
            if s not in STRATEGIES:
                raise ValueError(f"unknown strategy: {s}")

    def set_strategy(self, strategy: str, pii_type: str | None = None) -> "Anonymizer":
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {strategy}")
        if pii_type is None:
            self.strategy = strategy
        else:
            self.strategies[pii_type] = strategy
        return self

    def set_mask_function(self, fn: Callable[[Column], Column], pii_type: str | None = None) -> "Anonymizer":
        self.mask_functions[pii_type or "*"] = fn
        return self

    def add_pattern(self, name: str, pattern: str) -> "Anonymizer":
        """A pattern whose matches are CUSTOM."""
        self.patterns[name] = pattern
        return self

    def reset(self) -> "Anonymizer":
        for held in (self.strategies, self.patterns, self.mask_functions, self.detectors):
            held.clear()
        self.mask_char = "*"
        return self

    def _rules(self) -> list[tuple[str, str, float]]:
        out = [(kind, pattern, 0.90) for kind, pattern in UNIVERSAL]
        if profile := LOCALES.get(self.locale):
            out += [("ID_DOCUMENT", p, 0.85) for p in profile.documents.values()]
            out += [("PHONE", profile.phone, 0.80), ("ADDRESS", profile.postcode, 0.60)]
        return out + [("CUSTOM", p, 0.70) for p in self.patterns.values()]

    def detect(self, c: Column | str, min_confidence: float = 0.0, pii_types: list[str] | None = None, use_regex: bool = True) -> Column:
        """Entities in order of their places. Of overlapping ones the more confident stays, of equals
        the earlier detector's; the filters apply after that."""
        c = rx.col(c)
        return rx.let(F.rlike(c, F.lit(r"\p{Nd}")), lambda digit: self._detect(c, digit, min_confidence, pii_types, use_regex))

    def _detect(self, c: Column, digit: Column, min_confidence: float, pii_types: list[str] | None, use_regex: bool) -> Column:
        parts = [hits(c, p, k, conf, may=possible(c, p, k, digit)) for k, p, conf in self._rules()] if use_regex else []
        parts += [F.coalesce(d(c), F.array().cast(f"array<{ENTITY}>")) for d in self.detectors]
        if not parts:
            return F.when(c.isNotNull(), F.array().cast(f"array<{ENTITY}>"))
        all_ = F.concat(*parts)
        ranked = F.transform(all_, lambda e, i: F.struct((-e["confidence"]).alias("c"), i.alias("i"), e.alias("e")))
        kept = F.aggregate(
            F.array_sort(ranked),
            F.array().cast(f"array<{ENTITY}>"),
            lambda k, r: F.when(F.exists(k, lambda q: (r["e"]["start"] < q["end"]) & (q["start"] < r["e"]["end"])), k).otherwise(F.concat(k, F.array(r["e"]))),
        )
        ok = lambda e: (e["confidence"] >= min_confidence) & (e["pii_type"].isin(pii_types) if pii_types is not None else F.lit(True))
        placed = F.transform(F.filter(kept, ok), lambda e: F.struct(e["start"].alias("s"), (-e["end"]).alias("t"), e.alias("e")))
        return F.when(c.isNotNull(), F.transform(F.array_sort(placed), lambda p: p["e"]))

    def _mask(self, text: Column, kind: Column) -> Column:
        ch = self.mask_char
        many = lambda n: F.repeat(F.lit(ch), n.cast("int"))
        digits = F.regexp_replace(text, r"(?U)\D", "")
        n = F.length(text)
        local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
        email = F.when(F.size(F.split(text, "@")) == 2, F.concat(F.when(local == "", F.lit(ch * 3)).otherwise(F.concat(F.substring(local, 1, 1), many(F.length(local) - 1))), F.lit("@"), many(F.length(F.substring_index(domain, ".", 1))), F.lit("." + ch * 3))).otherwise(many(n))
        number = F.when(F.length(digits) > 4, F.concat(many(F.length(digits) - 4), F.substring(digits, -4, 4))).otherwise(many(n))
        name = F.concat_ws(" ", F.transform(F.split(rx.squeeze(text), " "), lambda w: F.when(F.length(w) > 1, F.concat(F.substring(w, 1, 1), many(F.length(w) - 1))).otherwise(F.lit(ch))))
        other = F.when(n > 2, F.concat(F.substring(text, 1, 1), many(n - 2), F.substring(text, -1, 1))).otherwise(many(n))
        out = F.when(F.lit(False), text)
        for k, fn in self.mask_functions.items():
            if k != "*":
                out = out.when(kind == k, fn(text))
        if "*" in self.mask_functions:
            return out.otherwise(self.mask_functions["*"](text))
        return out.when(kind == "EMAIL", email).when(kind.isin("PHONE", "CREDIT_CARD"), number).when(kind == "NAME", name).otherwise(other)

    @staticmethod
    def _generalize(text: Column, kind: Column) -> Column:
        year, short = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.regexp_extract(text, r"\d{1,2}[/.-]\d{1,2}[/.-](\d{2,4})", 1)
        digits = F.regexp_replace(text, r"(?U)\D", "")
        decade = (F.floor(F.try_to_number(digits, F.lit("9" * 30)) / 10) * 10).cast("decimal(31,0)")
        domain = F.substring_index(text, "@", -1)
        email = F.when(F.size(F.split(text, "@")) == 2, F.concat(F.lit("***@"), F.substring_index(domain, ".", -2))).otherwise(F.lit("***@***"))
        place = F.trim(F.substring_index(text, ",", 1))
        other = F.when(F.length(text) > 4, F.concat(F.substring(text, 1, 2), F.lit("..."), F.substring(text, -2, 2))).otherwise(F.lit("***"))
        return (
            F.when(kind == "DATE", F.when(year != "", year).when(short != "", short).otherwise(text))
            .when(kind == "NUMBER", F.coalesce(F.concat(decade.cast("string"), F.lit("-"), (decade + 9).cast("string")), text))
            .when(kind.isin("ADDRESS", "LOCATION"), place)
            .when(kind == "EMAIL", email)
            .otherwise(other)
        )

    def apply(self, text: Column | str, kind: Column | str, strategy: str | None = None, row: Column | None = None) -> Column:
        """What stands for a text of a type. replace depends on row as well, pseudonymize on the text
        alone, so equal texts have equal pseudonyms in all partitions, and no state is kept."""
        from . import generate

        text = rx.col(text)
        kind = F.lit(kind) if isinstance(kind, str) else kind
        key = F.xxhash64(F.lit(self.seed), text)
        forms = {
            "mask": lambda: self._mask(text, kind),
            "hash": lambda: F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 12),
            "redact": lambda: F.concat(F.lit("["), kind, F.lit("]")),
            "generalize": lambda: self._generalize(text, kind),
            "suppress": lambda: F.lit(""),
            "pseudonymize": lambda: generate.replacement(kind, key, self.locale),
            "replace": lambda: generate.replacement(kind, key if row is None else F.xxhash64(F.lit(self.seed), text, row), self.locale),
        }
        if strategy is not None:
            if strategy not in STRATEGIES:
                raise ValueError(f"unknown strategy: {strategy}")
            return forms[strategy]()
        out = reduce(lambda a, kv: a.when(kind == kv[0], forms[kv[1]]()), self.strategies.items(), F.when(F.lit(False), F.lit("")))
        return out.otherwise(forms[self.strategy]())

    def anonymize_text(self, c: Column | str, strategy: str | None = None, min_confidence: float = 0.0, pii_types: list[str] | None = None) -> Column:
        """Struct of original, anonymized, entities and replacements (first occurrence of each text)."""
        c = rx.col(c)
        # entities and what replaces them are computed once, however often they are used
        pairs = lambda entities: F.transform(entities, lambda e: F.struct(e.alias("e"), self.apply(e["text"], e["pii_type"], strategy, e["start"]).alias("r")))
        return F.when(c.isNotNull(), rx.let(self.detect(c, min_confidence, pii_types), lambda entities: rx.let(pairs(entities), lambda p: self._rewritten(c, p))))

    @staticmethod
    def _rewritten(c: Column, pairs: Column) -> Column:
        done = F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda s, p: F.struct(p["e"]["end"].alias("at"), F.concat(s["out"], F.substring(c, s["at"] + 1, p["e"]["start"] - s["at"]), p["r"]).alias("out")),
            lambda s: F.concat(s["out"], F.substring(c, s["at"] + 1, F.length(c))),
        )
        once = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["e"]["text"] == p["e"]["text"]))
        replaced = F.map_from_entries(F.transform(once, lambda p: F.struct(p["e"]["text"].alias("key"), p["r"].alias("value"))))
        return F.struct(c.alias("original"), done.alias("anonymized"), F.transform(pairs, lambda p: p["e"]).alias("entities"), replaced.alias("replacements"))

    def anonymize_columns(self, df: DataFrame, column_types: dict[str, str] | None = None, strategy: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """Columns whose names (or column_types) say what they hold, anonymised as strings; NULL and
        'nan' stay. Other columns pass through. Texts are not searched."""
        types = column_types or {}
        out = {}
        for name in df.columns:
            kind = types.get(name) or FIELD_TYPES.get(name.lower())
            if kind and (columns is None or name in columns):
                value = F.col(f"`{name}`").cast("string")
                out[name] = F.when(value.isNull() | (value == "nan"), value).otherwise(self.apply(value, kind, strategy))
        return df.withColumns(out) if out else df

    def anonymize_records(self, df: DataFrame, column_types: dict[str, str] | None = None, strategy: str | None = None, free_text: bool = False) -> DataFrame:
        """As anonymize_columns, down through structs, arrays and maps: a field's name says what it
        holds; lists of texts take their column's. With free_text, other texts are searched."""
        types = {k.lower(): v for k, v in (column_types or {}).items()}

        def walked(value: Column, kind, name: str) -> Column:
            if isinstance(kind, T.StructType):
                fields = F.struct(*[walked(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields])
                return F.when(value.isNotNull(), fields)
            if isinstance(kind, T.ArrayType):
                return F.transform(value, lambda x: walked(x, kind.elementType, name))
            if isinstance(kind, T.MapType):
                return F.transform_values(value, lambda k, x: walked(x, kind.valueType, name))
            pii = types.get(name.lower()) or FIELD_TYPES.get(name.lower())
            if pii:
                text = value.cast("string")
                return F.when(text.isNull() | (text == "nan"), text).otherwise(self.apply(text, pii, strategy))
            return self.anonymize_text(value, strategy)["anonymized"] if free_text and isinstance(kind, T.StringType) else value

        return df.select(*[walked(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])

    def summary(self, df: DataFrame, text: str, *keys: str) -> DataFrame:
        """Entities by type (and keys)."""
        found = df.select(*keys, F.explode(self.detect(text)).alias("e"))
        return found.groupBy(*keys, F.col("e.pii_type").alias("pii_type")).agg(F.count("*").alias("n_entities"))


def obfuscate_email(c: Column | str, mode: str = "null") -> Column:
    """First character, three stars, and the domain; NULL (or an error) without @."""
    c = rx.col(c)
    domain = F.substring_index(c, "@", -1)
    local = F.substring(c, F.lit(1), F.length(c) - F.length(domain) - 1)
    bad = F.raise_error(F.lit("not an e-mail address")).cast("string") if mode == "fail" else F.lit(None)
    return F.when(F.instr(c, "@") == 0, bad).when(F.length(local) <= 1, c).otherwise(F.concat(F.substring(local, 1, 1), F.lit("***@"), domain))


def classes(df: DataFrame, quasi: list[str], sensitive: list[str] = ()) -> DataFrame:
    """Size, and different sensitive values, of each equivalence class."""
    return df.groupBy(*quasi).agg(F.count("*").alias("size"), *[F.count_distinct(F.coalesce(F.col(s).cast("string"), F.lit("\0"))).alias(f"distinct_{s}") for s in sensitive])


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> list[Column]:
    return [left[q].eqNullSafe(right[q]) for q in names]


def closeness(df: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """Distance of each class's distribution of a sensitive value from the table's: ordered earth
    mover's for numbers (by rank), half the absolute differences for others. NULL is a value like
    others, in classes as well (first in order)."""
    numeric = dict(df.dtypes)[sensitive] not in ("string", "boolean", "date", "timestamp")
    total = df.groupBy(F.col(sensitive).alias("_v")).agg(F.count("*").alias("_all"))
    n = df.count()
    per = df.groupBy(*quasi, F.col(sensitive).alias("_v")).agg(F.count("*").alias("_c"))
    size = df.groupBy(*quasi).agg(F.count("*").alias("size"))
    if not numeric:
        # values that a class lacks count with their share of the table
        joined = per.join(total, per["_v"].eqNullSafe(total["_v"])).drop(total["_v"])
        joined = joined.join(size, _same(joined, size, quasi)).select(*[joined[q] for q in quasi], "_c", "_all", "size")
        mine, whole = F.col("_c") / F.col("size"), F.col("_all") / F.lit(n)
        return joined.groupBy(*quasi).agg(((F.sum(F.abs(mine - whole)) + 1 - F.sum(whole)) / 2).alias("t"))
    ranked = _ranked(total, n)
    ends = ranked.agg(F.count("*").alias("m"), F.max("_g").alias("g")).first()
    m = ends["m"]
    if m < 2:
        return size.select(*quasi, F.lit(0.0).alias("t"))
    points = per.join(ranked, per["_v"].eqNullSafe(ranked["_v"])).drop(ranked["_v"])
    points = points.join(size, _same(points, size, quasi)).select(*[points[q].alias(f"_q{i}") for i, q in enumerate(quasi)], "_c", "_r", "_f", "_g", "size")
    # between two of a class's values its own sum k is constant, and the table's sum f rises past k at
    # one place: the gap's |k - f| add up to differences of the table's running sums g
    w = Window.partitionBy(*[f"_q{i}" for i in range(len(quasi))]).orderBy("_r")
    gaps = points.select(
        *[f"_q{i}" for i in range(len(quasi))], (F.sum("_c").over(w) / F.col("size")).alias("k"), F.col("_r").alias("lo"), (F.col("_g") - F.col("_f")).alias("g_before"),
        (F.coalesce(F.lead("_r").over(w), F.lit(m + 1)) - 1).alias("hi"), F.coalesce(F.lead(F.col("_g") - F.col("_f")).over(w), F.lit(ends["g"])).alias("g_hi"), F.lag("_r").over(w).isNull().alias("is_first"),
    )
    g = _below(gaps, ranked)
    up = F.when(F.col("r") < F.col("lo"), F.struct((F.col("lo") - 1).alias("r"), F.col("g_before").alias("g"))).when(F.col("r") > F.col("hi"), F.struct(F.col("hi").alias("r"), F.col("g_hi").alias("g"))).otherwise(F.struct("r", "g"))
    g = g.withColumn("up", up)
    area = F.expr("k * (up.r - lo + 1) - (up.g - g_before) + (g_hi - up.g) - k * (hi - up.r) + if(is_first, g_before, 0.0)")
    out = g.groupBy(*[f"_q{i}" for i in range(len(quasi))]).agg((F.sum(area) / (m - 1)).alias("t"))
    return out.select(*[F.col(f"_q{i}").alias(q) for i, q in enumerate(quasi)], "t")


#: Ranges of values, and of shares, over which running sums are taken piece by piece.
_RANGES, _SHARES = 256, 1 << 12


def _ranked(total: DataFrame, n: int) -> DataFrame:
    """(_v, _r, _f, _g) of a table's different values (_v, _all): rank, share of rows up to the value,
    and the running sum of these shares; NULL is first. Each range of values is a window of its own,
    only the ranges' totals are one table."""
    cuts = sorted(set(total.where("_v is not null").select(F.col("_v").cast("double").alias("v")).approxQuantile("v", [k / _RANGES for k in range(1, _RANGES)], 0.001)))
    at = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_v").cast("double"))) if cuts else F.lit(0))

    def summed(df: DataFrame, what: str, out: str) -> DataFrame:
        inside = Window.partitionBy("_at").orderBy("_v")
        before = df.groupBy("_at").agg(F.sum(what).alias("_s")).select("_at", F.coalesce(F.sum("_s").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
        return df.withColumn(out, F.sum(what).over(inside)).join(F.broadcast(before), "_at").withColumn(out, F.col(out) + F.col("_off")).drop("_off")

    placed = summed(summed(total.withColumns({"_at": at, "_one": F.lit(1)}), "_one", "_r"), "_all", "_f")
    return summed(placed.withColumn("_f", F.col("_f") / F.lit(n)), "_f", "_g").select("_v", "_r", "_f", "_g")


def _below(gaps: DataFrame, ranked: DataFrame) -> DataFrame:
    """gaps with (r, g) of the last value whose share _f is below their k; 0 if there is none."""
    share = lambda c: F.floor(F.col(c) * _SHARES).cast("int")
    marks = ranked.select(share("_f").alias("_at"), F.col("_f").alias("_x"), F.lit(1).alias("_kind"), F.struct(F.col("_r").alias("r"), F.col("_g").alias("g")).alias("_last"))
    asked = gaps.select(share("k").alias("_at"), F.col("k").alias("_x"), F.lit(0).alias("_kind"), F.struct(*gaps.columns).alias("_gap"))
    both = marks.withColumn("_gap", F.lit(None).cast(asked.schema["_gap"].dataType)).unionByName(asked.withColumn("_last", F.lit(None).cast(marks.schema["_last"].dataType)))
    inside = both.withColumn("_last", F.last("_last", True).over(Window.partitionBy("_at").orderBy("_x", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_kind = 0")
    tops = marks.groupBy("_at").agg(F.max("_last").alias("_top"))
    shares = marks.sparkSession.range(_SHARES + 2).select(F.col("id").cast("int").alias("_at")).join(tops, "_at", "left")
    before = shares.select("_at", F.last("_top", True).over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    found = inside.join(F.broadcast(before), "_at").withColumn("_last", F.coalesce("_last", "_before"))
    return found.select("_gap.*", F.coalesce("_last.r", F.lit(0)).alias("r"), F.coalesce("_last.g", F.lit(0.0)).alias("g"))


def measure_privacy(df: DataFrame, quasi: list[str], sensitive: list[str] = ()) -> DataFrame:
    """One row: k, l and t of a table, and its rows."""
    out = classes(df, quasi, list(sensitive)).agg(F.min("size").alias("k_anonymity"), F.least(*[F.min(f"distinct_{s}") for s in sensitive]).alias("l_diversity") if len(sensitive) > 1 else (F.min(f"distinct_{sensitive[0]}") if sensitive else F.lit(None).cast("bigint")).alias("l_diversity"), F.sum("size").alias("rows"))
    if not sensitive:
        return out.withColumn("t_closeness", F.lit(None).cast("double"))
    t = reduce(DataFrame.unionByName, [closeness(df, quasi, s).agg(F.max("t").alias("t")) for s in sensitive]).agg(F.max("t").alias("t_closeness"))
    return out.crossJoin(t)


def suppress_classes(df: DataFrame, quasi: list[str], k: int = 2, sensitive: list[str] = (), l_value: int = 1, t: float | None = None) -> DataFrame:
    """Rows of the classes that have at least k rows, l_value different values of each sensitive
    column, and distributions within t."""
    c = classes(df, quasi, list(sensitive)).where(F.col("size") >= k)
    for s in sensitive:
        c = c.where(F.col(f"distinct_{s}") >= l_value)
        if t is not None:
            near = closeness(df, quasi, s).where(F.col("t") <= t).select(*quasi)
            c = c.join(near, _same(c, near, quasi), "left_semi")
    return df.join(c.select(*quasi), [df[q].eqNullSafe(c[q]) for q in quasi], "left_semi")


def k_anonymize(df: DataFrame, identifiers: list[str], quasi: list[str], k: int = 2, max_suppressed: int = 0, hierarchies: dict[str, list[Callable[[Column], Column]]] | None = None) -> DataFrame:
    """Datafly (Sweeney 1997): while more than max_suppressed rows are in classes below k, generalise
    the quasi-identifier with most different values by its next function; then drop these rows.
    Identifiers become '*'. A quasi-identifier without further functions becomes '*' as a last step."""
    held = {q: [*(hierarchies or {}).get(q, [])] for q in quasi}
    out = df.withColumns({i: F.lit("*") for i in identifiers}) if identifiers else df
    stars: set[str] = set()
    while True:
        c = classes(out, quasi).where(F.col("size") < k).agg(F.sum("size").alias("n")).first()["n"] or 0
        if c <= max_suppressed or len(stars) == len(quasi):
            return suppress_classes(out, quasi, k)
        counts = out.agg(*[F.count_distinct(q).alias(q) for q in quasi if q not in stars]).first().asDict()
        q = max(counts, key=lambda name: (counts[name], name))
        if held[q]:
            out = out.withColumn(q, held[q].pop(0)(F.col(q)))
        else:
            out = out.withColumn(q, F.lit("*"))
            stars.add(q)
