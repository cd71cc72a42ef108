"""Identity documents as expressions: formats, check digits, and what they are canonically."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import digits as D, rx

LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_CODES = "ES DE FR PT IT EL AT BE BG HR CY CZ DK EE FI HU IE LV LT LU MT NL PL RO SK SI SE GB UK".split()
_NATIONAL = {
    "DE": (r"\d{9}", "GERMANY"), "FR": (r"[A-Z0-9]{2}\d{9}", "FRANCE"), "PT": (r"\d{9}", "PORTUGAL"), "IT": (r"\d{11}", "ITALY"), "EL": (r"\d{9}", "GREECE"),
    "AT": (r"U\d{8}", "AUSTRIA"), "BE": (r"0\d{9}", "BELGIUM"), "BG": (r"\d{9,10}", "BULGARIA"), "HR": (r"\d{11}", "CROATIA"), "CY": (r"\d{8}[A-Z]", "CYPRUS"),
    "CZ": (r"\d{8,10}", "CZECH REPUBLIC"), "DK": (r"\d{8}", "DENMARK"), "EE": (r"\d{9}", "ESTONIA"), "FI": (r"\d{8}", "FINLAND"), "HU": (r"\d{8}", "HUNGARY"),
    "IE": (r"\d{7}[A-Z]{1,2}", "IRELAND"), "LV": (r"\d{11}", "LATVIA"), "LT": (r"\d{9,12}", "LITHUANIA"), "LU": (r"\d{8}", "LUXEMBOURG"), "MT": (r"\d{8}", "MALTA"),
    "NL": (r"\d{9}B\d{2}", "NETHERLANDS"), "PL": (r"\d{10}", "POLAND"), "RO": (r"\d{2,10}", "ROMANIA"), "SK": (r"\d{10}", "SLOVAKIA"), "SI": (r"\d{8}", "SLOVENIA"),
    "SE": (r"\d{10}[01]{2}", "SWEDEN"), "GB": (r"\d{9}", "UNITED KINGDOM"),
}


def _digits(c: Column | str) -> Column:
    return F.regexp_replace(rx.col(c), "[^0-9]", "")


def _number(c: Column, first: int, size: int) -> Column:
    """Characters from `first` as an integer; non-digits count as anything, so test the shape too."""
    return D.weighted(F.substring(c, first + 1, size), [10 ** (size - 1 - k) for k in range(size)])


def _is(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(f"^(?:{pattern})$"))


def _false(c: Column, out: Column) -> Column:
    """FALSE instead of NULL, but for NULL."""
    return F.when(c.isNotNull(), F.coalesce(out, F.lit(False)))


def nif_padding(c: Column | str) -> Column:
    """Without spaces and hyphens, upper case, its number filled up with zeros if it is too short."""
    s = F.upper(F.translate(F.trim(rx.col(c)), " -", ""))
    n, last, first = F.length(s), F.substring(s, -1, 1), F.substring(s, 1, 1)
    body = F.substring(s, F.lit(1), n - 1)
    middle = F.substring(s, F.lit(2), n - 2)
    foreign = F.concat(first, F.lpad(middle, 7, "0"), last)
    return (
        F.when(n >= 9, s)
        .when(_is(s, "[0-9]{1,7}[A-Z]"), F.concat(F.lpad(body, 8, "0"), last))
        .when(_is(s, "[A-Z][0-9]{1,6}[A-Z]"), foreign)
        .when(_is(s, "[A-Z][0-9]{1,6}[0-9]"), foreign)
        .otherwise(s)
    )


def _control(c: Column) -> Column:
    """Letter of a DNI, or of a NIE with X, Y, Z as 0, 1, 2."""
    s = F.translate(F.substring(c, 1, 1), "XYZ", "012")
    return D.pick(LETTERS, _number(F.concat(s, F.substring(c, 2, 7)), 0, 8) % 23)


def nif_parse(c: Column | str) -> Column:
    """The document in canonical form if it is a valid DNI, NIE or CIF, else NULL."""
    dni, nie, cif = "[0-9]{8}[A-HJ-NP-TV-Z]", "[XYZ][0-9]{7}[A-HJ-NP-TV-Z]", "[A-HJ-NP-SU-W][0-9]{7}[0-9A-J]"
    raw = F.upper(F.trim(rx.col(c)))
    canonical = rx.let(raw, lambda s: F.when(_is(s, f"{dni}|{nie}|{cif}"), s).otherwise(nif_padding(s)))

    def parsed(s: Column) -> Column:
        doubled = [D.at(s, k) * 2 for k in (2, 4, 6)]
        total = reduce(lambda a, b: a + b, [F.floor(x / 10) + x % 10 for x in doubled] + [D.at(s, k) for k in (1, 3, 5, 7)])
        last, first = F.substring(s, 9, 1), F.substring(s, 1, 1)

        def good(digit: Column) -> Column:
            as_letter, as_digit = last == D.pick("JABCDEFGHI", digit), last == digit.cast("string")
            return F.when(first.isin(*"PQRSW"), as_letter).when(first.isin(*"ABEH"), as_digit).otherwise(as_letter | as_digit)

        control = rx.let(((10 - total % 10) % 10).cast("int"), good)
        return F.when(_is(s, f"{dni}|{nie}"), F.when(last == _control(s), s)).when(_is(s, cif), F.when(control, s))

    return rx.let(canonical, parsed)


def nif_letter(c: Column | str) -> Column:
    """The text with its computed letter at the end; as it is if it has no number."""
    c = rx.col(c)
    s = F.upper(F.translate(c, " .-", ""))
    return F.when(F.rlike(s, F.lit("^[0-9XYZ][0-9]{7}")), F.concat(c, _control(s))).otherwise(c)


def is_valid_dni(c: Column | str) -> Column:
    s = F.upper(rx.col(c))
    reserved = s.isin("99999999R", "00000001R", "00000000T")
    return _is(s, f"[0-9]{{8}}[{LETTERS}]") & ~reserved & (F.substring(s, 9, 1) == _control(s))


def is_valid_nie(c: Column | str) -> Column:
    s = F.upper(rx.col(c))
    return _is(s, f"[XYZ][0-9]{{7}}[{LETTERS}]") & (F.substring(s, 9, 1) == _control(s))


def is_valid_cif(c: Column | str) -> Column:
    """By the plain sum of its digits; another rule than nif_parse has."""
    s = F.upper(rx.col(c))
    rest = D.weighted(s, [1] * 7, 1) % 10
    last, first = F.substring(s, 9, 1), F.substring(s, 1, 1)
    good = F.when(first.isin(*"ABCDEFGHJ"), last == rest.cast("string")).otherwise(last == D.pick(D.ALPHABET, rest))
    return _is(s, "[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]") & good


def validate_spanish_nif(kind: str, c: Column | str) -> Column:
    kinds = {"DNI": is_valid_dni, "NIE": is_valid_nie, "CIF": is_valid_cif}
    if kind.upper() not in kinds:
        raise ValueError(f"kind must be one of {sorted(kinds)}")
    return kinds[kind.upper()](c)


def european_nif(c: Column | str, find_letter: bool = False) -> Column:
    """Struct (type, country, code, value) of a European tax number, NULL if it is none. Without a
    known prefix it is taken for Spanish; for others only the start must fit."""
    raw = F.upper(F.replace(rx.col(c), F.lit(" "), F.lit("")))
    make = lambda t, country, cc, v: F.struct(t.alias("type"), F.lit(country).alias("country"), F.lit(cc).alias("code"), v.alias("value"))

    def found(s: Column) -> Column:
        code, value = F.substring(s, 1, 2), F.substring(s, F.lit(3), F.length(s))
        lettered = rx.let(value, lambda v: F.when(_is(v, "[0-9]{7,8}"), nif_letter(v)).otherwise(v)) if find_letter else value

        def spanish(v: Column) -> Column:
            kind = F.when(is_valid_dni(v), "DNI").when(is_valid_nie(v), "NIE").when(is_valid_cif(v), "CIF")
            return F.when(kind.isNotNull(), make(kind, "SPAIN", "ES", v))

        out = F.when(code == "ES", rx.let(nif_parse(lettered), spanish))
        for cc, (pattern, country) in _NATIONAL.items():
            out = out.when(F.rlike(s, F.lit(f"^{cc}{pattern}")), make(F.lit("NIF"), country, cc, s if cc in ("PT", "IT", "EL") else value))
        return out

    tagged = rx.let(raw, lambda s: F.when(F.substring(s, 1, 2).isin(_CODES), s).otherwise(F.concat(F.lit("ES"), s)))
    return F.when(F.length(rx.col(c)) > 0, rx.let(tagged, found))


def is_valid_ssn(c: Column | str) -> Column:
    s = _digits(c)
    return F.rlike(s, F.lit("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))


def _not_uniform(s: Column, n: int) -> Column:
    return _is(s, f"[0-9]{{{n}}}") & (F.replace(s, F.substring(s, 1, 1), F.lit("")) != "")


def is_valid_cpf(c: Column | str) -> Column:
    return rx.let(_digits(c), _cpf)


def _cpf(s: Column) -> Column:
    check = lambda n: D.weighted(s, list(range(n + 1, 1, -1))) * 10 % 11 % 10
    return _not_uniform(s, 11) & D.digit_at(s, 9, check(9)) & D.digit_at(s, 10, check(10))


def is_valid_cnpj(c: Column | str) -> Column:
    return rx.let(_digits(c), _cnpj)


def _cnpj(s: Column) -> Column:
    def check(n: int) -> Column:
        rest = D.weighted(s, ([6, 5, 4, 3, 2] + list(range(9, 1, -1)))[13 - n :]) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest)

    return _not_uniform(s, 14) & D.digit_at(s, 12, check(12)) & D.digit_at(s, 13, check(13))


def is_valid_bsn(c: Column | str) -> Column:
    s = _digits(c)
    return _is(s, "[0-9]{9}") & (F.pmod(D.weighted(s, [*range(9, 1, -1), -1]), F.lit(11)) == 0)


def is_valid_codice_fiscale(c: Column | str) -> Column:
    s = F.upper(F.trim(rx.col(c)))
    odd = F.array(*map(F.lit, (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)))
    value = lambda k: F.instr(F.lit(D.ALPHABET), F.translate(F.substring(s, k + 1, 1), "0123456789", "ABCDEFGHIJ"))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at(odd, value(k)), F.lit(0)) if k % 2 == 0 else value(k) - 1 for k in range(15)])
    shape = _is(s, "[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]")
    return _false(s, F.when(shape, F.substring(s, 16, 1) == D.pick(D.ALPHABET, total % 26)))


def is_valid_curp(c: Column | str) -> Column:
    return _is(F.upper(F.trim(rx.col(c))), "[A-Z]{4}[0-9]{6}[HM][A-Z]{2}[B-DF-HJ-NP-TV-Z]{3}[A-Z0-9][0-9]")


def is_valid_rut(c: Column | str) -> Column:
    s = F.upper(rx.sub(c, r"[.\s-]"))
    rest = 11 - D.reversed_sum(F.substring(s, F.lit(1), F.length(s) - 1), (2, 3, 4, 5, 6, 7)) % 11
    want = F.when(rest == 11, "0").when(rest == 10, "K").otherwise(rest.cast("string"))
    return _false(s, F.when(F.rlike(s, F.lit("^[0-9]+.$")), F.substring(s, -1, 1) == want))


def is_valid_cuil(c: Column | str) -> Column:
    return rx.let(_digits(c), _cuil)


def _cuil(s: Column) -> Column:
    rest = 11 - D.weighted(s, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return _is(s, "[0-9]{11}") & D.digit_at(s, 10, F.when(rest == 11, 0).when(rest == 10, 9).otherwise(rest))


def is_valid_nino(c: Column | str) -> Column:
    s = F.translate(F.upper(rx.col(c)), " -", "")
    return _is(s, "(?!BG|GB|NK|KN|TN|NT|ZZ)[A-Z&&[^DFIQUV]][A-Z&&[^DFIQUVO]][0-9]{6}[A-D]")


def is_valid_portuguese_nif(c: Column | str) -> Column:
    return rx.let(_digits(c), _portuguese_nif)


def _portuguese_nif(s: Column) -> Column:
    rest = D.weighted(s, list(range(9, 1, -1))) % 11
    return _is(s, "[1-9][0-9]{8}") & D.digit_at(s, 8, F.when(rest < 2, 0).otherwise(11 - rest))


def validate_id_document(c: Column | str, country: str) -> Column:
    """By the rules of the country's document; for others by the European tax number."""
    n = F.length(_digits(c))
    rules = {
        "ES": lambda: nif_parse(c).isNotNull(), "US": lambda: is_valid_ssn(c), "NL": lambda: is_valid_bsn(c), "IT": lambda: is_valid_codice_fiscale(c),
        "MX": lambda: is_valid_curp(c), "CL": lambda: is_valid_rut(c), "GB": lambda: is_valid_nino(c), "PT": lambda: is_valid_portuguese_nif(c),
        "BR": lambda: F.when(n == 11, is_valid_cpf(c)).when(n == 14, is_valid_cnpj(c)).otherwise(False),
        "AR": lambda: F.when(n == 11, is_valid_cuil(c)).otherwise(n.isin(7, 8)), "CO": lambda: n.between(6, 10),
    }
    return _false(rx.col(c), rules.get(country.upper(), lambda: european_nif(c).isNotNull())())
