"""Names of persons and companies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import ops, rx

SUFFIXES = "SLU SAU SL SA SRL SLL SC CB SAC SCA".split()
DEFAULT_FORMS = sorted("SL SA SLU SAU SLL SAL SRL SLP SC CB SCOOP SAD SRLL AIE UTE SCP SCL LTD INC LLC CORP GMBH AG SAS SARL SPA SE NV BV".split(), key=lambda x: (-len(x), x))
_PLAIN_TYPES = "ORGANO DE LA ADMINISTRACION|ENTIDAD NO LUCRATIVA|CORPORACION LOCAL|SUCURSAL EN ESPAÑA|PARTIDO POLITICO|ORGANISMO AUTONOMO|ENTIDAD NO RESIDENTE|ASOCIACION|FUNDACION|CAJA|MUTUA|FONDO".split("|")
_KEYWORDS = "COMUNIDAD DE PROPIETARIOS|COMUNIDAD DE BIENES|ORGANO DE LA ADMINISTRACION|ENTIDAD NO LUCRATIVA|CORPORACION LOCAL|SUCURSAL EN ESPAÑA|PARTIDO POLITICO|ORGANISMO AUTONOMO|ENTIDAD NO RESIDENTE|ASOCIACION|ASSOCIACIO|FUNDACION".split("|")
#: In order; a later one sees what an earlier one wrote.
_PHRASES = (
    ("SOCIEDAD LIMITADA", "SL"), ("SOCIEDAD ANONIMA", "SA"), ("COM PROP", "COMUNIDAD DE PROPIETARIOS"), ("CDAD PROP", "COMUNIDAD DE PROPIETARIOS"), (" ASOC ", " ASOCIACION "), (" ASOC.", " ASOCIACION "),
    ("SOCIEDAD DE RESPONSABILIDAD LIMITADA", "SRL"), ("SOCIEDAD COOPERATIVA", "SCOOP"), ("SOCIEDAD COOP", "SCOOP"), ("S COOP", "SCOOP"), ("SL LABORAL", " SLL "), ("SA DEPORTIVA", "SAD"), ("SL PROFESIONAL", "SLP"), (" SCOOPL", " SCOOP"), (" SCL", " SC"),
)


def erase_lrspaces(c: Column | str) -> Column:
    return rx.sub(c, r"\A\s+|\s+\z")


def left_replace(c: Column | str, old: str, new: str) -> Column:
    """The first occurrence replaced, as it is written."""
    c = rx.col(c)
    at = F.instr(c, old)
    return F.when(at == 0, c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c))))


def get_companytype(c: Column | str) -> Column:
    s = F.upper(ops.erase_allspaces(c))
    return reduce(lambda a, x: a.when(s.endswith(x), x), SUFFIXES, F.when(s == "", F.lit(None)))


def is_company(c: Column | str) -> Column:
    return F.when(rx.col(c).isNotNull(), get_companytype(F.upper(rx.col(c))).isNotNull())


def arrange_fullname(c: Column | str) -> Column:
    return ops.reorder_comma_fullname(c)


def format_name(c: Column | str, allowed: str = "", kind: str = "PERSONA", upper: bool = True) -> Column:
    """Brackets round, separators as spaces, other characters out; persons have letters only."""
    c = rx.col(c)
    out = F.translate(c, "`´{}[]*\"_·,;|\\¬‰½ƒŽœ‹Š˜‡†¥ð§.", "''()()" + " " * 21)
    out = ops.fix_spanish(ops.erase_specialchar(out, allowed), allowed)
    out = (ops.string_aZ if kind == "PERSONA" else ops.string_aZ09)(out, "ºª" + allowed, True)
    out = F.replace(out, F.lit(" + "), F.lit("+"))
    return F.when(c.isNotNull(), F.upper(out) if upper else out)


def parse_company(c: Column | str, legal_forms: list[str] | None = None) -> Column:
    """Struct (name, form) of a company: phrases for legal forms as their letters, the form from the
    end of the name or from a keyword in it; NULL if nothing is left."""
    s = rx.col(c)
    for mark in ("(EXTINGUIDA)", "- EXTINGUIDA", "-EXTINGUIDA", "(EN LIQUIDACION)", " EN LIQUIDACION"):
        s = F.replace(s, F.lit(mark), F.lit(""))
    s = F.concat(format_name(s, "ºª@#$%&=+-/:()¿?¡!'", "COMPANY", True), F.lit(" "))
    s = F.regexp_replace(s, r"^ASOC[ .]", " ASOCIACION ")
    for a, b in _PHRASES:
        s = F.replace(s, F.lit(a), F.lit(b))
    forms = legal_forms or DEFAULT_FORMS

    def parsed(s: Column) -> Column:
        first = lambda t: reduce(lambda a, x: a.when(t.endswith(x), F.lit(x)), forms, F.when(F.lit(False), F.lit("")))
        keyword = reduce(lambda a, x: F.when(F.instr(s, x) > 0, F.lit("ASOCIACION" if x == "ASSOCIACIO" else x)).otherwise(a), _KEYWORDS, F.lit(None).cast("string"))

        def named(form: Column) -> Column:
            # the form's letters may be spaced or dotted: they are cut off from the end
            cut = reduce(lambda a, x: a.when(form == x, F.regexp_replace(s, "".join(f"{ch}[ .()]*" for ch in x) + "$", "")), forms, F.when(F.lit(False), s))
            return rx.let(rx.sub(cut, r"[\s(.]+\z"), lambda name: F.when(form.isNotNull() & (name != "") & F.rlike(s, F.lit("[ .(]")), F.struct(name.alias("name"), form.alias("form"))))

        split = rx.let(rx.let(F.translate(s, " .()", ""), first), named)
        return F.when(s != "", F.coalesce(split, F.struct(s.alias("name"), keyword.alias("form"))))

    return rx.let(erase_lrspaces(s), parsed)


def get_companyname(c: Column | str, form: Column | str) -> Column:
    """Name without its form at the end, in plain letters."""
    c, form = rx.col(c), rx.col(form)
    tail = F.concat(F.lit(" "), form)
    cut = F.when(F.length(form) > 0, F.when(F.endswith(c, tail), F.substring(c, F.lit(1), F.length(c) - F.length(tail))).otherwise(c)).otherwise(c)
    return F.when(c.isNotNull(), ops.flat_vowels(ops.normalize_symbols(ops.normalize_spaces(cut))))


def format_companyname(c: Column | str, form: Column | str, fmt: str = "dots") -> Column:
    """Name and form: 'brackets', 'dots' or 'comma&dots'."""
    c, form = rx.col(c), rx.col(form)
    if fmt not in ("brackets", "dots", "comma&dots"):
        raise ValueError("fmt is brackets, dots or comma&dots")
    dotted = F.when((F.length(form) >= 4) | form.isin("LTD", "INC", "CO"), F.concat(form, F.lit("."))).otherwise(F.regexp_replace(form, "(.)", "$1."))
    shown = F.concat(F.lit("("), form, F.lit(")")) if fmt == "brackets" else dotted
    lead = F.lit(", ") if fmt == "comma&dots" else F.lit(" ")
    plain = F.concat(get_companyname(c, form), F.lit(", "), form)
    return F.when(F.coalesce(form, F.lit("")).isin("", "N/A"), c).when(form.isin(_PLAIN_TYPES), plain).otherwise(F.concat(c, lead, shown))
