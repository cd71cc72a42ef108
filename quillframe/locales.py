"""What the library knows of each locale, in one place."""

from __future__ import annotations

from typing import NamedTuple


class Locale(NamedTuple):
    code: str
    country: str
    language: str
    iso: str
    postal_digits: int
    phone_prefix: str
    phone_min: int
    document: str
    documents: dict[str, str]
    phone: str
    postcode: str
    currency: str
    symbol: str
    date_format: str
    thousands: str = "."
    decimal: str = ","


_S = r"[\s.-]?"
LOCALES: dict[str, Locale] = {
    x.code: x
    for x in (
        Locale("es_ES", "Spain", "es", "ES", 5, "+34", 9, "DNI/NIF", {"DNI/NIF": r"\b\d{8}[A-Z]\b", "NIE": r"\b[X-Z]\d{7}[A-Z]\b"}, rf"(?:\+34{_S})?\b[6-9]\d\d{_S}\d{{3}}{_S}\d{{3}}\b", r"\b(?:0[1-9]|[1-4]\d|5[0-2])\d{3}\b", "EUR", "€", "dd/MM/yyyy"),
        Locale("es_MX", "Mexico", "es", "MX", 5, "+52", 10, "CURP", {"CURP": r"\b[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d\b", "RFC": r"\b[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}\b"}, rf"(?:\+52{_S})?\b\d{{2,3}}{_S}\d{{3,4}}{_S}\d{{4}}\b", r"\b\d{5}\b", "MXN", "$", "dd/MM/yyyy", ",", "."),
        Locale("es_AR", "Argentina", "es", "AR", 4, "+54", 10, "DNI", {"DNI": r"\b\d{7,8}\b", "CUIL": r"\b2[0347]-?\d{7,8}-?\d\b"}, rf"(?:\+54{_S})?\b(?:11|[2-9]\d){_S}\d{{4}}{_S}\d{{4}}\b", r"\b[A-Z]\d{4}[A-Z]{3}\b", "ARS", "$", "dd/MM/yyyy"),
        Locale("es_CO", "Colombia", "es", "CO", 6, "+57", 10, "Cédula", {"Cédula": r"\b\d{6,10}\b"}, rf"(?:\+57{_S})?\b3\d\d{_S}\d{{3}}{_S}\d{{4}}\b", r"\b\d{6}\b", "COP", "$", "dd/MM/yyyy"),
        Locale("es_CL", "Chile", "es", "CL", 7, "+56", 9, "RUT", {"RUT": r"\b\d{1,2}\.?\d{3}\.?\d{3}-?[\dKk]\b"}, rf"(?:\+56{_S})?\b9{_S}\d{{4}}{_S}\d{{4}}\b", r"\b\d{7}\b", "CLP", "$", "dd/MM/yyyy"),
        Locale("en_US", "United States", "en", "US", 5, "+1", 10, "SSN", {"SSN": r"\b\d{3}-\d\d-\d{4}\b", "EIN": r"\b\d\d-\d{7}\b"}, rf"(?:\+1{_S})?\(?\d{{3}}\)?{_S}\d{{3}}{_S}\d{{4}}\b", r"\b\d{5}(?:-\d{4})?\b", "USD", "$", "MM/dd/yyyy", ",", "."),
        Locale("en_GB", "United Kingdom", "en", "GB", 0, "+44", 10, "NINO", {"NINO": r"\b[A-Z&&[^DFIQUV]]{2}\d{6}[A-D]\b"}, rf"(?:\+44{_S})?\b0?\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}\b", r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b", "GBP", "£", "dd/MM/yyyy", ",", "."),
        Locale("pt_BR", "Brazil", "pt", "BR", 8, "+55", 10, "CPF", {"CPF": r"\b\d{3}\.?\d{3}\.?\d{3}-?\d\d\b", "CNPJ": r"\b\d\d\.?\d{3}\.?\d{3}/?\d{4}-?\d\d\b"}, rf"(?:\+55{_S})?\(?\d\d\)?{_S}9?\d{{4}}{_S}\d{{4}}\b", r"\b\d{5}-?\d{3}\b", "BRL", "R$", "dd/MM/yyyy"),
        Locale("pt_PT", "Portugal", "pt", "PT", 7, "+351", 9, "NIF", {"NIF": r"\b[1-9]\d{8}\b"}, rf"(?:\+351{_S})?\b[29]\d{{1,2}}{_S}\d{{3}}{_S}\d{{3,4}}\b", r"\b\d{4}-\d{3}\b", "EUR", "€", "dd/MM/yyyy", " "),
        Locale("fr_FR", "France", "fr", "FR", 5, "+33", 9, "NIR", {"NIR": r"\b[12]\s?(?:\d\d\s?){3}\d{3}\s?\d{3}\s?\d\d\b"}, rf"(?:\+33{_S})?\b0?[1-9](?:{_S}\d\d){{4}}\b", r"\b\d{5}\b", "EUR", "€", "dd/MM/yyyy", " "),
        Locale("de_DE", "Germany", "de", "DE", 5, "+49", 10, "Personalausweis", {"Personalausweis": r"\b[A-Z\d]{10}\b"}, rf"(?:\+49{_S})0?\d{{2,5}}{_S}\d{{4,8}}\b", r"\b\d{5}\b", "EUR", "€", "dd.MM.yyyy"),
        Locale("it_IT", "Italy", "it", "IT", 5, "+39", 9, "Codice Fiscale", {"Codice Fiscale": r"\b[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]\b"}, rf"(?:\+39{_S})0?\d{{2,4}}{_S}\d{{4,8}}\b", r"\b\d{5}\b", "EUR", "€", "dd/MM/yyyy"),
    )
}


def supported() -> dict[str, str]:
    """Code -> country."""
    return {k: v.country for k, v in LOCALES.items()}
