"""The parsing functions bound to a locale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .functions import encoding, extract, ids, names, normalize, reduction, rx
from .functions.language import LanguageNormalizer
from .locales import LOCALES, supported


class TextParser:
    """Every method takes a column and returns one. Unknown locales have a language but no rules of
    a country."""

    def __init__(self, locale: str = "es_ES", separators: str | list[str] | None = None):
        self.locale, self.profile, self.separators = locale, LOCALES.get(locale), separators
        self.language = self.profile.language if self.profile else locale[:2]
        self.normalizer = LanguageNormalizer(self.language)
        self._custom: dict[str, Callable[[Column], Column]] = {}

    def locale_info(self) -> dict:
        return self.profile._asdict() if self.profile else {"code": self.locale, "has_profile": False}

    supported_locales = staticmethod(supported)

    def normalize(self, c, lowercase=True, remove_punctuation=True, remove_accents=True, remove_parentheses_content=False) -> Column:
        out = normalize.remove_parentheses_and_content(c) if remove_parentheses_content else rx.col(c)
        self.normalizer.case_sensitive, self.normalizer.remove_accents = not lowercase, remove_accents
        out = self.normalizer.normalize(out)
        return rx.squeeze(normalize.remove_punctuation_marks(out)) if remove_punctuation else out

    def mask(self, c, *args, **kwargs) -> Column:
        return normalize.mask_text(c, *args, **kwargs)

    def prepare_for_comparison(self, c, aggressive: bool = False) -> Column:
        out = self.normalize(self.remove_articles(self.fix_encoding(c)))
        return self.reduce_phonetic(out, 1) if aggressive else out

    def remove_articles(self, c) -> Column:
        return reduction.remove_articles(c, self.language)

    def fix_encoding(self, c) -> Column:
        return encoding.fix_language(c, self.language)

    def fix_mojibake(self, c, normalize_quotes: bool = False) -> Column:
        return encoding.fix_encoding(c, self.language, normalize_quotes)

    def detect_encoding(self, c) -> Column:
        return encoding.detect_encoding(c, self.language)

    def reduce_phonetic(self, c, strength: int = 1) -> Column:
        return reduction.reduce_letters(c, self.language, strength)

    def raw_string(self, c, accuracy: int = 1) -> Column:
        return self.reduce_phonetic(self.fix_encoding(c), accuracy)

    def extract(self, c, kind: str, pattern: str | None = None) -> Column:
        return extract.extract(c, kind, pattern)

    def extract_phones(self, c, pattern: str | None = None) -> Column:
        found = extract.phones(c, pattern, self.separators)
        if pattern is not None or not self.profile:
            return found
        long = F.filter(found, lambda x: F.length(x) >= self.profile.phone_min)
        return F.when(F.size(long) > 0, long)

    def extract_postal_codes(self, c, pattern: str | None = None) -> Column:
        if pattern is not None or not self.profile or not self.profile.postal_digits:
            return extract.postal_codes(c, pattern)
        return rx.find_all(c, rf"\b\d{{{self.profile.postal_digits}}}\b")

    def extract_ids(self, c, kind: str | None = None) -> Column:
        if not self.profile:
            return F.lit(None).cast("array<string>")
        own = {k.upper(): v for k, v in self.profile.documents.items()}
        return rx.find_all(c, own.get((kind or "").upper(), self.profile.documents[self.profile.document]))

    def tokenize(self, c) -> Column:
        return extract.tokenize(c)

    def validate_id(self, c, kind: str | None = None) -> Column:
        """The valid document (canonical, for Spain), else NULL."""
        c = rx.col(c)
        if not self.profile:
            return F.lit(None).cast("string")
        if self.profile.iso == "ES":
            return F.when(ids.validate_spanish_nif(kind, c), F.upper(F.trim(c))) if kind else ids.nif_parse(c)
        return F.when(ids.validate_id_document(c, self.profile.iso), c)

    def pad_id(self, c) -> Column:
        return ids.nif_padding(c)

    def calculate_id_letter(self, c) -> Column:
        return ids.nif_letter(c)

    def parse_name(self, c) -> Column:
        return names.arrange_fullname(c)

    def parse_company(self, c, legal_forms: list[str] | None = None) -> Column:
        return names.parse_company(c, legal_forms)

    def format_company(self, c, form, fmt: str = "dots") -> Column:
        return names.format_companyname(c, form, fmt)

    def register_custom(self, name: str, fn: Callable[[Column], Column]) -> None:
        if not callable(fn):
            raise TypeError("a function of a column")
        self._custom[name] = fn

    def unregister_custom(self, name: str) -> None:
        self._custom.pop(name, None)

    def run_custom(self, name: str, c) -> Column:
        if name not in self._custom:
            raise ValueError(f"unknown function: {name}")
        return self._custom[name](rx.col(c))

    def list_custom(self) -> list[str]:
        return sorted(self._custom)

    def register_abbreviation(self, pattern: str, expansion: str) -> None:
        self.normalizer.register_abbreviation(self.language, pattern, expansion)

    def register_rule(self, rule: Callable[[Column], Column]) -> None:
        self.normalizer.register_rule(self.language, rule)
