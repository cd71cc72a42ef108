"""Synthetic values as functions of a key: equal keys and seeds give equal values, on any partition
and in any order; no state, no driver loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import digits as D, ids, rx
from ..functions.normalize import strip_accents
from ..locales import LOCALES

_FIRST = {
    "es": "Lucía Hugo Martina Mateo Sofía Leo Paula Daniel Julia Pablo Valeria Álvaro Carmen Adrián Elena", "en": "Olivia Noah Emma Liam Ava Mason Grace Ethan Chloe Henry Ruby Oscar Alice Owen Nora",
    "pt": "Maria João Ana Tiago Beatriz Rafael Inês Diogo Clara Bruno Larissa Caio Letícia Vitor Helena", "fr": "Louise Gabriel Jade Raphaël Alice Louis Chloé Jules Léa Adam Manon Lucas Zoé Hugo Inès",
    "de": "Mia Ben Hanna Paul Lea Felix Lina Jonas Clara Leon Ida Moritz Frieda Emil Greta", "it": "Giulia Leonardo Aurora Lorenzo Sofia Mattia Ginevra Andrea Alice Gabriele Chiara Davide Elisa Marco Sara",
}
_LAST = {
    "es": "García Navarro Ortega Delgado Castro Ortiz Rubio Molina Suárez Iglesias Vidal Cano Prieto Calvo Peña", "en": "Smith Walker Hughes Foster Bennett Reed Cooper Ward Gray Barnes Wells Palmer Hunt Shaw Lane",
    "pt": "Silva Moreira Teixeira Correia Mendes Nunes Barbosa Cardoso Rocha Araújo Pinto Lopes Dias Cruz Neves", "fr": "Martin Girard Bonnet Lambert Fontaine Roussel Vincent Muller Faure Mercier Blanc Guerin Boyer Garnier Chevalier",
    "de": "Müller Krause Lehmann Köhler Herrmann Walter Peters Lang Scholz Möller Weiß Jung Hahn Vogel Keller", "it": "Rossi Conti Greco Marino Gallo Costa Fontana Ferrara Caruso Rinaldi Leone Longo Gentile Martini Serra",
}
_CITY = {
    "es": "Sevilla Zaragoza Málaga Murcia Bilbao Alicante Córdoba Valladolid Vigo Gijón", "en": "Leeds Bristol Austin Denver Boston Portland Cardiff Seattle Glasgow Newark",
    "pt": "Braga Coimbra Faro Recife Manaus Natal Curitiba Salvador Évora Aveiro", "fr": "Lille Nantes Rennes Dijon Angers Toulon Brest Nîmes Tours Limoges",
    "de": "Bremen Dresden Hannover Leipzig Kassel Rostock Mainz Erfurt Kiel Ulm", "it": "Torino Bologna Verona Padova Trieste Parma Modena Pisa Lecce Rimini",
}
_STATE = {
    "es": "Andalucía|Aragón|Asturias|Cantabria|Extremadura|Galicia|Navarra|Baleares|La Rioja|Cataluña", "en": "Ohio|Texas|Oregon|Nevada|Vermont|Kansas|Maine|Utah|Kent|Devon",
    "pt": "Minho|Algarve|Alentejo|Bahia|Paraná|Ceará|Goiás|Acre|Sergipe|Tocantins", "fr": "Bretagne|Normandie|Occitanie|Corse|Picardie|Alsace|Lorraine|Auvergne|Savoie|Limousin",
    "de": "Bayern|Hessen|Sachsen|Saarland|Thüringen|Brandenburg|Niedersachsen|Hamburg|Pfalz|Berlin", "it": "Toscana|Umbria|Liguria|Puglia|Calabria|Sicilia|Sardegna|Veneto|Molise|Marche",
}
_WORDS = "amber basin cedar delta ember frost grove harbor island jungle kettle lantern meadow needle orchard pebble quarry river saddle timber umbrella valley willow yonder zephyr anchor bridge copper dawn echo".split()
_STREET = {"es": "Calle", "en": "Street", "pt": "Rua", "fr": "Rue", "de": "Straße", "it": "Via"}
_POOLS: dict[str, list[str]] = {
    "country": "Spain Mexico Argentina Chile France Germany Italy Portugal Brazil Canada".split(), "job": "Engineer|Teacher|Nurse|Analyst|Architect|Carpenter|Editor|Pharmacist|Chemist|Translator".split("|"),
    "color_name": "Crimson Teal Olive Indigo Coral Salmon Ivory Khaki Plum Azure".split(), "file_extension": "pdf csv txt json png jpg docx xlsx mp3 zip".split(),
    "mime_type": "text/plain text/csv application/pdf application/json image/png image/jpeg audio/mpeg video/mp4".split(), "credit_card_provider": "VISA|Mastercard|American Express|Discover|Maestro".split("|"),
    "cryptocurrency_code": "BTC ETH XRP LTC ADA DOT SOL XMR".split(), "cryptocurrency_name": "Bitcoin Ethereum Ripple Litecoin Cardano Polkadot Solana Monero".split(),
    "prefix": "Mr. Mrs. Ms. Dr. Prof.".split(), "suffix": "Jr. Sr. II III PhD MD".split(), "payment_method": "Cash|Credit card|Debit card|Bank transfer|Direct debit|Cheque|Gift card|Invoice|Mobile wallet|Voucher|Cash on delivery|Instalments".split("|"),
    "order_status": "Draft|Placed|Paid|Packed|Shipped|In transit|Delivered|Returned|Refunded|Cancelled".split("|"),
    "department": "Sales|Finance|Legal|Support|Research|Design|Logistics|Purchasing|Quality|Security|Training|Production|Marketing|Maintenance|Administration".split("|"),
    "product_category": "Garden|Kitchen|Toys|Books|Music|Sports|Beauty|Shoes|Health|Pets|Tools|Office|Travel|Lighting|Bedding|Jewellery|Cameras|Phones|Games|Baby".split("|"),
    "product_material": "Oak|Steel|Linen|Wool|Glass|Bamboo|Leather|Cotton|Ceramic|Brass|Silk|Cork|Marble|Rubber|Copper|Felt|Denim|Granite|Paper|Velvet".split("|"),
    "adjective": "Sturdy Sleek Compact Modern Rustic Light Soft Bright Quiet Smart Classic Handy Elegant Robust Fresh".split(),
    "noun": "Lamp Chair Table Mug Clock Backpack Wallet Shelf Blanket Knife Jacket Keyboard Bottle Mirror Pillow Basket Notebook Speaker Candle Tray".split(),
    "domain": "example.com example.org example.net mail.example post.example".split(), "user_agent": "Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101|Mozilla/5.0 (Windows NT 10.0; Win64) AppleWebKit/537.36|Mozilla/5.0 (Macintosh; Intel Mac OS X 14) Version/17.0".split("|"),
}
_ALNUM, _ALPHA, _HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


class Generator:
    """Columns of fake values for a locale; key is any column (of integers, say) that tells rows apart."""

    def __init__(self, key: Column | str, locale: str = "es_ES", seed: int = 0):
        self.key = F.col(key) if isinstance(key, str) else key
        self.profile = LOCALES.get(locale)
        self.locale, self.seed = locale, seed
        self.lang = self.profile.language if self.profile else locale[:2]
        self.custom: dict[str, list[str] | Column] = {}

    def _h(self, salt: str) -> Column:
        return F.xxhash64(F.lit(self.seed), self.key, F.lit(salt))

    def integer(self, low: int, high: int, salt: str = "int") -> Column:
        return (F.pmod(self._h(salt), F.lit(high - low + 1)) + low).cast("bigint")

    def fraction(self, salt: str = "f") -> Column:
        return F.pmod(self._h(salt), F.lit(1 << 52)) / float(1 << 52)

    def pick(self, values: list[str], salt: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(self._h(salt), F.lit(len(values))) + 1).cast("int"))

    def chars(self, n: int, alphabet: str, salt: str) -> Column:
        if not n:
            return F.lit("")
        hashed = lambda k: F.xxhash64(F.lit(self.seed), self.key, F.lit(salt), k)
        one = lambda k: F.substring(F.lit(alphabet), (F.pmod(hashed(k), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(n)), one))

    def digits(self, n: int, salt: str) -> Column:
        return self.chars(n, "0123456789", salt)

    def weighted(self, values: list[str], weights: list[float], salt: str = "w") -> Column:
        """One of the values, as often as its weight says."""
        if len(values) != len(weights) or not values or min(weights) < 0 or sum(weights) <= 0:
            raise ValueError("as many weights as values, none negative, not all 0")
        u, total, out = self.fraction(salt), 0.0, F.when(F.lit(False), F.lit(""))
        for v, w in zip(values[:-1], weights):
            total += w / sum(weights)
            out = out.when(u < total, F.lit(v))
        return out.otherwise(F.lit(values[-1]))

    def sample(self, values: list[str], count: int, replace: bool = True, salt: str = "s") -> Column:
        if not replace and count > len(values):
            raise ValueError("more than there are")
        if replace:
            return F.array(*[self.pick(values, f"{salt}{k}") for k in range(count)])
        ranked = F.array(*[F.struct(self._h(f"{salt}{k}").alias("h"), F.lit(v).alias("v")) for k, v in enumerate(values)])
        return F.transform(F.slice(F.array_sort(ranked), 1, count), lambda x: x["v"])

    # names and places
    def _pool(self, table: dict[str, str], salt: str) -> Column:
        return self.pick(table.get(self.lang, table["en"]).split(), salt)

    def first_name(self) -> Column:
        return self._pool(_FIRST, "first")

    def last_name(self) -> Column:
        return self._pool(_LAST, "last")

    def name(self) -> Column:
        return F.concat_ws(" ", self.first_name(), self.last_name())

    def city(self) -> Column:
        return self._pool(_CITY, "city")

    def state(self) -> Column:
        return self.pick(_STATE.get(self.lang, _STATE["en"]).split("|"), "state")

    def _plain(self, c: Column) -> Column:
        return F.lower(F.regexp_replace(strip_accents(c), "[^A-Za-z]", ""))

    def username(self) -> Column:
        return F.concat(self._plain(self.first_name()), F.lit("_"), self._plain(self.last_name()), self.digits(2, "user"))

    def userlogin(self) -> Column:
        f, n = self._plain(self.first_name()), self._plain(self.last_name())
        forms = [F.concat(f, F.lit("."), n), F.concat(F.substring(f, 1, 1), n), F.concat(n, F.substring(f, 1, 1)), F.concat(f, self.digits(3, "login")), F.concat(f, F.lit("_"), n), F.concat(n, F.lit("."), f)]
        return F.element_at(F.array(*forms), (F.pmod(self._h("form"), F.lit(6)) + 1).cast("int"))

    def domain_name(self) -> Column:
        return self.pick(_POOLS["domain"], "domain")

    def email(self) -> Column:
        return F.concat(self.username(), F.lit("@"), self.domain_name())

    def phone(self) -> Column:
        p = self.profile
        return F.concat(F.lit(p.phone_prefix + " " if p else ""), F.lit("6"), self.digits((p.phone_min if p else 9) - 1, "phone"))

    def postcode(self) -> Column:
        return F.concat(F.lit("1"), self.digits(max(4, self.profile.postal_digits if self.profile else 5) - 1, "post"))

    def address(self) -> Column:
        return F.concat(F.lit(_STREET.get(self.lang, "Street") + " "), self._pool(_LAST, "street"), F.lit(" "), self.integer(1, 199, "house").cast("string"), F.lit(", "), self.postcode(), F.lit(" "), self.city())

    def company(self) -> Column:
        return F.concat_ws(" ", self._pool(_LAST, "co1"), F.lit("&"), self._pool(_LAST, "co2"), F.lit({"es": "S.L.", "en": "Ltd", "pt": "Lda", "fr": "SARL", "de": "GmbH", "it": "S.r.l."}.get(self.lang, "Ltd")))

    # words
    def word(self) -> Column:
        return self.pick(_WORDS, "word")

    def words(self, n: int = 5) -> Column:
        return F.array(*[self.pick(_WORDS, f"word{k}") for k in range(n)])

    def sentence(self, n: int = 8, salt: str = "") -> Column:
        w = F.concat_ws(" ", *[self.pick(_WORDS, f"sent{salt}{k}") for k in range(n)])
        return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)), F.lit("."))

    def paragraph(self, n: int = 3) -> Column:
        return F.concat_ws(" ", *[self.sentence(8, f"p{k}_") for k in range(n)])

    def text(self, max_chars: int = 200) -> Column:
        return F.rtrim(F.substring(self.paragraph(max(1, max_chars // 40)), 1, max_chars))

    def slug(self) -> Column:
        return F.concat_ws("-", self.words(3))

    # documents and money
    def dni(self) -> Column:
        return rx.let(self.digits(8, "dni"), ids.nif_letter)

    def nie(self) -> Column:
        return rx.let(F.concat(self.chars(1, "XYZ", "nie"), self.digits(7, "nie")), ids.nif_letter)

    def _luhn(self, body: Column) -> Column:
        return rx.let(body, lambda b: F.concat(b, ((10 - D.luhn_sum(b, True) % 10) % 10).cast("string")))

    def credit_card_number(self) -> Column:
        return self._luhn(F.concat(F.lit("4"), self.digits(14, "card")))

    def _mod11(self, body: Column, weights: list[int]) -> Column:
        rest = lambda b: D.weighted(b, weights) % 11
        return rx.let(body, lambda b: F.concat(b, rx.let(rest(b), lambda r: F.when(r < 2, 0).otherwise(11 - r)).cast("string")))

    def cpf(self) -> Column:
        one = self._mod11(F.concat(F.lit("1"), self.digits(8, "cpf")), list(range(10, 1, -1)))
        return self._mod11(one, list(range(11, 1, -1)))

    def cnpj(self) -> Column:
        one = self._mod11(F.concat(F.lit("1"), self.digits(7, "cnpj"), F.lit("0001")), [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
        return self._mod11(one, [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])

    def portuguese_nif(self) -> Column:
        return self._mod11(F.concat(F.lit("2"), self.digits(7, "ptnif")), list(range(9, 1, -1)))

    def rut(self) -> Column:
        rest = lambda b: 11 - D.weighted(b, [3, 2, 7, 6, 5, 4, 3, 2]) % 11
        return rx.let(F.concat(F.lit("1"), self.digits(7, "rut")), lambda b: F.concat(b, F.lit("-"), rx.let(rest(b), lambda r: F.when(r == 11, "0").when(r == 10, "K").otherwise(r.cast("string")))))

    def cuil(self) -> Column:
        rest = lambda b: 11 - D.weighted(b, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
        return rx.let(F.concat(F.lit("20"), self.digits(8, "cuil")), lambda b: F.concat(b, rx.let(rest(b), lambda r: F.when(r == 11, 0).when(r == 10, 9).otherwise(r)).cast("string")))

    def ssn(self) -> Column:
        return F.concat_ws("-", self.integer(100, 665, "ssn1").cast("string"), self.integer(10, 99, "ssn2").cast("string"), self.integer(1000, 9999, "ssn3").cast("string"))

    def nino(self) -> Column:
        return F.concat(self.chars(2, "ABCEHJLMPRSTW", "nino"), self.digits(6, "nino"), self.chars(1, "ABCD", "ninoz"))

    def id_document(self, kind: str | None = None) -> Column:
        """The locale's document, or one of a kind; 12 characters for what it doesn't know."""
        kinds = {"nif": self.dni, "dni": self.dni, "nie": self.nie, "cpf": self.cpf, "cnpj": self.cnpj, "ssn": self.ssn, "nino": self.nino, "rut": self.rut, "cuil": self.cuil, "pt_nif": self.portuguese_nif}
        own = {"es_ES": "nif", "en_US": "ssn", "en_GB": "nino", "pt_BR": "cpf", "pt_PT": "pt_nif", "es_CL": "rut", "es_AR": "cuil"}
        return kinds.get(kind or own.get(self.locale, ""), lambda: self.chars(12, _ALNUM, "doc"))()

    def iban(self) -> Column:
        country = self.profile.iso if self.profile else "ES"
        tail = "".join(str(ord(c) - 55) for c in country) + "00"
        rest = lambda b: F.aggregate(F.split(F.concat(b, F.lit(tail)), ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise((a * 10 + F.instr(F.lit("0123456789"), x) - 1) % 97))
        return rx.let(self.digits(20, "iban"), lambda b: F.concat(F.lit(country), F.lpad((98 - rest(b)).cast("string"), 2, "0"), b))

    def bban(self) -> Column:
        return self.digits(20, "bban")

    def swift(self) -> Column:
        return F.concat(self.chars(4, _ALPHA, "swift"), F.lit(self.profile.iso if self.profile else "ES"), self.chars(2, _ALNUM, "swiftl"))

    def ean13(self) -> Column:
        return rx.let(self.digits(12, "ean"), lambda b: F.concat(b, ((10 - D.weighted(b, [1, 3] * 6) % 10) % 10).cast("string")))

    def ean8(self) -> Column:
        return rx.let(self.digits(7, "ean8"), lambda b: F.concat(b, ((10 - D.weighted(b, [3, 1, 3, 1, 3, 1, 3]) % 10) % 10).cast("string")))

    def isbn13(self) -> Column:
        return rx.let(F.concat(F.lit("978"), self.digits(9, "isbn")), lambda b: F.concat(b, ((10 - D.weighted(b, [1, 3] * 6) % 10) % 10).cast("string")))

    def isbn10(self) -> Column:
        rest = lambda b: (11 - D.weighted(b, list(range(10, 1, -1))) % 11) % 11
        return rx.let(self.digits(9, "isbn10"), lambda b: F.concat(b, rx.let(rest(b), lambda r: F.when(r == 10, "X").otherwise(r.cast("string")))))

    def number(self, low: float = 0, high: float = 999999, decimals: int = 0) -> Column:
        return F.round(low + self.fraction("num") * (high - low), decimals)

    def random_number(self, kind: str = "integer", digits: int = 6, decimals: int = 2, low: float | None = None, high: float | None = None, mask: str | None = None, currency: bool = False) -> Column:
        """A number as a string: integer, float, or by a mask whose # are digits; between low and high, or
        of that many digits; with the locale's separators and, if asked for, its currency's symbol."""
        if kind not in ("integer", "float"):
            raise ValueError("kind is integer or float")
        if mask is not None:
            return self.masked(mask)
        low = (10 ** (digits - 1) if digits > 1 else 0) if low is None else low
        high = 10**digits - 1 if high is None else high
        value = self.number(low, high, decimals if kind == "float" else 0)
        shown = self.localized(value, decimals if kind == "float" else 0) if kind == "float" or currency else value.cast("bigint").cast("string")
        return F.concat(shown, F.lit(" "), self.currency_symbol()) if currency else shown

    def masked(self, mask: str, salt: str = "mask") -> Column:
        """# as digits, ? as letters, anything else as it is."""
        parts = [self.digits(1, f"{salt}{k}") if ch == "#" else self.chars(1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", f"{salt}{k}") if ch == "?" else F.lit(ch) for k, ch in enumerate(mask)]
        return F.concat(*parts) if parts else F.lit("")

    def localized(self, c: Column, decimals: int = 2) -> Column:
        p = self.profile
        return F.translate(F.format_number(c, decimals), ",.", (p.thousands + p.decimal) if p else ",.")

    def price(self, low: float = 1.0, high: float = 1000.0, decimals: int = 2) -> Column:
        return F.concat(F.lit(self.profile.symbol if self.profile else "$"), F.format_number(self.number(low, high, decimals), decimals))

    def currency_code(self) -> Column:
        return F.lit(self.profile.currency if self.profile else "USD")

    def currency_symbol(self) -> Column:
        return F.lit(self.profile.symbol if self.profile else "$")

    # time
    def date_value(self, start: str = "2000-01-01", end: str = "2025-12-31", salt: str = "date") -> Column:
        low, high = sorted((start, end))
        days = F.datediff(F.lit(high).cast("date"), F.lit(low).cast("date"))
        return F.date_add(F.lit(low).cast("date"), F.pmod(self._h(salt), (days + 1).cast("bigint")).cast("int"))

    def date(self, start: str = "2000-01-01", end: str = "2025-12-31", pattern: str | None = None, mask: str | None = None) -> Column:
        """By a pattern of date_format, or a mask of DD, MM, YYYY and YY; else as the locale writes dates."""
        if mask is not None:
            pattern = mask.replace("YYYY", "yyyy").replace("YY", "yy").replace("DD", "dd")
        return F.date_format(self.date_value(start, end), pattern or (self.profile.date_format if self.profile else "yyyy-MM-dd"))

    def date_of_birth(self, low: int = 18, high: int = 80, today: str = "2025-01-01") -> Column:
        day = F.date_add(F.lit(today).cast("date"), -(self.integer(int(low * 365.25), int(high * 365.25), "dob")).cast("int"))
        return F.date_format(day, self.profile.date_format if self.profile else "yyyy-MM-dd")

    def age(self, low: int = 18, high: int = 80) -> Column:
        return self.integer(low, high, "age")

    # net
    def ipv4(self) -> Column:
        return F.concat_ws(".", *[self.integer(1, 254, f"ip{k}").cast("string") for k in range(4)])

    def ipv6(self) -> Column:
        return F.concat_ws(":", *[self.chars(4, _HEX, f"ip6{k}") for k in range(8)])

    def mac_address(self) -> Column:
        return F.concat_ws(":", *[self.chars(2, _HEX, f"mac{k}") for k in range(6)])

    def url(self) -> Column:
        return F.concat(F.lit("https://"), self.domain_name(), F.lit("/"), self.slug())

    def uuid4(self) -> Column:
        h = lambda n, s: self.chars(n, _HEX, f"uuid{s}")
        return F.concat_ws("-", h(8, 1), h(4, 2), F.concat(F.lit("4"), h(3, 3)), F.concat(self.chars(1, "89ab", "uuidv"), h(3, 4)), h(12, 5))

    def password(self, length: int = 12, upper: bool = True, lower: bool = True, digits: bool = True, special: bool = True) -> Column:
        """At least one character of each class that is on, in random order."""
        on = [c for c, ok in ((_ALPHA, upper), (_ALPHA.lower(), lower), ("0123456789", digits), ("!@#$%&*+-_", special)) if ok]
        if not on:
            raise ValueError("no class of characters is on")
        parts = [self.chars(1, on[k] if k < len(on) else "".join(on), f"pw{k}") for k in range(length)]
        mixed = F.array_sort(F.array(*[F.struct(self._h(f"pwo{k}").alias("h"), p.alias("v")) for k, p in enumerate(parts)]))
        return F.concat_ws("", F.transform(mixed, lambda x: x["v"]))

    def file_name(self) -> Column:
        return F.concat(self.word(), F.lit("."), self.pick(_POOLS["file_extension"], "ext"))

    def file_path(self) -> Column:
        return F.concat(F.lit("/"), self.pick(_WORDS, "dir"), F.lit("/"), self.file_name())

    def hex_color(self) -> Column:
        return F.concat(F.lit("#"), self.chars(6, _HEX, "hexc"))

    def rgb_color(self) -> Column:
        return F.concat_ws(",", *[self.integer(0, 255, f"rgb{k}").cast("string") for k in range(3)])

    def latitude(self) -> Column:
        return F.round(self.fraction("lat") * 180 - 90, 6)

    def longitude(self) -> Column:
        return F.round(self.fraction("lon") * 360 - 180, 6)

    def coordinate(self) -> Column:
        return F.concat_ws(", ", self.latitude().cast("string"), self.longitude().cast("string"))

    def license_plate(self) -> Column:
        return F.concat(self.chars(3, _ALPHA, "plate"), F.lit("-"), self.digits(4, "plate"))

    def gender(self, abbreviated: bool = False) -> Column:
        full = {"es": "Mujer|Hombre|Otro", "en": "Female|Male|Other", "pt": "Feminino|Masculino|Outro", "fr": "Femme|Homme|Autre", "de": "Weiblich|Männlich|Divers", "it": "Femmina|Maschio|Altro"}.get(self.lang, "Female|Male|Other")
        c = self.pick(full.split("|"), "gender")
        return F.substring(c, 1, 1) if abbreviated else c

    # goods
    def product_name(self) -> Column:
        return F.concat_ws(" ", self.pick(_POOLS["adjective"], "adj"), self.pick(_POOLS["noun"], "noun"))

    def product_sku(self) -> Column:
        return F.concat_ws("-", self.chars(4, _ALPHA, "sku1"), self.chars(4, _ALNUM, "sku2"), self.digits(4, "sku3"))

    def tracking_number(self) -> Column:
        return F.concat(self.chars(2, _ALPHA, "track"), self.digits(12, "track"), F.lit(self.profile.iso if self.profile else "ES"))

    def invoice_number(self, year: int = 2025) -> Column:
        return F.concat(F.lit(f"INV-{year}-"), self.digits(5, "inv"))

    def product_review(self) -> Column:
        return F.struct(self.integer(1, 5, "rating").alias("rating"), self.sentence(4, "rt").alias("title"), self.paragraph(2).alias("comment"), self.name().alias("author"), self.date().alias("date"), (self.integer(0, 1, "ver") == 1).alias("verified"))

    def product_full(self) -> Column:
        return F.struct(self.product_name().alias("name"), self.pick(_POOLS["product_category"], "cat").alias("category"), self.pick(_POOLS["product_material"], "mat").alias("material"), self.product_sku().alias("sku"), self.price().alias("price"), self.currency_code().alias("currency"), self.ean13().alias("ean"), self.sentence().alias("description"), self.pick(_POOLS["color_name"], "col").alias("color"), self.integer(0, 500, "stock").alias("stock"), self.company().alias("brand"))

    def profile_data(self) -> Column:
        names = "name first_name last_name email phone address city state postcode company job id_document date_of_birth".split()
        return F.struct(*[self.value(n).alias(n) for n in names])

    def credit_card_full(self) -> Column:
        return F.concat_ws("\n", self.pick(_POOLS["credit_card_provider"], "prov"), self.name(), self.credit_card_number(), self.credit_card_expire(), self.credit_card_security_code())

    def credit_card_expire(self) -> Column:
        return F.concat(F.lpad(self.integer(1, 12, "expm").cast("string"), 2, "0"), F.lit("/"), self.integer(26, 35, "expy").cast("string"))

    def credit_card_security_code(self) -> Column:
        return self.digits(3, "cvv")

    def unique_key(self, length: int = 8, alphabet: str = _ALNUM, prefix: str = "", suffix: str = "") -> Column:
        """Different for different integer keys below len(alphabet) ** length: the key times a unit of
        the integers modulo that number, plus the seed, in the alphabet's digits."""
        n = len(alphabet)
        size = n**length
        if size > 10**18:
            raise ValueError("too long for 18 digits")
        unit = next(u for u in range(99_991, 0, -1) if _gcd(u, size) == 1)
        big = lambda v: F.lit(v).cast("decimal(38,0)")
        x = F.pmod(self.key.cast("decimal(18,0)").cast("decimal(38,0)") * big(unit) + big(self.seed), big(size)).cast("bigint")
        digit = lambda k: (F.expr("1") + F.pmod(F.floor(x.cast("decimal(20,0)") / F.lit(n**k).cast("decimal(18,0)")).cast("bigint"), F.lit(n))).cast("int")
        return F.concat(F.lit(prefix), *[F.substring(F.lit(alphabet), digit(k), F.lit(1)) for k in range(length)], F.lit(suffix))

    def autoincrement(self, start: int = 1, step: int = 1, prefix: str = "", suffix: str = "", zfill: int = 0) -> Column:
        n = (self.key.cast("bigint") * step + start).cast("string")
        return F.concat(F.lit(prefix), F.when(F.length(n) < zfill, F.lpad(n, zfill, "0")).otherwise(n) if zfill else n, F.lit(suffix))

    # by name
    def register_custom(self, name: str, source: list[str] | Column) -> None:
        self.custom[name] = source

    def unregister_custom(self, name: str) -> bool:
        return self.custom.pop(name, None) is not None

    def run_custom(self, name: str) -> Column:
        if name not in self.custom:
            raise KeyError(f"no generator {name!r}; there are {self.list_custom()}")
        return self.value(name)

    def list_custom(self) -> list[str]:
        return sorted(self.custom)

    def available_documents(self) -> list[str]:
        """Names of the locale's identity documents."""
        return list(self.profile.documents) if self.profile else []

    def value(self, name: str) -> Column:
        """A generator by its name, a pool, or a registered one."""
        if name in self.custom:
            src = self.custom[name]
            return self.pick(src, name) if isinstance(src, list) else src
        if name in _POOLS:
            return self.pick(_POOLS[name], name)
        fn = getattr(self, name, None)
        if name.startswith("_") or name not in generators() or fn is None:
            raise ValueError(f"unknown generator: {name}")
        return fn()

    def resolve(self, name: str, kind: T.DataType) -> Column:
        """A value for a field by its name and type."""
        if isinstance(kind, T.StructType):
            return F.struct(*[Generator(self._h(f.name), self.locale, self.seed).resolve(f.name, f.dataType).alias(f.name) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            many = F.array(*[Generator(self._h(f"{name}{k}"), self.locale, self.seed).resolve(name, kind.elementType) for k in range(3)])
            return F.slice(many, F.lit(1), self.integer(1, 3, name + "#").cast("int"))
        if isinstance(kind, T.MapType):
            return F.create_map().cast(kind)
        if isinstance(kind, T.StringType):
            alias = ALIASES.get(name.lower(), name.lower())
            return self.value(alias).cast("string") if alias in generators() or alias in _POOLS or alias in self.custom else self.word()
        if isinstance(kind, T.BooleanType):
            return self.integer(0, 1, name) == 1
        if isinstance(kind, T.DateType):
            return self.date_value(salt=name)
        if isinstance(kind, T.TimestampType):
            return (self.date_value(salt=name).cast("timestamp").cast("bigint") + self.integer(0, 86399, name + "t")).cast("timestamp")
        if isinstance(kind, T.BinaryType):
            return F.unhex(self.chars(32, _HEX, name))
        if isinstance(kind, T.NumericType):
            low, high = (18, 80) if name.lower() in ("age", "edad") else (0, 100)
            return (low + self.fraction(name) * (high - low)).cast(kind)
        raise ValueError(f"no values for {kind}")


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


ALIASES = {
    "nombre": "first_name", "apellido": "last_name", "surname": "last_name", "fullname": "name", "full_name": "name", "correo": "email", "mail": "email", "telefono": "phone", "mobile": "phone", "tel": "phone",
    "direccion": "address", "street": "address", "ciudad": "city", "provincia": "state", "pais": "country", "zip": "postcode", "zip_code": "postcode", "codigo_postal": "postcode", "empresa": "company", "dob": "date_of_birth",
    "nif": "id_document", "documento": "id_document", "tarjeta": "credit_card_number", "credit_card": "credit_card_number", "website": "url", "ip": "ipv4", "ip_address": "ipv4", "uuid": "uuid4", "sku": "product_sku", "sexo": "gender", "edad": "age",
}

_NOT = {"integer", "fraction", "pick", "chars", "digits", "weighted", "sample", "value", "resolve", "register_custom", "localized", "date_value", "number", "masked", "unregister_custom", "run_custom", "list_custom", "available_documents"}


def generators() -> list[str]:
    """Names that value() takes."""
    return sorted({n for n in vars(Generator) if not n.startswith("_") and callable(getattr(Generator, n)) and n not in _NOT} | set(_POOLS))


def batch(spark: SparkSession, kind: str, count: int, locale: str = "es_ES", seed: int = 0) -> DataFrame:
    """(id, value): count values of a kind."""
    return spark.range(count).select("id", Generator("id", locale, seed).value(kind).alias("value"))


def fill_schema(spark: SparkSession, schema: T.StructType, count: int, overrides: dict[str, Column | str] | None = None, locale: str = "es_ES", seed: int = 0) -> DataFrame:
    """count rows of a schema: fields by overrides (a column, or a generator's name), by the metadata
    key 'generator', by name, by type."""
    base = spark.range(count)
    cols = []
    for f in schema.fields:
        g = Generator(F.xxhash64(F.col("id"), F.lit(f.name)), locale, seed)
        o = (overrides or {}).get(f.name, f.metadata.get("generator"))
        c = g.resolve(f.name, f.dataType) if o is None else g.value(o).cast(f.dataType) if isinstance(o, str) else o
        cols.append(c.alias(f.name))
    return base.select(*cols)


def replacement(kind: Column, key: Column, locale: str) -> Column:
    """A fake value of a type of personal data for a key."""
    g = Generator(key, locale)
    by = {
        "NAME": g.name(), "EMAIL": g.email(), "PHONE": g.phone(), "ADDRESS": g.address(), "ORGANIZATION": g.company(), "LOCATION": g.city(), "URL": g.url(), "DATE": g.date(),
        "CREDIT_CARD": g.credit_card_number(), "IBAN": g.iban(), "ID_DOCUMENT": g.id_document(), "CURRENCY": g.price(),
    }
    return reduce(lambda a, kv: a.when(kind == kv[0], kv[1]), by.items(), F.when(F.lit(False), F.lit(""))).otherwise(g.word())
