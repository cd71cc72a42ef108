"""Columns against literal examples: one small table for each function."""

import pytest
from pyspark.sql import functions as F

from quillframe.functions import encoding, extract, ids, language, names, normalize, ops, phonetic, readability, reduction, similarity, validate


def values(spark, fn, inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r["y"] for r in df.select("k", fn("x").alias("y")).orderBy("k").collect()]


def pairs(spark, fn, inputs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(inputs)], "k int, a string, b string")
    return [r["y"] for r in df.select("k", fn("a", "b").alias("y")).orderBy("k").collect()]


CASES = [
    (ops.flat_vowels, {"ÁÉÍ ñÑ çß Æœ": "AEI nN css AEoe", "": "", None: ""}),
    (ops.normalize_spaces, {"  John    Smith \n": "John Smith", None: ""}),
    (ops.erase_allspaces, {" a b\tc ": "abc"}),
    (ops.normalize_symbols, {"‘a’ «b» —c– §¥": "'a' \"b\" -c- ºÑ"}),
    (ops.erase_specialchar, {"a-b_c! ñ": "abc ñ"}),
    (ops.string_aZ, {"a1b2 c": "a b c"}),
    (ops.string_aZ09, {"a1-b2 c": "a1 b2 c"}),
    (ops.reorder_comma_fullname, {"García , José, x": "José, x García", "no comma": None}),
    (ops.split_all, {"a,b;c  d": ["a", "b", "c", "d"], "": []}),
    (lambda c: ops.normalize_phone(c, "ES"), {"612 345 678": "+34612345678", "+1 (2)": "+12", "0612": "+34612", " ": " "}),
    (lambda c: ops.normalize_phone(c, "ZZ"), {"612 345": "612345"}),
    (normalize.normalize_text, {"  Hello,   World! ": "hello, world!", "Hi there!": "hi there", "U.S.A": "u.s.a", "": "", " ": "", "'q' \"r\"": "q r"}),
    (lambda c: normalize.normalize_text(c, remove_accents=True), {"José García": "jose garcia"}),
    (lambda c: normalize.prepare_for_comparison(c, True), {"Café (x) [y] Ñandú-1": "cafe nandu 1"}),
    (normalize.strip_quotes, {"a, b \"c\" 'd'": "ab c d"}),
    (normalize.mask_text, {"secret": "s****t", "ab": "ab", "": "", None: ""}),
    (lambda c: normalize.mask_text(c, 2, 2, "#", "-"), {"12-34-56": "12-##-56"}),
    (normalize.title_case, {"o'brien mc-X": "O'Brien Mc-X"}),
    (validate.luhn_checksum, {"7992739871": 3, "a": None}),
    (validate.is_valid_luhn, {"79927398713": True, "7992-7398 714": False, "x": None}),
    (validate.is_valid_iban, {"GB29 NWBK 6016 1331 9268 19": True, "GB29NWBK60161331926818": False, "ES91 2100 0418 4502 0005 1332": True, "12": False}),
    (validate.is_valid_isbn, {"0-306-40615-2": True, "080442957X": True, "9780306406157": True, "9780306406158": False, "1": False}),
    (validate.is_valid_ean, {"5901234123457": True, "96385074": True, "96385075": False}),
    (validate.ean13_check_digit, {"590123412345": "7", "1": None}),
    (lambda c: validate.is_valid_credit_card(c)["network"], {"4111111111111111": "visa", "5500005555555559": "mastercard", "340000000000009": "amex", "4111111111111112": None}),
    (validate.is_valid_vat, {"DE 123456789": True, "ATU12345678": True, "XX1": False, "GBGD123": True}),
    (validate.is_valid_swift_bic, {"DEUTDEFF": True, "deutdeff500": True, "DEUT1EFF": False, "DEUTDEFF5": False}),
    (validate.data_type_inference, {"": "empty", "1": "boolean", "42": "integer", "1_0": "integer", "3.5": "float", "1e5": "float", "nan": "float", "2024-01-15": "date", "a@b.c": "email", "http://x": "url", "x y": "string"}),
    (validate.is_valid_phone_format, {"+34 612-345-678": True, "512345678": False}),
    (validate.email_domain_type, {"a@Gmail.com": "free", "a@yopmail.com": "disposable", "a@b.c": "corporate", "a": "invalid", "a@": "invalid"}),
    (validate.has_mixed_case_anomaly, {"Hello World": False, "hELLo": True, "camelCase": False, "": False}),
    (validate.contains_repeated_words, {"the The cat": True, "the cat the": False, "": False}),
    (validate.homoglyph_risk_score, {"pаypаl": pytest.approx(2 / 6), "": 0.0, "abc": 0.0}),
    (lambda c: validate.detect_mixed_scripts(c), {"aбb1": {"LATIN": ["a", "b"], "CYRILLIC": ["б"]}}),
    (readability.count_syllables, {"beautiful": 3, "example": 3, "programming": 3, "cat": 1, "": 0, "table": 2}),
    (readability.is_placeholder_text, {"TBD ": True, "lorem ipsum dolor": True, "aaaa": True, "real": False, None: True}),
    (readability.is_gibberish, {"xkcd qwrt zzz": True, "the other thing in the rain": False, "ab": True}),
    (readability.text_density_score, {"hello world": 0.9091, "": 0.0}),
    (readability.coleman_liau_index, {"": 0.0, "One two. Three four.": pytest.approx(0.0588 * 375 - 0.296 * 50 - 15.8)}),
    (readability.flesch_reading_ease, {"The cat sat.": pytest.approx(206.835 - 1.015 * 3 - 84.6)}),
    (phonetic.soundex, {"Robert": "R163", "Rupert": "R163", "Ashcraft": "A226", "Tymczak": "T522", "": "0000", "1234": "0000", "A": "A000"}),
    (phonetic.metaphone, {"Smith": "SM0", "Knight": "NT", "phone": "FN", "": "", "Thomas": "0MS"}),
    (lambda c: F.concat_ws("/", phonetic.double_metaphone(c)["primary"], phonetic.double_metaphone(c)["alternate"]), {"Smith": "SM0/XMT", "Thomas": "TMS/TMS", "": "/"}),
    (phonetic.mra_code, {"Byrne": "BYRN", "Mississippi": "MSP", "Catherine": "CTHRN"}),
    (language.detect_language, {"the cat is on the table": "en", "el perro y la casa": "es", "der Hund und die Katze": "de", "xyz abc": "unknown", "": "unknown"}),
    (lambda c: language.LanguageNormalizer("de").normalize(c), {"Straße Über": "strasse ueber", " ": None}),
    (lambda c: language.LanguageNormalizer("en").normalize(c), {"12 Main St. Apt 5": "12 main st. apt 5", "St.Apt": "streetapt"}),
    (lambda c: reduction.remove_articles(c, "fr"), {"L'ami de la maison": "ami maison"}),
    (lambda c: reduction.remove_articles(c, "en"), {"The cat and the hat": "cat hat"}),
    (lambda c: reduction.reduce_letters(c, "es", 1), {"guerra": "jera", "QUESO": "CESO", "Zapato": "Capato"}),
    (lambda c: reduction.reduce_letters(c, "es", 0), {"Ñandú": "Nandu"}),
    (encoding.fix_encoding, {"JosÃ© GarcÃ\xada": "José García", "plain": "plain", None: None, "a\r\nb\x00": "a\nb"}),
    (encoding.has_mojibake, {"JosÃ©": True, "José": False}),
    (ids.nif_parse, {"12345678Z": "12345678Z", "12345678A": None, "X1234567L": "X1234567L", "1234567L": "01234567L", "A58818509": "A58818509", "A58818501": None}),
    (ids.nif_padding, {"123-Z": "00000123Z", "X12L": "X0000012L"}),
    (ids.nif_letter, {"12345678": "12345678Z", "abc": "abc"}),
    (ids.is_valid_dni, {"12345678Z": True, "00000000T": False}),
    (ids.is_valid_cpf, {"529.982.247-25": True, "11111111111": False}),
    (ids.is_valid_cnpj, {"11.222.333/0001-81": True, "11.222.333/0001-82": False}),
    (ids.is_valid_bsn, {"111222333": True, "111222334": False}),
    (ids.is_valid_codice_fiscale, {"RSSMRA85T10A562S": True, "RSSMRA85T10A562T": False, "x": False}),
    (ids.is_valid_rut, {"12.345.678-5": True, "12.345.678-6": False, "1": False}),
    (ids.is_valid_cuil, {"20-12345678-6": True, "20-12345678-7": False}),
    (ids.is_valid_nino, {"AB123456C": True, "BG123456C": False, "DA123456C": False}),
    (ids.is_valid_portuguese_nif, {"123456789": True, "123456788": False}),
    (ids.is_valid_ssn, {"123-45-6789": True, "666-45-6789": False, "123-00-6789": False}),
    (ids.is_valid_curp, {"GODE561231HDFRRN09": True, "x": False}),
    (lambda c: ids.european_nif(c)["code"], {"12345678Z": "ES", "DE123456789": "DE", "FRXX123456789": "FR", "ZZ": None}),
    (names.get_companytype, {"Acme S L U": "SLU", "Acme": None}),
    (lambda c: names.parse_company(c)["form"], {"ACME S.L.": "SL", "ACME SOCIEDAD ANONIMA": "SA", "ASOCIACION X": "ASOCIACION", "ACME": None}),
    (lambda c: names.parse_company(c)["name"], {"ACME S.L.": "ACME"}),
    (lambda c: names.left_replace(c, "a", "b"), {"banana": "bbnana"}),
    (extract.phones, {"call +34 612 345 678 now 12": ["34612345678"], "none": None}),
    (extract.postal_codes, {"28001 x 08002": ["28001", "08002"], "1234": ["1234"], "x": []}),
    (extract.paragraphs, {"a\n\n b \n\n\n": ["a", "b"], " ": None}),
    (lambda c: extract.get_string_between(c, "||"), {"a||b||c": "b", "a||b": "", "": ""}),
    (lambda c: extract.extract(c, "currency"), {" $100": None, "x$50 ": ["$50"]}),
    (lambda c: extract.extract(c, "percentages"), {"50% ": None, "20%x": ["20%"]}),
    (lambda c: extract.extract(c, "emails"), {"a@b.co, c.d@e.org": ["a@b.co", "c.d@e.org"], None: None}),
    (lambda c: extract.extract(c, "from_parentheses"), {"(a) b (c)": ["(a)", "(c)"]}),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_values(spark, k):
    fn, want = CASES[k]
    assert values(spark, fn, list(want)) == list(want.values())


PAIRS = [
    (similarity.levenshtein_score, {("kitten", "sitting"): pytest.approx(4 / 7), ("", ""): 1.0, ("a", ""): 0.0, ("a", None): None}),
    (similarity.jaro_winkler_score, {("MARTHA", "MARHTA"): pytest.approx(0.9611, abs=1e-4), ("a", "a"): 1.0, ("", "a"): 0.0, ("DIXON", "DICKSONX"): pytest.approx(0.8133, abs=1e-4)}),
    (similarity.jaccard_similarity, {("abc", "bcd"): 0.5, ("", ""): 0.0}),
    (similarity.sorensen_dice_coefficient, {("night", "nacht"): 0.25, ("", ""): 0.0, ("a", "b"): 0.0, ("a", "a"): 1.0}),
    (similarity.ratcliff_obershelp_score, {("abcd", "bcde"): 0.75, ("", "a"): 0.0}),
    (lambda a, b: similarity.lcs_score(a, b)["lcs_length"], {("AGGTAB", "GXTXAYB"): 4, ("", "x"): 0}),
    (similarity.hamming, {("karolin", "kathrin"): 3, ("1011101", "1001001"): 2, ("abc", "xyz"): 3, ("a", "ab"): None}),
    (lambda a, b: similarity.similarity(a, b, "soundex")["similarity"], {("Robert", "Rupert"): 1.0}),
    (lambda a, b: similarity.are_equivalent(a, b)["is_match"], {("Smith", "Smyth"): True, ("Smith", "Jones"): False, ("", "x"): False}),
]


@pytest.mark.parametrize("k", range(len(PAIRS)))
def test_pairs(spark, k):
    fn, want = PAIRS[k]
    assert pairs(spark, fn, list(want)) == list(want.values())


def test_lcs_by_table():
    import random

    rng = random.Random(1)
    for _ in range(300):
        s, t = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
        for i, a in enumerate(s):
            for j, b in enumerate(t):
                row[i + 1][j + 1] = row[i][j] + 1 if a == b else max(row[i][j + 1], row[i + 1][j])
        assert similarity.lcs_length(s, t) == row[-1][-1]
