"""Small words out, letters that sound alike as one: six languages, cumulative levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import normalize, rx

_SMALL = {
    "es": "el la los las un una unos unas a al ante bajo con contra de del desde en entre hacia hasta mediante para por sin sobre tras segun versus y e ni o u que porque pero sino mas tambien",
    "en": "the a an to in on at by for with about against between into through during before after above below from of off over under up down and or but nor so yet though although while because since as that",
    "pt": "o a os as um uma uns umas ao aos ante após até com contra de do da dos das desde em no na nos nas entre para por pelo pela pelos pelas sem sob sobre tras e nem ou que porque mas porém todavia contudo também",
    "fr": "le la les un une des l' à au aux avec chez contre dans de du depuis en entre envers hors par parmi pendant pour sans sous sur vers et ou ni mais or donc car que puisque quoique lorsque parce",
    "de": "der die das den dem des ein eine einem einen einer eines an auf aus bei bis durch für gegen hinter in im mit nach neben ohne seit über um unter vor von vom während wegen zu zum zur zwischen und oder aber denn sondern weil dass wenn als obwohl damit doch",
    "it": "il lo la i gli le un uno una l' un' a al allo alla ai agli alle con da dal dallo dalla dai dagli dalle di del dello della dei degli delle fra tra in nel nello nella nei negli nelle per su sul sullo sulla sui sugli sulle secondo senza sopra sotto verso e ed o né ma però anche oppure perché che quando mentre sebbene",
}
_ELIDED = {"fr": "[ldnsj]'", "it": "(?:dell|nell|sull|all|dall|[ld]|un)'"}

#: level rules as "from>to" in order; '-' is nothing.
_RULES = {
    "es": ("RR>R QU>C GÜ>G GU>G LL>Y CH>C MB>M NV>M NM>M H>- Y>I Z>C K>C B>V G>J", "X>S C>S PS>S PT>T CT>T GN>N MN>N TL>L", "Ñ>N Ç>S W>V Q>K PH>F TH>T SCH>S L>R D>T P>B T>D F>J"),
    "en": ("PH>F GH>G WH>W TH>T CH>C SH>S CK>K H>- K>C Z>S X>KS", "C>S Z>S X>S KN>N WR>R MB>M", "W>V Q>K F>V P>B T>D S>Z"),
    "pt": ("RR>R SS>S QU>C GU>G LH>LI NH>NI CH>X H>- Y>I K>C W>V", "X>S Z>S Ç>S C>S PS>S PT>T CT>T GN>N MN>N", "PH>F TH>T SCH>S L>R D>T P>B T>D F>V"),
    "fr": ("OU>U AU>O EAU>O PH>F QU>K GU>G CH>S GN>NI OI>OA AI>E EI>E H>- Y>I K>C W>V", "AN>EN AM>EM IN>EN IM>EM ON>EN SS>S SC>S Ç>S C>S X>S Z>S", "TH>T Œ>E Æ>E Q>K D>T P>B T>D F>V"),
    "de": ("SCH>S CK>K PH>F QU>KV TH>T CH>H RH>R DT>T TZ>Z H>- V>F Y>I", "Z>S C>K X>KS SS>S KN>N GN>N PF>F NG>N NK>N MB>M", "W>V Q>K D>T B>P G>K F>V"),
    "it": ("GLI>LI GN>NI SCE>SE SCI>SI CHI>KI CHE>KE GHI>GI GHE>GE QU>CU CQ>C H>- Y>I K>C W>V J>I X>CS", "SS>S ZZ>Z CC>C LL>L RR>R NN>N TT>T PP>P BB>B MM>M FF>F GG>G Z>S SC>S", "PH>F TH>T D>T P>B T>D G>C V>F"),
}


def small_words(language: str) -> str:
    """Pattern of a language's articles, prepositions and conjunctions; longer ones first."""
    words = sorted(set(_SMALL.get(language, _SMALL["en"]).split()), key=lambda w: (-len(w), w))
    return r"\b(?:" + "|".join(words) + r")\b"


def remove_articles(c: Column | str, language: str = "en") -> Column:
    """Without articles, prepositions and conjunctions, whatever their case."""
    out = rx.col(c)
    if language in _ELIDED:
        out = rx.sub(out, r"\b" + _ELIDED[language], flags="(?iuU)")
    return rx.squeeze(rx.sub(out, small_words(language), flags="(?iuU)"))


def _title(c: Column) -> Column:
    return normalize.title_case(c)


def reduce_letters(c: Column | str, language: str = "en", strength: int = 1) -> Column:
    """Letters without accents (strength 0), and alike-sounding ones as one (1 to 3, cumulative).
    Lower, upper and title case come back; any other case is lowered."""
    src = rx.col(c)
    level = max(0, min(int(strength), 3))
    if level == 0:
        return normalize.strip_accents(src)
    out = F.upper(src)
    if language == "de":
        for a, b in (("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE"), ("ß", "SS")):
            out = F.replace(out, F.lit(a), F.lit(b))
    rules = " ".join(_RULES.get(language, _RULES["en"])[:level]).split()

    def reduced(t: Column) -> Column:
        for rule in rules:
            a, b = rule.split(">")
            t = F.replace(t, F.lit(a), F.lit("" if b == "-" else b))
        return t

    def cased(t: Column) -> Column:
        src, out = t["src"], t["out"]
        letters = rx.has(src, r"\p{L}")
        # most texts are told not to be in title case by their first small word, before one is made of them
        title = letters & ~F.rlike(src, F.lit(r"(?<!\p{L})[a-z]")) & (src == _title(src)) & (src != F.lower(src))
        return F.when(letters & (src == t["upper"]), out).when(title, _title(out)).otherwise(F.lower(out))

    # texts of ASCII alone have no accents
    bare = rx.let(out, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.upper(normalize.strip_accents(t))))
    return rx.let(F.struct(src.alias("src"), F.upper(src).alias("upper"), reduced(bare).alias("out")), cased)
