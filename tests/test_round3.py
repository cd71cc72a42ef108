"""Tests of the third round's findings: odd values, and how often an expression is evaluated."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.functions import extract, readability, similarity as S
from quillframe.operators import matching
from quillframe.plans import catalog

SF = "/root/testdata/sf0.001"


def evaluated(df, what):
    """How often an expression stands in the plan that runs."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_phrases_are_normalised_once(spark):
    df = spark.createDataFrame([("The red  Ring", "red rings"), ("a", "a"), ("", "x"), (None, "x"), ("É", "e")], "a string, b string")
    out = df.select(matching.compare_phrases("a", "b").alias("r")).select("r.*")
    assert evaluated(out, "translate(") <= 4
    rows = [(r["similarity"], r["is_match"], r["common_words"], r["unique_to_phrase1"]) for r in out.collect()]
    assert rows[0] == (pytest.approx(14 / 18), False, ["red"], ["ring", "the"])
    assert rows[1:] == [(1.0, True, ["a"], []), (0.0, False, [], []), (None, None, None, None), (1.0, True, ["e"], [])]
    assert [tuple(r) for r in df.select(F.sort_array(S.bigrams(F.col("a"))), S.sorensen_dice_coefficient("a", "b")).collect()][1:4] == [([], 1.0), ([], 0.0), (None, None)]


def test_density_rounds_like_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    shares = [(57, 800), (69, 800), (163, 800), (1, 3), (1, 1), (0, 5), (5, 16)]
    df = spark.createDataFrame([(k, "a" * n + " " * (m - n)) for k, (n, m) in enumerate(shares)] + [(99, "é1٣² -")], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(readability.text_density_score("t")).collect()]
    want = [duckdb.connect().execute(f"select round({n} / {m}, 4)").fetchall()[0][0] for n, m in shares]
    assert got == [*want, 0.6667] and want[0] == 0.0712


def test_passwords_by_their_pattern(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "Zq", "1", "23", "!", "@#", "é", " ", "_", "\n", "\r", "٣", "́", "abc1!x", "𝒳"]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", "abc123! x\nabcdef1", "x!!!!!! 1", "!" * 7 + "a 1"]], "t string")
    slow = F.regexp_extract_all("t", F.lit("(?U)" + extract.PATTERNS["passwords"]), F.lit(0))
    got = df.select(extract.extract("t", "passwords").alias("h"), F.when(F.size(slow) > 0, slow).alias("w"), "t").collect()
    assert [r["t"] for r in got if r["h"] != r["w"]] == [] and sum(r["h"] is not None for r in got) > 100
    # a long line whose only sign is its first character: the pattern looked to its end from each word
    long = spark.createDataFrame([("!" + " abcdef1" * 40_000,)], "t string")
    assert long.select(extract.extract("t", "passwords")).first()[0] is None


@pytest.mark.parametrize("kind", sorted(extract._FASTER))
def test_faster_patterns_find_the_same(spark, kind):
    rng = random.Random(kind)
    own = {"emails": ["a@b.co", "x_", "@", ".", "b.org", "%+", "é"], "credit_cards": ["4111 1111", "-2222", "3333"], "social_security": ["123-45-6789", "-"], "cve_ids": ["CVE-2021-1234"], "checksums": ["0a" * 16, "F" * 31], "isbns": ["978030640", "6157", "X"], "nif": ["12345678Z"], "dates": ["1/2/2020", "12-31-99"], "times": ["1:20 PM", "23:59"], "ibans": ["ES76", "0123"], "patient_ids": ["PAT-1"]}.get(kind, [])
    bits = [*own, *own, "AB", "ABCDEF", "12", "3", "45", ".", "/", "-", ":", " ", "x", "é", "É", "_", "٣", "́", "%", "²", "km"]
    df = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))),) for _ in range(1500)], "t string")
    want = F.regexp_extract_all("t", F.lit("(?U)" + extract.PATTERNS[kind]), F.lit(0))
    assert df.where(~F.coalesce(extract.extract("t", kind), F.array().cast("array<string>")).eqNullSafe(want)).limit(3).collect() == []


def test_texts_are_searched_once(spark):
    out = catalog.queries()["extract_isbns_derived"](spark, SF)
    assert evaluated(out, "regexp_extract_all") == 1


def test_counts_by_their_expressions(spark):
    rng = random.Random(5)
    bits = ["The", "cake", "little", "beautiful", "rhythm", "me", "e", "le", "Queue", "I", "é", "naïve", "x1y", ".", "!?", "...", " ", "\n", " ", " ", "　", "\x85", "\x1c", "\x00", "'", "À", "table", "shhhhe", "Aeiouy"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["", " ", ".", "..a", "a", "e", "abce", None, "aé", "b" * 5, "word. " * 400_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    m = readability.counts("t", True)
    w = readability.words("t")
    each = F.transform(w, lambda x: readability.count_syllables(x))
    slow = F.struct(F.size(w), F.length(F.concat_ws("", w)), readability.count_sentences("t"), F.aggregate(each, F.lit(0), lambda a, x: a + x), F.size(F.filter(each, lambda x: x >= 3)), F.size(F.array_distinct(F.transform(w, lambda x: F.lower(x)))))
    rows = df.select("k", m.alias("m"), slow.alias("s")).collect()
    assert [texts[r["k"]] for r in rows if texts[r["k"]] is not None and tuple(r["m"]) != tuple(r["s"])] == []
    assert next(r["m"] for r in rows if texts[r["k"]] is None) is None
    out = df.select(readability.text_complexity_score("t").alias("s")).select("s.*")
    assert len(set(__import__("re").findall(r"run\(t#\d+\)#\d+", out._jdf.queryExecution().executedPlan().toString()))) <= 1


def test_gibberish_reads_a_text_once(spark):
    texts = ["xkcd qwrt zzz", "the other thing in the rain", "ab", "", None, "ÉÉ ñandú İstanbul ΣΑΣ", "Σ1-2", "éa", "thé ére 12 intere", "𝒳𝒳𝒳 ed"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    out = df.select("k", readability.is_gibberish("t").alias("g"))
    assert evaluated(out, "regexp_replace") == 1
    letters = F.lower(F.regexp_replace(F.coalesce("t", F.lit("")), r"\P{L}", ""))
    chars = F.split(letters, "")
    n = F.length(letters)
    pairs = F.filter(F.zip_with(chars, F.slice(chars, 2, 10_000), lambda p, q: F.concat(p, q)), lambda p: p.isin(readability.COMMON_BIGRAMS))
    want = F.struct(n.alias("n"), (n - F.length(F.translate(letters, "aeiou", ""))).alias("vowels"), F.size(pairs).alias("common"), F.size(F.array_distinct(chars)).alias("different"))
    got = df.select(readability._letter_counts(letters).alias("m"), want.alias("w"), "t").where(F.length("t") > 0).collect()
    assert [r["t"] for r in got if tuple(r["m"]) != tuple(r["w"])] == []
    assert [r["g"] for r in out.orderBy("k").collect()][:5] == [True, False, True, True, True]


def test_duplicates_of_a_hot_text(spark):
    """Copies of one text are pairs of short lists; the same id with two texts is no pair."""
    rows = [(k, "red ring") for k in range(1300)] + [(2000 + k, "red rings") for k in range(700)] + [(5, "red rings"), (6, "red ring"), (7, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    out = matching.detect_duplicates(df, "id", "t", 0.85)
    got = out.groupBy("score").agg(F.count("*").alias("n"), F.sum((F.col("id1") < F.col("id2")).cast("int")).alias("m")).orderBy("score").collect()
    a, b = [r[0] for r in rows if r[1] == "red ring"], [r[0] for r in rows if r[1] == "red rings"]
    across = sum(x != y for x in a for y in b)
    within = sum(x < y for v in (a, b) for x in v for y in v)
    assert [(round(r["score"], 4), r["n"], r["m"]) for r in got] == [(0.8889, across, across), (1.0, within, within)]


@pytest.mark.parametrize("block", [4096, 3])
def test_pairs_of_texts_that_share_most_characters(spark, monkeypatch, block):
    """Tries cut at few texts, deep common starts, copies; against brute force."""
    from quillframe.operators import tries

    monkeypatch.setattr(tries, "BLOCK", block)
    monkeypatch.setattr(tries, "DEPTH", 32 if block > 3 else 6)
    rng = random.Random(block)
    left = [f"Supplier#{k:05d}" for k in range(12)] + ["", "a", "a", "a\0", "é"]
    right = [f"Customer#{rng.choice([k, 10 * k]):05d}" for k in range(14)] + ["", "a", "ab", "ba", "a\0", "e"]
    x, y = (spark.createDataFrame(list(enumerate(v)), "id long, s string") for v in (left, right))
    score = lambda a, b: 1.0 if a == b else 0.0 if not a or not b else 1 - matching._distance(a, b) / max(len(a), len(b))
    for t in (0.5, 0.64, 0.8):
        got = sorted((r["id1"], r["id2"], round(r["score"], 9)) for r in matching.similarity_pairs(x, y, t).collect())
        assert got == sorted((i, j, round(s, 9)) for i, a in enumerate(left) for j, b in enumerate(right) if (s := score(a, b)) >= t)


def test_trie_search_by_brute_force():
    from quillframe.operators import tries

    rng = random.Random(1)
    for _ in range(60):
        xs = list({"".join(rng.choice("abc\0é𝒳"[: rng.randint(1, 6)]) for _ in range(rng.randint(1, 9))) for _ in range(15)})
        ys = list({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(15)} | set(xs[:3]))
        most = [rng.randint(0, 4) for _ in xs]
        assert sorted(tries.search(xs, most, ys)) == sorted((x, y, matching._distance(x, y)) for x, d in zip(xs, most) for y in ys if matching._distance(x, y) <= d)
        got = sorted((x, y) for x, y, _ in tries.search(xs, most, [*ys, ""], True))
        assert got == sorted((x, y) for x, d in zip(xs, most) for y in {*ys, ""} if min(matching._distance(x[:i], y) for i in range(len(x) + 1)) <= d)


def test_pairs_are_computed_once(spark):
    """Names are normalised for the Python functions and once more; the rest reads what is known."""
    rows = [("José  García", "JOSE GARCIA"), ("Paco", "Francisco"), ("Fran.", "Francisco"), ("", "x"), (None, "x"), ("Ana", "Ana"), ("Smith", "Smyth"), ("Ana", "Luis")]
    df = spark.createDataFrame(rows * 3, "a string, b string")
    out = df.select(matching.compare_names("a", "b").alias("r")).select("r.*")
    assert evaluated(out, "(?U)[^a-zA-Z") <= 60
    got = [r["how"] for r in out.collect()]
    assert got[:8] == ["similar", "abbreviation", "none", "empty", "none", "exact", "none", "none"]
    d = df.select(matching.compare_text_detailed("a", "b").alias("d")).select("d.*").collect()
    assert d[4]["ratio"] is None and d[5]["opcodes"][0]["operation"] == "equal" and d[:8] == d[8:16]
    p = df.select(matching.find_common_patterns("a", "b").alias("p"))
    assert evaluated(p, "translate(") <= 20
    assert [None if r["p"]["lcs_length"] is None else (r["p"]["lcs_length"], round(r["p"]["similarity"], 3)) for r in p.collect()][3:8] == [(0, 0.0), None, (3, 1.0), (4, 0.8), (0, 0.0)]


def test_pairs_are_spread(spark):
    out = catalog.queries()["compare_names"](spark, SF)
    out.count()
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_reduced_letters_of_each_case(spark):
    from quillframe.functions import reduction

    texts = ["El Queso Ñandú", "EL QUESO", "el queso", "El queso", "Zapato-Chico 1a", "1A", "É", "éa B", "ǅ X", "12", "", None, "Straße ÄÖ", "A'b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    out = df.select("k", reduction.reduce_letters("t", "es", 3).alias("o"))
    assert evaluated(out, "translate(") <= 2 and evaluated(out, "upper(t#") <= 2
    assert [r["o"] for r in out.orderBy("k").collect()] == ['Er Seso Nandu', 'ER SESO', 'er seso', 'er seso', 'sabado-siso 1a', '1A', 'E', 'ea v', 'ǆ s', '12', '', None, 'sdrasse ao', "a'v"]


def test_numbers_are_cleaned_once(spark):
    from quillframe.functions import ids, validate

    df = spark.createDataFrame([("529.982.247-25", "0-306-40615-2"), ("1", ""), (None, None)], "a string, b string")
    out = df.select(ids.is_valid_cpf("a").alias("a"), validate.is_valid_isbn("b").alias("b"))
    assert evaluated(out, "regexp_replace") == 1 and evaluated(out, "translate(") == 1
    assert [tuple(r) for r in out.collect()] == [(True, True), (False, False), (None, None)]
