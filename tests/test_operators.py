import itertools
import random
import re

import pytest
from pyspark.sql import functions as F, types as T

from quillframe.functions import similarity as S
from quillframe.operators import components, generate, matching, privacy, results, selector


def distance(s, t):
    return matching._distance(s, t)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.85, 1.0])
def test_similarity_pairs_lose_nothing(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 14))).strip() for _ in range(60)]
    words += [w[:3] + rng.choice("xyz") + w[4:] for w in words if len(w) > 4]
    items = list(enumerate(words))
    df = spark.createDataFrame(items, "id long, s string")
    score = lambda a, b: 1.0 if a == b else 0.0 if not a or not b else 1 - distance(a, b) / max(len(a), len(b))
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(items, 2) if score(a, b) >= threshold}
    got = matching.similarity_pairs(df, None, threshold).collect()
    assert {(r["id1"], r["id2"]) for r in got} == want and len(got) == len(want)
    left, right = items[:40], items[40:]
    got = matching.similarity_pairs(spark.createDataFrame(left, df.schema), spark.createDataFrame(right, df.schema), threshold).collect()
    assert sorted((r["id1"], r["id2"]) for r in got) == sorted((i, j) for i, a in left for j, b in right if score(a, b) >= threshold)


def test_best_match(spark):
    targets = spark.createDataFrame([(1, "Smithe"), (2, "nothing like it"), (3, "JONES"), (4, "Jones")], "id long, t string")
    cands = spark.createDataFrame([(1, "Smith"), (2, "Jones"), (3, "Smyth"), (4, "jones")], "id long, c string")
    got = {r["target_id"]: (r["candidate_id"], round(r["score"], 3)) for r in matching.find_best_match(targets, cands, "id", "t", "id", "c", 0.8).collect()}
    assert got == {1: (1, 0.833), 2: (None, 0.0), 3: (2, 1.0), 4: (2, 1.0)}
    ranked = matching.compare_lists(targets, cands, "id", "t", "id", "c", 2, 0.6).where("target_id = 1").orderBy("rank").collect()
    assert [r["candidate_id"] for r in ranked] == [1, 3]


def test_duplicates_and_groups(spark):
    df = spark.createDataFrame([(0, "apple"), (1, "aple"), (2, "banana"), (3, "bananna"), (4, "Apple"), (5, None)], "id long, t string")
    assert {(r["id1"], r["id2"]) for r in matching.detect_duplicates(df, "id", "t", 0.8).collect()} == {(0, 1), (0, 4), (1, 4), (2, 3)}
    groups = {r["id"]: r["group"] for r in matching.find_phonetic_duplicates(df, "id", "t").collect()}
    assert groups[0] == groups[1] == groups[4] == 0 and groups[2] == groups[3] == 2
    exact = {r["id"]: r["group"] for r in matching.find_phonetic_duplicates(df, "id", "t", use_mra=False).collect()}
    assert exact[2] == exact[3] == 2


def test_names_and_tokens(spark):
    df = spark.createDataFrame([("José García", "Jose Garcia"), ("Juan Pérez López", "Juan P. López"), ("Ana", "Luis")], "a string, b string")
    r = df.select(matching.compare_name_bytokens("a", "b")["is_match"].alias("m"), matching.compare_names("a", "b")["is_match"].alias("n")).collect()
    # accents are kept in names: words face each other only if they are equal, or with fuzzy_align alike
    assert [x["m"] for x in r] == [False, True, False] and r[2]["n"] is False
    near = spark.createDataFrame([("Francisco Garcia", "Fransisco Garcia"), ("Ana", "Luis")], "a string, b string")
    both = near.select(*[matching.compare_name_bytokens("a", "b", fuzzy_align=f)["is_match"].alias(f"m{f}") for f in (False, True)]).collect()
    assert [tuple(x) for x in both] == [(False, True), (False, False)]
    t = spark.createDataFrame([("a b c d", "a b d"), ("a b c", "a b"), ("a b", "b a"), ("a b c d", "d b a")], "a string, b string")
    assert [x[0] for x in t.select(matching.compare_tokens("a", "b")).collect()] == [True, False, True, False]
    d = spark.createDataFrame([("a\nb\nc", "a\nB2\nc\nd")], "a string, b string").select(matching.compare_text_detailed("a", "b").alias("d")).first()["d"]
    assert d["lines_changed"] + d["lines_added"] >= 1 and "+++" in d["diff"]
    code = spark.createDataFrame([("x = 1  # one", "x = 1")], "a string, b string").select(matching.compare_code_blocks("a", "b", ignore_comments=True)["structural_similarity"]).first()[0]
    assert code == 100.0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (7, 7)], "a long, b long")
    got = {r["node"]: r["group"] for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40}


TEXT = "Mail ana.ruiz@mail.example or +34 612 345 678, card 4111 1111 1111 1111, 12345678Z, 10.0.0.1, born 01/02/1990."


def test_detection(spark):
    df = spark.createDataFrame([(TEXT,), ("nothing here",), (None,), ("",)], "t string")
    rows = df.select(privacy.Anonymizer("es_ES").detect("t").alias("e")).collect()
    got = [(e["pii_type"], e["text"]) for e in rows[0]["e"]]
    assert got == [("EMAIL", "ana.ruiz@mail.example"), ("PHONE", "+34 612 345 678"), ("CREDIT_CARD", "4111 1111 1111 1111"), ("ID_DOCUMENT", "12345678Z"), ("IP_ADDRESS", "10.0.0.1"), ("DATE", "01/02/1990")]
    assert all(TEXT[e["start"] : e["end"]] == e["text"] for e in rows[0]["e"])
    assert rows[1]["e"] == [] and rows[2]["e"] is None and rows[3]["e"] == []


def test_strategies(spark):
    df = spark.createDataFrame([(TEXT,)], "t string")
    a = privacy.Anonymizer("es_ES")
    out = {s: df.select(a.anonymize_text("t", s)["anonymized"]).first()[0] for s in privacy.STRATEGIES}
    assert out["redact"] == "Mail [EMAIL] or [PHONE], card [CREDIT_CARD], [ID_DOCUMENT], [IP_ADDRESS], born [DATE]."
    assert out["suppress"] == "Mail  or , card , , , born ."
    assert out["mask"].startswith("Mail a*******@****.*** or *******5678, card ************1111, 1*******Z")
    assert out["generalize"].startswith("Mail ***@mail.example or +3...78,") and out["generalize"].endswith("born 1990.")
    assert all("ana.ruiz" not in v for v in out.values())
    twice = spark.createDataFrame([("x@y.example and x@y.example",)], "t string").select(a.anonymize_text("t", "pseudonymize").alias("r")).first()["r"]
    first, second = twice["anonymized"].split(" and ")
    assert first == second and len(twice["replacements"]) == 1
    a.set_strategy("hash", "EMAIL").add_pattern("ticket", r"T-\d+")
    mixed = spark.createDataFrame([("x@y.example T-77",)], "t string").select(a.anonymize_text("t")["anonymized"]).first()[0]
    assert mixed.endswith("[CUSTOM]") and len(mixed.split()[0]) == 12


def test_emails_and_columns(spark):
    df = spark.createDataFrame([("john@example.com", 3), ("a@x.com", None), (None, 1)], "email string, age int")
    assert [r[0] for r in df.select(privacy.obfuscate_email("email")).collect()] == ["j***@example.com", "a@x.com", None]
    out = privacy.Anonymizer(strategy="redact").anonymize_columns(df).collect()
    assert [tuple(r) for r in out] == [("[EMAIL]", 3), ("[EMAIL]", None), (None, 1)]


def test_privacy_measures(spark):
    rows = [("a", 1, 10), ("a", 1, 20), ("a", 1, 10), ("b", 2, 10), ("b", 2, 20)]
    df = spark.createDataFrame(rows, "x string, y int, s int")
    r = privacy.measure_privacy(df, ["x", "y"], ["s"]).first()
    assert (r["k_anonymity"], r["l_diversity"], r["rows"]) == (2, 2, 5) and r["t_closeness"] == pytest.approx(0.1)
    cat = privacy.measure_privacy(df.withColumn("s", F.col("s").cast("string")), ["x", "y"], ["s"]).first()
    assert cat["t_closeness"] == pytest.approx(0.1)
    assert privacy.suppress_classes(df, ["x", "y"], 3).count() == 3
    many = spark.createDataFrame([(f"n{k}", k % 7, k % 3) for k in range(40)], "name string, q int, r int")
    out = privacy.k_anonymize(many, ["name"], ["q", "r"], 5, 0, {"q": [lambda c: (c / 4).cast("int")]})
    assert privacy.measure_privacy(out, ["q", "r"]).first()["k_anonymity"] >= 5 and {r["name"] for r in out.collect()} == {"*"}


def test_generators(spark):
    from quillframe.functions import ids, validate

    df = spark.range(300)
    g = generate.Generator("id", "es_ES", 1)
    checks = {
        "luhn": validate.is_valid_luhn(g.credit_card_number()), "iban": validate.is_valid_iban(g.iban()), "ean": validate.is_valid_ean(g.ean13()), "ean8": validate.is_valid_ean(g.ean8()), "isbn": validate.is_valid_isbn(g.isbn13()), "isbn10": validate.is_valid_isbn(g.isbn10()),
        "dni": ids.nif_parse(g.dni()).isNotNull(), "nie": ids.nif_parse(g.nie()).isNotNull(), "cpf": ids.is_valid_cpf(g.cpf()), "cnpj": ids.is_valid_cnpj(g.cnpj()), "pt": ids.is_valid_portuguese_nif(g.portuguese_nif()), "rut": ids.is_valid_rut(g.rut()), "cuil": ids.is_valid_cuil(g.cuil()),
    }
    for name, c in checks.items():
        assert df.where(~c).count() == 0, name
    keys = df.select(generate.Generator("id", seed=9).unique_key(2).alias("k"))
    assert keys.distinct().count() == 300
    again = [r[0] for r in df.select(generate.Generator("id", "fr_FR", 4).name()).collect()]
    assert again == [r[0] for r in df.repartition(3).orderBy("id").select(generate.Generator("id", "fr_FR", 4).name()).collect()]
    with pytest.raises(ValueError):
        g.value("no_such")


def test_all_generators(spark):
    g = generate.Generator("id", "it_IT")
    row = spark.range(1).select(*[g.value(n).cast("string").alias(n) for n in generate.generators() if n not in ("product_full", "product_review", "profile_data", "words")]).first()
    assert all(v for v in row)


def test_schema(spark):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("inner", T.StructType([T.StructField("city", T.StringType()), T.StructField("n", T.IntegerType())])), T.StructField("d", T.DateType()), T.StructField("x", T.DecimalType(8, 2)), T.StructField("b", T.BinaryType())])
    out = generate.fill_schema(spark, schema, 20, {"name": F.lit("fixed")})
    assert out.count() == 20 and {r["name"] for r in out.collect()} == {"fixed"} and all("@" in r["email"] and len(r["b"]) == 16 for r in out.collect())


def test_selector_and_results(spark):
    df = spark.createDataFrame([("a@b.co", "c@d.co"), ("612 345 678", "699 888 777"), ("AB-12-CD", "AB-13-CE"), ("Juan Moreno", "Luis Romero"), ("12 Main Street is long", "9 Road")], "a string, b string")
    got = [r[0] for r in df.select(selector.detect_use_case("a", "b")).collect()]
    assert got == ["email", "phone", "postal_code", "person_name", "address"]
    assert df.select(selector.get_optimal_config("a", "b")["primary"]).first()[0] == "levenshtein"
    levels = spark.createDataFrame([(1.0,), (0.92,), (0.8,), (0.5,), (None,)], "s double").select(results.confidence_level("s")).collect()
    assert [r[0] for r in levels] == ["perfect", "high", "medium", "low", "no_match"]

    class Fixed:
        def predict_proba(self, x):
            return [[1 - v[0], v[0]] for v in x]

    model = results.ProbabilityModel(Fixed())
    assert df.select(model.predict("a", "b").alias("p"), S.levenshtein_score("a", "b").alias("q")).where("abs(p - q) > 1e-9").count() == 0


def test_shell(spark, tmp_path):
    from quillframe import cli
    from quillframe.config import Config, sample
    from quillframe.sources import io

    (tmp_path / "in.txt").write_text("Ana, ana@x.example\n\nBea;bea\n")
    assert cli.run(["anonymize", str(tmp_path / "in.txt"), str(tmp_path / "out"), "--locale", "en_US"], spark) == 0
    assert sorted(r["result"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Ana, [EMAIL]", "Bea;bea"]
    assert cli.run(["nonsense"], spark) == 2 and cli.run(["compare", str(tmp_path / "none")], spark) == 1
    assert [tuple(r) for r in io.read_pairs(spark, str(tmp_path / "in.txt"), ";").collect()] == [("Bea", "bea")]
    (tmp_path / "c.json").write_text(sample())
    c = Config(file=str(tmp_path / "c.json"), environment={"QUILLFRAME_THRESHOLD": "0.5"}, locale="en_GB").validate()
    assert (c.get("threshold"), c.get("locale"), c.get("strategy")) == (0.5, "en_GB", "redact")
    with pytest.raises(ValueError):
        Config(environment={}, threshold=3.0).validate()


def test_stream(spark, tmp_path):
    from quillframe.streaming import apply

    spark.createDataFrame([(1, TEXT), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "src"))
    stream = apply.with_columns(apply.read_texts(spark, str(tmp_path / "src")), {"n": F.size(privacy.Anonymizer("es_ES").detect("text"))})
    q = apply.to_parquet(stream, str(tmp_path / "sink"), str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    assert {r["doc_id"]: r["n"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()} == {1: 6, 2: 0}


def test_own_comparators_and_reasons(spark):
    c = matching.Comparators()
    c.register("first", lambda a, b: (F.substring(a, 1, 1) == F.substring(b, 1, 1)).cast("double"))
    df = spark.createDataFrame([("apple", "aple"), ("one", "two"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(c.run("first", "a", "b")).collect()] == [1.0, 0.0, 0.0]
    assert c.names() == ["first"] and c.unregister("first") and not c.unregister("first")
    with pytest.raises(KeyError):
        c.run("first", "a", "b")
    with pytest.raises(TypeError):
        c.register("x", 3)
    told = [r["e"] for r in df.select(matching.explained("a", "b").alias("e")).collect()]
    assert [t["reason"] for t in told][1:] == ["no measure is high enough", "empty text"] and told[0]["result"]["is_match"] and told[0]["normalized1"] == "apple"
    r = df.select(results.match_result("a", F.array("b"), "b", F.lit(0.95), 0.9).alias("r"), results.no_match("a", F.array("b")).alias("n"))
    got = r.select(*[results.is_level("r", x).alias(x) for x in ("perfect", "high", "medium", "low")], F.col("n.is_match").alias("m"), results.is_level("n", "low").alias("nl")).first()
    assert got.asDict() == {"perfect": False, "high": True, "medium": False, "low": False, "m": False, "nl": False}


def test_numbers_masks_and_own_generators(spark):
    g = generate.Generator("id", "es_ES", 4)
    row = spark.range(50).select(g.random_number(digits=4).alias("i"), g.random_number("float", low=1, high=9).alias("f"), g.random_number(mask="##-??").alias("m"), g.random_number(currency=True).alias("c"), g.date(mask="DD.MM.YYYY").alias("d"), g.state().alias("s"), g.city().alias("t")).collect()
    assert all(1000 <= int(r["i"]) <= 9999 and "," in r["f"] and re.fullmatch(r"\d\d-[A-Z]{2}", r["m"]) and r["c"].endswith("€") and re.fullmatch(r"\d\d\.\d\d\.\d{4}", r["d"]) for r in row)
    assert not {r["s"] for r in row} & {r["t"] for r in row}
    g.register_custom("pet", ["cat", "dog"])
    assert g.list_custom() == ["pet"] and {r[0] for r in spark.range(20).select(g.run_custom("pet")).collect()} == {"cat", "dog"}
    assert g.unregister_custom("pet") and not g.list_custom() and "NIE" in g.available_documents()
    with pytest.raises(KeyError):
        g.run_custom("pet")


def test_nested_records(spark):
    schema = "id long, person struct<email:string,notes:array<string>,home:struct<city:string,rooms:int>>, phones map<string,string>, email array<string>, memo string"
    df = spark.createDataFrame([(1, ("a@b.org", ["x"], ("Lugo", 3)), {"phone": "600"}, ["c@d.org", None], "write to e@f.org"), (2, None, None, None, None)], schema)
    a = privacy.Anonymizer("es_ES", "redact")
    one, two = a.anonymize_records(df).orderBy("id").collect()
    assert one["person"]["email"] == "[EMAIL]" and one["person"]["home"].asDict() == {"city": "[LOCATION]", "rooms": 3} and one["person"]["notes"] == ["x"]
    assert one["email"] == ["[EMAIL]", None] and one["memo"] == "write to e@f.org" and two["person"] is None and two["email"] is None
    assert a.anonymize_records(df, free_text=True).orderBy("id").first()["memo"] == "write to [EMAIL]"


def test_command_line_of_pairs_and_tables(spark, tmp_path, capsys):
    from quillframe import cli

    (tmp_path / "pairs.txt").write_text("Ana,Anna\nred ring,red rings\n")
    (tmp_path / "names.txt").write_text("apple\naple\nbanana\n")
    (tmp_path / "more.txt").write_text("apples\nbananas\n")
    (tmp_path / "r.json").write_text('[{"email": "a@b.org", "more": {"name": "Ana"}}]')
    p = {k: str(tmp_path / f"{k}.txt") for k in ("pairs", "names", "more")}
    for command in cli.PAIR_COMMANDS:
        assert cli.run([command, p["pairs"], "--show", "json"], spark) == 0
    for args in (["find-match", p["names"], "--candidates", p["more"], "--threshold", "0.8"], ["find-matches", p["names"], "--candidates", p["more"], "--threshold", "0.5"], ["phonetic-dups", p["names"]], ["batch", p["names"], "--operation", "soundex"], ["extract", p["names"], "--kind", "all"], ["anonymize-dict", str(tmp_path / "r.json")]):
        assert cli.run([*args, "--show", "summary"], spark) == 0
    for command in (*cli.MADE_COMMANDS, *cli.LISTS):
        assert cli.run([command, "--count", "2", "--show", "quiet"], spark) == 0
    assert cli.run(["find-match", p["names"]], spark) == 2
    capsys.readouterr()
    assert cli.run(["find-match", p["names"], "--candidates", p["more"], "--threshold", "0.8", "--show", "json"], spark) == 0
    assert '"target":"banana"' in capsys.readouterr().out
