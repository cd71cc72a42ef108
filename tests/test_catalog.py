"""Queries against their SQL on the small tables, and the SQL's coverage."""

import os

import pytest

from quillframe.plans import catalog

SF = os.environ.get("QUILLFRAME_SF", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = (
    "text_normalize_text text_reduce_letters_de text_remove_articles_fr text_language_normalize_es value_flesch_reading_ease value_gunning_fog text_complexity value_gibberish similarity_jaro_winkler "
    "similarity_ratcliff_obershelp similarity_mra are_equivalent compare_names compare_lists phonetic_duplicates pii_entities anonymize_mask anonymize_generalize privacy_measures_nulls validate_cnpj validate_rut validate_codice_fiscale"
).split()


@pytest.fixture(scope="module")
def tables():
    if not os.path.exists(f"{SF}/documents.parquet"):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    want = tables.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert got and got == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_most_queries_have_sql():
    queries, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(set(queries) - set(sql)) <= 16
