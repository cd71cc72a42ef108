"""The pipeline against a plain version of each stage, and the entry points."""

import corpus_pipeline
import pytest

from quillframe.llm import bpe, mixing, quality, simhash, suffixes


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    import random

    rng = random.Random(8)
    words = [f"{a}{b}" for a in "the of and to in it is was for on".split() for b in ("", "ra", "lo", "mi", "tek")]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for k in range(80):
        w = [rng.choice(words) + ("" if rng.random() < 0.5 else str(rng.randrange(400))) for _ in range(rng.randint(5, 150))]
        if k % 9 == 0:
            w += passage
        rows.append((k, " ".join(w), rng.choice(["en", "fr"]), rng.choice("aaab"), 0))
    rows += [(100 + k, rows[k][1], "en", "b", 0) for k in range(6)] + [(200, "$$$ ### " * 30, "en", "a", 0), (201, None, None, None, None), (202, "", "en", "a", 0)]
    rows = [(a, b, c, d, None if b is None else len(b)) for a, b, c, d, _ in rows]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cols = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "passage dedup", "mix sources", "bpe"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == cols
        ids = {r["doc_id"] for r in docs.collect()}
        if k == 0:
            assert ids == {r["doc_id"] for r in quality.measure(before).collect() if r["keep"]} and 200 not in ids
        elif k == 1:
            gone = {r["doc_id"] for r in simhash.near_duplicates(before).collect()}
            assert ids == {r["doc_id"] for r in before.collect()} - gone and set(range(100, 106)) & gone
        elif k == 2:
            assert suffixes.repeated_passages(docs).where("is_copy").count() == 0
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        else:
            assert docs.count() == mixing.replicate(before).count()
    result = corpus_pipeline.run(spark, small)
    want = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted((r["doc_id"], r["decoded"]) for r in result.collect()) == want
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        vocab = bpe.loaded(f.read())
    for r in result.collect():
        assert bpe.Encoder(vocab).encode([r["decoded"]])[1].tolist() == r["ids"]


ODD = "row failed keep k1 K2 _row _text _k1 _cuts goes repeated copy _at _ident h ids decoded n_words Text_".split()


def test_odd_tables(spark):
    """NULLs anywhere, ids that are NULL or repeated, equal rows, long and empty texts, columns whose
    names clash with those in use: every stage returns the columns of documents, untouched."""
    import random

    rng = random.Random(3)
    words = [f"{a}{b}" for a in "the of and to in it is was for on".split() for b in ("", "ra", "lo", "mi")] + [f"w{chr(97 + k % 26)}{k}" for k in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, one, two = text(60000), text(90), text(80)
    rows = [(1, one), (1, two), (None, text(70)), (None, text(75)), (2, one + " more"), (3, long), (4, ""), (5, None), (6, " \n\t"), (7, two), (7, two), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)
    made = [(d, t, None if k % 3 else "en", None if k % 4 == 1 else "ab"[k % 2], None if t is None else len(t), *[None if k % 5 == 0 else f"{c}{k}" for c in ODD]) for k, (d, t) in enumerate(rows)]
    for docs in (spark.createDataFrame(made, schema), spark.createDataFrame([], schema)):
        empty = docs.isEmpty()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            kept = out.collect()
            of = {tuple(r[5:]) for r in docs.collect()}
            assert empty == (not kept) and all(tuple(r[5:]) in of for r in kept)  # other columns pass as they are
            docs = spark.createDataFrame(kept, docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert empty or {r["decoded"] for r in last} == {r["text"] for r in docs.collect()}


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)
