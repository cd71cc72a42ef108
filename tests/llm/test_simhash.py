import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillframe.llm import kernels as K, simhash
from quillframe.llm.components import components


def groups(rows, radius):
    """Groups by brute force over all pairs."""
    ok = [(d, t) for d, t in dict.fromkeys(rows) if t and t.strip()]
    fp = simhash.fingerprints([t for _, t in ok])
    root = list(range(len(ok)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ok)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]).sum(1) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    out = {}
    for i, row in enumerate(ok):
        out.setdefault(find(i), []).append(row)
    return out.values()


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(150):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        rows.append((k, " ".join(base)))
        for c in range(rng.choice([0, 0, 1, 3])):
            w = base.copy()
            for _ in range(rng.randint(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((1000 + 10 * k + c, " ".join(w).upper() if c else " ".join(w) + "."))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "!!!"), (5004, "!!!"), (None, rows[0][1]), (None, "quite alone here"), rows[1], rows[1]]


def test_pairs_are_exact(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, id string")
    want = set()
    for g in groups(rows, simhash.RADIUS):
        kept = min(g, key=lambda r: (r[0] is None, r[0] or 0))
        want |= {(d, kept[0]) for d, t in g if (d, t) != kept}
    assert {tuple(r) for r in simhash.near_duplicates(df).collect()} == want
    left = simhash.drop_near_duplicates(df).collect()
    assert len(left) == len(groups(rows, simhash.RADIUS)) + 3  # NULL and blank texts stay
    assert left[0].asDict().keys() == {"doc_id", "text", "id"}
    assert sum(1 for r in left if r["doc_id"] == rows[1][0]) <= 1


def test_fingerprints_by_the_definition():
    """Every different word votes on every bit; ties are 0."""
    texts = ["The cat, the CAT and a dog 12", "one", "!!! ???", "a b a b c"]
    for t, (lo, hi) in zip(texts, simhash.fingerprints(texts).tolist()):
        words = sorted(set(re.findall(r"[^\W_]+", t.lower()))) or [t]
        prints = []
        for w in words:
            cp, at = K.code_points([w])
            h = K.Spans(cp).hash(at[:-1], at[1:])
            prints.append(int(K.mix(h ^ np.uint64(0x94D049BB133111EB))[0]) << 64 | int(h[0]))
        want = sum(1 << b for b in range(128) if 2 * sum(p >> b & 1 for p in prints) > len(prints))
        assert hi << 64 | lo == want


def test_ids_of_any_type_and_colliding_texts(spark):
    """Rows are told apart by id and whole text, not by a short hash."""
    texts = _colliding(spark)
    for kind, ids in (("long", [1, None, None]), ("string", ["b", None, None]), ("decimal(20,3)", [None, None, None])):
        rows = list(zip(ids, [texts[0], texts[0], texts[1]]))
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        left = simhash.drop_near_duplicates(df).collect()
        assert sorted(r["text"] for r in left) == sorted(texts)
        assert simhash.near_duplicates(df).schema["doc_id"].dataType == df.schema["doc_id"].dataType


def _colliding(spark):
    """Two texts without common words that have equal 32-bit hashes."""
    df = spark.range(300000).select(F.concat(F.lit("only here "), F.col("id") * 7919).alias("t")).withColumn("h", F.hash("t"))
    pair = df.groupBy("h").agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").first()["ts"]
    return pair[:2]


def test_hot_rows(spark):
    """A third of all rows are equal, another third have equal texts."""
    rows = [(7, "the same row again and again")] * 400 + [(1000 + k, "one text under many ids") for k in range(400)] + [(5000 + k, f"text{k * k} word{k} only{k + 3} here{k * 7}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()]
    assert left.count(7) == 1 and sorted(d for d in left if 1000 <= d < 2000) == [1000] and len(left) == 402


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.drop_near_duplicates(df).count() == 0


def test_balls_reach_all():
    rng = np.random.default_rng(2)
    for first, size in simhash.cuts(simhash.BITS, simhash.SEGMENTS):
        lo, hi = rng.integers(0, 1 << 63, 5, dtype=np.uint64), rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        whole = [int(h) << 64 | int(x) for x, h in zip(lo, hi)]
        assert simhash.segment(lo, hi, first, size).tolist() == [(w >> first) & ((1 << size) - 1) for w in whole]
    assert sorted(simhash.ball(range(3), 2)) == [0, 1, 2, 3, 4, 5, 6]


def test_long_text():
    rng = random.Random(4)
    a = " ".join(f"word{rng.randrange(10**6)}" for _ in range(200000))
    x, y = simhash.fingerprints([a, a + " more"])
    assert np.bitwise_count(x ^ y).sum() <= 2


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
