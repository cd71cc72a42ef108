import random
from collections import defaultdict

import numpy as np
import pytest

from quillframe.llm import frames, repeats, substring, suffixes


def brute(rows, n, key):
    """Words in copies and in first occurrences of repeated windows, by (id, text)."""
    where = defaultdict(list)
    for d, t in dict.fromkeys(rows):
        if t is not None:
            w = t.split()
            for i in range(len(w) - n + 1):
                where[tuple(w[i : i + n])].append((not isinstance(d, int), d if isinstance(d, int) else 0, key[d, t], i, d, t))
    copy, first = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for k, (*_, i, d, t) in enumerate(sorted(places, key=lambda x: x[:4])):
                (copy if k else first)[d, t].update(range(i, i + n))
    return copy, first


def corpus(seed, words=40, docs=30):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 3 else f"w{k}" for k in range(words)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for k in range(docs):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(shared) + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
        if k % 7 == 0:
            w += ["the"] * rng.randint(1, 200) + ["x", "y"] * rng.randint(0, 30)
        rows.append((None if k % 11 == 3 else k, rng.choice([" ", "\n", "  "]).join(w)))
    rows += rows[:2] + [(500, None), (501, ""), (502, "  \n"), (503, rows[0][1])]
    return rows


def row_names(df):
    return {(r["doc_id"], r["text"]): (r["k1"], r["k2"]) for r in df.select("doc_id", "text", *frames.row_key()).collect()}


@pytest.mark.parametrize("seed,n,kind,hot", [(1, 6, "long", None), (2, 20, "string", None), (3, 1, "int", None), (5, 6, "long", 3)])
def test_against_brute_force(spark, monkeypatch, seed, n, kind, hot):
    rows = corpus(seed)
    if hot:
        monkeypatch.setattr(repeats, "HOT", hot)
    if kind == "string":
        rows = [(None if d is None else f"doc-{d}", t) for d, t in rows]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], f"doc_id {kind}, text string, k1 string, _cuts string")
    names = row_names(df)
    by_key = {v: k for k, v in names.items()}
    want_copy, want_first = brute(rows, n, names)
    got_copy, got_first = defaultdict(set), defaultdict(set)
    for r in suffixes._spans(df, "doc_id", "text", n).collect():
        (got_copy if r["copy"] else got_first)[by_key[r["k1"], r["k2"]]].update(range(r["s"], r["e"]))
    assert got_copy == want_copy and got_first == want_first
    got = defaultdict(set)
    for r in substring._spans(df, "doc_id", "text", n).collect():
        got[by_key[r["k1"], r["k2"]]].update(range(r["s"], r["e"]))
    want = defaultdict(set)
    for part in (want_copy, want_first):
        for k, v in part.items():
            want[k] |= v
    assert got == want
    # ids keep their type, and name documents
    ids = {d for d, _ in rows}
    for r in suffixes.repeated_passages(df, min_words=n).collect():
        assert r["doc_id"] in ids and r["first_doc_id"] in ids
    assert {r["doc_id"] for r in substring.repeated_substrings(df, min_words=n).collect()} == {d for d, _ in want}
    # the copies leave the texts, and only these
    left = {(r["doc_id"], r["text"]) for r in suffixes.drop_repeated_passages(df, min_words=n).collect()}
    for d, t in set(rows):
        if t is None or not want_copy.get((d, t)):
            assert (d, t) in left
        else:
            kept = [w for k, w in enumerate(t.split()) if k not in want_copy[d, t]]
            assert not kept or any(x == d and y.split() == kept for x, y in left if y is not None)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeated_passages(df).count() == 0
    assert substring.repeated_substrings(df).count() == 0
    assert suffixes.drop_repeated_passages(df).count() == 0


def test_long_text(spark):
    words = [f"a{k % 9973}b{k % 101}" for k in range(60000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[30000:30100]))], "doc_id long, text string")
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["is_copy"]) for r in suffixes.repeated_passages(df).collect()}
    assert (2, 0, 100, True) in got and (1, 30000, 30100, False) in got
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in substring.repeated_substrings(df).collect()} >= {(2, 0, 100), (1, 30000, 30100)}


def test_merge():
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 7))]
        coded = []
        for keys in runs:
            shared, sizes, rests = suffixes.front_code(keys)
            assert suffixes.front_decode(shared, sizes, rests) == keys
            coded.append((keys, shared.tolist()))
        order, shared = suffixes.merge(coded)
        out = [runs[r][k] for r, k in order]
        assert out == sorted(x for keys in runs for x in keys)
        assert shared == [suffixes.common(a, b, 0) for a, b in zip([b""] + out, out)]


def test_index(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(100):
        seqs = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(rng.integers(1, 6))]
        words, ends = np.concatenate(seqs), np.cumsum([len(s) for s in seqs])
        lens, n = np.diff(ends, prepend=0), int(rng.integers(1, 5))
        seq, pos, size = substring.Index(words, ends, int(words.max()) + 1).matches(words, ends - lens, lens, n)
        got = defaultdict(set)
        for a, b, c in zip(seq.tolist(), pos.tolist(), size.tolist()):
            got[a].update(range(b, b + c))
        where = defaultdict(list)
        for k, s in enumerate(seqs):
            for j in range(len(s) - n + 1):
                where[tuple(s[j : j + n])].append((k, j))
        want = defaultdict(set)
        for places in where.values():
            if len(places) > 1:
                for k, j in places:
                    want[k].update(range(j, j + n))
        assert got == want
        index = substring.Index(words, ends, int(words.max()) + 1)
        monkeypatch.setattr(substring, "PIECE", int(rng.integers(1, 20)))
        at = np.flatnonzero(index.is_word)
        assert (index.statistics(len(seqs))[at] == index.longest(at)).all()
        for a, b, c in zip(*(x.tolist() for x in index.passages(len(lens), n))):
            at = lambda k, j, size: seqs[k][j : j + size].tolist()
            others = [(k, j) for k in range(len(seqs)) for j in range(len(seqs[k])) if (k, j) != (a, b)]
            assert any(at(k, j, c) == at(a, b, c) for k, j in others if j + c <= len(seqs[k]))
            assert not any(at(k, j, c + 1) == at(a, b, c + 1) for k, j in others if j + c < len(seqs[k])) or b + c == len(seqs[a])


def test_index_searches_each_word_once(monkeypatch):
    """Matching statistics take a backward step for each word and no more, of all pieces together."""
    rng = np.random.default_rng(2)
    for n in (3, 60, 3000):
        first = rng.integers(1, n + 1, 700)
        seqs = [first, first[100:650], np.concatenate([first[300:360], rng.integers(1, n + 1, 90), first[340:500]]), np.repeat(first[:1], 150)]
        words, ends = np.concatenate(seqs), np.cumsum([len(s) for s in seqs])
        index, steps = substring.Index(words, ends, n + 1), []
        search = index.search
        monkeypatch.setattr(index, "search", lambda word, lo, hi, search=search, steps=steps: steps.append(len(word)) or search(word, lo, hi))
        found = index.statistics(len(seqs))
        assert sum(steps) == len(words)
        assert sum(k > 0 for k in steps) <= substring.PIECE
        at = np.flatnonzero(index.is_word)
        assert (found[at] == index.longest(at)).all()


@pytest.mark.parametrize("count", [0, 1 << 12, 1 << 22])
def test_index_order(count):
    """Order, shared lengths and next smaller ones, however many words a sort key holds."""
    rng = np.random.default_rng(6)
    for _ in range(20):
        seqs = [rng.integers(1, 5, rng.choice([0, 1, 3, 20, 60])) for _ in range(4)]
        seqs += [s[len(s) // 3 :] for s in seqs] + [np.repeat(1, rng.integers(1, 90))]
        index = substring.Index(np.concatenate(seqs), np.cumsum([len(s) for s in seqs]), max(5, count))
        separators = iter(range(-len(seqs), 0))
        text = [next(separators) if x == 0 else x for x in index.text.tolist()]
        order = sorted(range(len(text)), key=lambda k: text[k:])
        assert index.suffixes.tolist() == order
        lcp = [0, *(next(k for k in range(len(text)) if text[a + k] != text[b + k]) for a, b in zip(order, order[1:])), 0]
        assert index.lcp.tolist() == lcp
        at = np.flatnonzero(index.lcp)
        for k, a, b in zip(at.tolist(), index.smaller(at, 0).tolist(), index.smaller(at, 1).tolist()):
            assert a < k < b and lcp[a] < lcp[k] > lcp[b] and min(lcp[a + 1 : b]) == lcp[k]


def longest_in(rows, n):
    """(text's id, start, end, longest match) of the repeated passages, by brute force."""
    texts = {d: t.split() for d, t in rows}
    places = [(d, i) for d, w in texts.items() for i in range(len(w))]
    places.sort(key=lambda x: texts[x[0]][x[1] :])
    longest = defaultdict(int)
    for (a, i), (b, j) in zip(places, places[1:]):
        size = next((k for k, (x, y) in enumerate(zip(texts[a][i:], texts[b][j:])) if x != y), min(len(texts[a]) - i, len(texts[b]) - j))
        for place in ((a, i), (b, j)):
            longest[place] = max(longest[place], size)
    out = set()
    for d, w in texts.items():
        spans = [(i, i + longest[d, i]) for i in range(len(w)) if longest[d, i] >= n]
        while spans:
            s, e = spans.pop(0)
            most = e - s
            while spans and spans[0][0] <= e:
                x, y = spans.pop(0)
                e, most = max(e, y), max(most, y - x)
            out.add((d, s, e, most))
    return out


@pytest.mark.parametrize("n", [6, 20])
def test_longest_match_is_whole(spark, n):
    """The longest match is the true one, whatever the number of shuffle partitions."""
    rng = random.Random(8)
    some = lambda k: [f"v{rng.randint(0, 3000)}" for _ in range(k)]
    long, other = some(1000), some(400)
    rows = [long, long, some(30) + long[100:700] + some(9) + other, long[650:] + other[50:390], some(60) + other[:200] + ["the"] * 170 + other[200:], other[150:200] + ["the"] * 120 + other[200:260], ["the"] * 300, some(50)]
    rows += [t.split() for _, t in corpus(4, docs=12) if t]
    df = spark.createDataFrame(rows := [(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    want, before = longest_in(rows, n), spark.conf.get("spark.sql.shuffle.partitions")
    assert (0, 0, 1000, 1000) in want
    try:
        for partitions in (3, 16):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert {tuple(r) for r in substring.repeated_substrings(df, min_words=n).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
