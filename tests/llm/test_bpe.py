import random

import pytest

from quillframe.llm import bpe, tokencount

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def vocab():
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        return bpe.loaded(f.read())


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    letters = list("ab 's'tlrevd\n\t\r    é漢字1٣½😀'!?_-\x1c\x85")
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return out + ["", " ", "   ", "'s", "a'll b", " 'sfoo", "a  \n\n b", "x" * 3000, "ab" * 700 + " " * 50, "<|endoftext|>", "don't we'll I'd they'RE"]


def encoded(vocab, ts):
    e, out = bpe.Encoder(vocab), []
    for a, b in bpe.K.batches(ts, 500):
        at, ids = e.encode(ts[a:b])
        out += [ids[at[k] : at[k + 1]].tolist() for k in range(b - a)]
    return out


def test_same_as_reference(vocab, reference):
    ts = texts()
    want = [reference.encode_ordinary(t) for t in ts]
    assert encoded(vocab, ts) == want
    e = bpe.Encoder(vocab)
    assert e.count(ts).tolist() == list(map(len, want))


def test_alone_and_together(vocab):
    for piece in (b"", b"a", b"hello", "naïve".encode(), bytes(range(256)), b"ab" * 200):
        import numpy as np

        counts, flat = vocab.encode_pieces(np.frombuffer(piece + b"x", np.uint8), np.array([0]), np.array([len(piece)]))
        assert flat.tolist() == vocab.merge_alone(piece)
        assert counts[0] == len(flat)


def test_table(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, "naïve", None), (2, None, "y"), (3, "", "z"), (4, "long " * 50000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df)).collect()
    assert [r["decoded"] for r in out] == [r[1] for r in rows]
    assert [r["ids"] is None for r in out] == [False, False, False, True, False, False]
    counts = tokencount.count_tokens(df).collect()
    assert [r["n_tokens"] for r in counts] == [None if r["ids"] is None else len(r["ids"]) for r in out]
    assert [r["ids"] for r in counts] == [r[2] for r in rows]  # other columns pass
    assert bpe.encode(df.limit(0)).count() == 0 and tokencount.count_tokens(df.limit(0)).count() == 0


def test_collisions_and_small_memory(vocab, reference, monkeypatch):
    """Ids are right when hashes collide and when what was kept is forgotten."""
    ts = texts()[:300] + ["hello world it is", "x" * 3000]
    want = [reference.encode_ordinary(t) for t in ts]
    monkeypatch.setattr(bpe, "KEPT", 64)
    assert encoded(vocab, ts) == want
    plain = bpe.K.Spans.hash
    monkeypatch.setattr(bpe.K.Spans, "hash", lambda self, a, b: plain(self, a, b) % 97)
    assert encoded(vocab, ts) == want
    assert bpe.Encoder(vocab).count(ts).tolist() == list(map(len, want))


def test_proof(vocab, reference):
    import numpy as np

    alone = np.unpackbits(np.frombuffer(vocab.prove(), np.uint8))
    for k in list(range(0, len(vocab.tokens), 501)) + [len(vocab.tokens) - 1]:
        try:
            text = vocab.tokens[k].decode()
        except UnicodeDecodeError:
            continue
        assert alone[k] == (vocab.merge_alone(vocab.tokens[k]) == [k])
        if len(reference.encode_ordinary(text)) == 1:
            assert alone[k]


def test_decode_unknown(spark):
    df = spark.createDataFrame([([15496, None, 60000, -1],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df).collect()] == ["Hello���", None, ""]
