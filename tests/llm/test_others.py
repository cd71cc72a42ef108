"""Quality rules, mixing, languages, licences, media: fixtures against plain Python."""

import io
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import langid, licenses, media, mixing, quality

DUCK = pytest.importorskip("duckdb")


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# --- quality


TEXTS = [None, "", "  \n", "word", "A clean line of the text is here and it is good.\nAnother line of the same kind, as it was.", "$$$ ### the%%% of***", "THE WORDS ARE ALL SHOUTED!! IN THIS!! TEXT!!", "The " * 200, "same line here\n" * 9, "x y | z |", "caf\f\x0bé Ñandú", "- a\n- b\n* c\n• d", "end...\nof…\nlines"]


def test_quality_sql(spark):
    rows = [(k, t, "s", True) for k, t in enumerate(TEXTS)] + [(None, "a the", None, None), (3, "word", "s", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, keep boolean")
    got = quality.measure(df)
    cols = ["doc_id", *quality.MEASURES, "failed", "keep"]
    con = DUCK.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [[r[0], r[1]] for r in rows])
    want = con.execute(f"select {', '.join(cols)} from ({quality.oracle_sql()})").fetchall()
    assert rows_of(got, *cols) == sorted(want, key=repr)
    kept = quality.drop_low_quality(df)
    assert kept.columns == df.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(r["text"] for r in got.select("text", "keep").collect() if r["keep"])
    assert quality.measure(df.limit(0)).count() == 0 == quality.drop_low_quality(df.limit(0)).count()


def test_quality_long(spark):
    df = spark.createDataFrame([(1, "the word " * 60000)], "doc_id long, text string")
    assert quality.measure(df).first()["n_words"] == 120000


def test_quality_is_one_projection(spark):
    """Dropping costs what measuring costs: nothing is computed again for the filter."""
    df = spark.createDataFrame([(1, "a the")], "doc_id long, text string").repartition(2)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert plan(quality.drop_low_quality(df)) == plan(quality.measure(df))


def test_quality_keeps_long_prose(spark):
    """No clean text is dropped for its length alone; repetition is, at any length."""
    rng = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{k}" if k % 4 else "the" for k in range(4000)]
    prose = " ".join(rng.choices(words, k=60000))
    long = " ".join([prose] * 17)
    rows = [(1, prose), (2, long), (3, "the cat sat on a mat " * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long.split()) > 1_000_000 and len(set(prose.split())) / 60000 < 0.15
    assert sorted(r["doc_id"] for r in quality.drop_low_quality(df).select("doc_id").collect()) == [1, 2]
    assert sorted(r["doc_id"] for r in quality.measure(df).where("keep").select("doc_id").collect()) == [1, 2]


# --- mixing


def poisson(u, mean):
    p = c = math.exp(-mean)
    n = 0
    for k in range(1, int(math.ceil(mean + 12 * math.sqrt(mean))) + 41):
        n += u >= c
        p = p * mean / k
        c += p
    return n + (u >= c)


def test_mixing(spark):
    import hashlib

    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(1, 400), rng.choice(["a"] * 30 + ["b", "c", None]), k) for k in range(600)]
    rows += [(None, None, "a", 0), (700, "", "d", 1), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long")
    chars = {}
    for _, t, s, _ in rows:
        chars[s] = chars.get(s, 0) + len(t or "")
    live = {s: n for s, n in chars.items() if n}
    rate = {s: 1.0 * sum(chars.values()) / (len(live) * n) for s, n in live.items()}
    want = []
    for d, t, s, x in rows:
        if s not in rate:
            continue
        parts = max(1, math.ceil(rate[s] / mixing.MEAN))
        n = 0
        for j in range(1, parts + 1):
            ident = f"{mixing.SEED}:{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}:{j}"
            n += poisson(int(hashlib.md5(ident.encode()).hexdigest()[:13], 16) / 2**52, rate[s] / parts)
        want += [(d, t, s, x)] * n
    got = mixing.replicate(df)
    assert got.columns == df.columns and rows_of(got, *df.columns) == sorted(want, key=repr)
    share = {}
    for _, t, s, _ in want:
        share[s] = share.get(s, 0) + len(t or "")
    assert all(0.1 < n / sum(share.values()) < 0.4 for n in share.values())
    assert [r["doc_id"] for r in got.collect()] == [r["doc_id"] for r in got.collect()] != sorted(r[0] or 0 for r in want)
    only = mixing.replicate(df, weights={"b": 2.0, "zz": 1.0})
    assert {r["source"] for r in only.collect()} == {"b"}
    assert mixing.replicate(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(df, weights={"a": -1.0})


def test_mixing_by_shuffle_and_high_rates(spark, monkeypatch):
    rows = [(k, "y" * 3000, "big", "p") for k in range(300)] + [(k, "z", "tiny", "q") for k in range(4)] + [(9, "equal", "big", "r")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Copy string")
    a = rows_of(mixing.replicate(df, copy_col="copy"), "doc_id", "text", "copy")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(mixing.replicate(df, copy_col="copy"), "doc_id", "text", "copy") == a
    assert sum(t == "z" for _, t, _ in a) > 4 * mixing.MEAN
    got = mixing.replicate(df)
    assert got.columns == df.columns
    parts = [r["p"] for r in got.where("text = 'equal'").selectExpr("spark_partition_id() as p").collect()]
    assert len(parts) < 2 or len(set(parts)) > 1 or len(parts) < 20  # equal rows spread


# --- languages


def test_codewords():
    for n in (1, 2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        assert len(code) == n and len({tuple(r) for r in code}) == n
        if n > 1:
            assert (abs(code.sum(0)) < n).all()


def test_languages(spark):
    rng = random.Random(2)
    parts = {"xx": "ka lo mi ta ne".split(), "yy": "zur gre schi pf".split(), "zz": "eau oux ille que".split()}
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(rng.randint(15, 60)))
    rows = [(k, make(parts[x]), x, 1.0) for k in range(300) for x in [rng.choice(list(parts))]]
    rows += [(900, None, "xx", None), (901, "", "yy", None), (902, "123 !!", None, None), (None, make(parts["xx"]), None, 2.0), (903, "kalomi " * 50000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, margin double")
    model = langid.train(df.where("doc_id < 200 or doc_id >= 900"), sample_per_language=50)
    got = langid.identify(df, model).collect()
    held = [r for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 300]
    assert sum(r["lang"] == r["predicted_lang"] for r in held) >= 0.97 * len(held)
    none = [r for r in got if r["doc_id"] in (900, 901, 902)]
    assert all(r["predicted_lang"] is None and r["margin"] is None and r["ambiguous"] for r in none)
    assert [r["predicted_lang"] for r in got if r["doc_id"] == 903] == ["xx"]
    mixed = model.predict([make(parts["xx"]) + " " + make(parts["yy"])])[0]
    assert mixed[1] < np.median([r["margin"] for r in held])
    for few in (df.limit(0), df.where("lang = 'xx'")):
        assert langid.identify(df, langid.train(few)).count() == len(rows)
    # ids play no part, and a hot text is one row of the sample
    nameless = df.withColumn("doc_id", F.lit(None)).unionByName(df.limit(1).crossJoin(spark.range(3000).select()))
    again = langid.train(nameless.where("lang is not null"), sample_per_language=50)
    assert again.languages == ["xx", "yy", "zz"] and langid.sample(nameless, "text", "lang", 50).groupBy("label").count().where("count > 50").isEmpty()
    assert [p[0] for p in again.predict([make(parts[x]) for x in ("xx", "yy", "zz")])] == ["xx", "yy", "zz"]


def test_decoding_by_brute_force():
    """The language is the codeword with the least weighted logistic loss, one bit at a time."""
    rng = np.random.default_rng(4)
    for n in (2, 4, 7):
        code = langid.codewords(n)
        bits = code.shape[1]
        m = langid.Model([f"l{k}" for k in range(n)], code, rng.normal(0, 4, (langid.DIMENSIONS, bits)).astype(np.float32), rng.normal(0, 1, bits), rng.random(bits))
        texts = ["some words here", "x", "été ñandú", "a b c d e f", ""]
        for text, x, (lang, margin, unsure) in zip(texts, langid.features(texts), m.predict(texts)):
            if not text:
                assert (lang, margin, unsure) == (None, None, True)
                continue
            loss = []
            for row in code.tolist():
                total = 0.0
                for k, bit in enumerate(row):
                    z = sum(float(a) * float(b) for a, b in zip(x, m.weights[:, k]) if a) + float(m.bias[k])
                    total += float(m.trust[k]) * math.log1p(math.exp(-abs(bit * z))) + float(m.trust[k]) * max(0.0, -bit * z)
                loss.append(total / sum(m.trust))
            order = sorted(range(n), key=lambda k: loss[k])
            assert lang == f"l{order[0]}" and abs(margin - (loss[order[1]] - loss[order[0]])) < 1e-3 and unsure == (margin < langid.AMBIGUOUS)


# --- licences


def dice(a, b):
    return 2.0 * len(a & b) / (len(a) + len(b))


def brute_licenses(rows, threshold=licenses.THRESHOLD):
    """All runs of consecutive pieces against all templates."""
    grams = lambda w: set(zip(w, w[1:]))
    norm = lambda t: re.findall(r"[^\W_]+", t.lower())
    best = {}
    for k, (_, text) in enumerate(rows):
        pieces = [p for p in map(norm, re.split(r"\n|[.!?][ \t\n\f\r]", text or "")) if p]
        for name, _, template in licenses.TEMPLATES:
            t = norm(template)
            for i in range(len(pieces)):
                w = []
                for p in pieces[i:]:
                    w = w + p
                    if len(w) > len(t) * (2 - threshold) / threshold:
                        break
                    if len(w) > 1 and (score := dice(grams(w), grams(t))) >= threshold:
                        best[k, name] = max(score, best.get((k, name), 0))
    return sorted(((rows[k][0], n, s) for (k, n), s in best.items()), key=repr)


def test_licenses_sql(spark):
    mit, bsd = licenses.TEMPLATES[0][2], licenses.TEMPLATES[3][2]
    cut = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    prose = "Something else is told here, and goes on for a while. Then it ends!\n"
    rows = [
        (1, mit), (2, "Text before.\nReleased under the MIT License.\nText after."), (3, mit.replace(". ", ".\n")), (4, "the software is here"), (5, None), (6, ""), (7, "one"),
        (8, "intro\n\n" + mit.upper() + "\n \t\nend"), (8, "Licensed under CC BY-NC 4.0."), (None, "licensed UNDER cc-by-4.0"), (9, "a\n\n\n" + bsd),
        (2, "Text before.\nReleased under the MIT License.\nText after."), (10, "filler word " * 4000 + "\nThis work is licensed under the GNU General Public License, version 3."),
        (11, prose * 30 + "\n" + cut + "\n\n" + prose * 30), (12, prose * 3 + bsd.replace(": 1.", ":\n\n1.").replace(" 2.", "\n\n2.").replace(" 3.", "\n\n3.").replace("THIS", "\n\nTHIS") + prose * 40),
        (13, prose * 5 + "It goes on. Released under the MIT License. And so on"), (14, "Released under the MIT License.\n" * 60), (15, mit[:520] + prose * 9 + mit[520:]),
    ]
    df = spark.createDataFrame([(d, t, 1.5) for d, t in rows], "doc_id long, text string, score double")
    got = sorted((tuple(r) for r in licenses.find_licenses(df).collect()), key=repr)
    assert got == brute_licenses(rows)
    con = DUCK.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in rows])
    assert got == sorted(con.execute(licenses.oracle_sql()).fetchall(), key=repr)
    assert {(1, "MIT"), (2, "MIT"), (3, "MIT"), (8, "MIT"), (8, "CC-BY-NC-4.0"), (None, "CC-BY-4.0"), (9, "BSD-3-Clause"), (10, "GPL-3.0"), (11, "MIT"), (12, "BSD-3-Clause"), (13, "MIT"), (14, "MIT")} <= {r[:2] for r in got}
    assert {r[2] for r in got if r[0] == 11} == {1.0} and not {4, 5, 6, 7, 15} & {r[0] for r in got}
    assert licenses.find_licenses(df.limit(0)).count() == 0
    names = licenses.find_licenses(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert {r["doc_id"] for r in names.collect()} == {None if r[0] is None else f"d{r[0]}" for r in got}


def test_licenses_of_a_folder(tmp_path):
    (tmp_path / "Own-1.0.txt").write_text(text := "You may do with this thing whatever you want, but tell us about it.\nNothing is promised to anybody, ever.")
    found = licenses.scan(["so\n" + text + "\nand on"], licenses.Templates(licenses.read_templates(str(tmp_path))))
    assert found == [(0, "Own-1.0", 1.0)]


# --- media


def area(x, h, w):
    """Means by brute force over a grid fine enough to have all borders."""
    big = np.repeat(np.repeat(x.astype(float), h, 0), w, 1)
    return big.reshape(h, x.shape[0], w, x.shape[1], -1).mean((1, 3))


def test_resize_and_formats():
    rng = np.random.default_rng(1)
    for h, w, c in ((1, 1, 1), (5, 7, 3), (40, 33, 1), (8, 9, 3)):
        x = rng.integers(0, 256, (h, w, c)).astype(np.uint8)
        assert np.allclose(media.resize(media.integral(x), 6, 4), area(x, 6, 4))
        raw = {1: b"P5", 3: b"P6"}[c] + b"\n# note\n%d %d\n255\n" % (w, h) + x.tobytes()
        plain = {1: b"P2", 3: b"P3"}[c] + b" %d %d 255 " % (w, h) + b" ".join(b"%d" % v for v in x.ravel())
        assert (media.decode(raw) == x).all() and (media.decode(plain) == x).all()
        deep = {1: b"P5", 3: b"P6"}[c] + b"\n%d %d\n65535\n" % (w, h) + (x.astype(">u2") * 257).tobytes()
        assert (media.decode(deep) == x).all()
        bits = (x[:, :, :1] > 127).astype(np.uint8)
        packed = np.packbits(1 - bits[:, :, 0], axis=1).tobytes()
        assert (media.decode(b"P4 %d %d\n" % (w, h) + packed) == bits * 255).all()
        assert (media.decode(b"P1 %d %d\n" % (w, h) + b"".join(b"01"[1 - v : 2 - v] for v in bits.ravel())) == bits * 255).all()
        rgb = np.repeat(x, 3, 2) if c == 1 else x
        for down in (False, True):
            body = b"".join(r.tobytes() + b"\0" * (-len(r.tobytes()) % 4) for r in (rgb[:, :, ::-1] if down else rgb[::-1, :, ::-1]))
            head = b"BM" + (54 + len(body)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + (-h if down else h).to_bytes(4, "little", signed=True) + b"\1\0\x18\0" + b"\0" * 24
            assert (media.decode(head + body) == rgb).all()
    hgt, wid, ch, tile, _ = media.tile(raw)
    assert np.load(io.BytesIO(tile)).shape == (media.TILE, media.TILE, 3) and (hgt, wid, ch) == (8, 9, 3)
    ramp = np.tile(np.arange(0, 90, 10, dtype=np.uint8), (8, 1))[:, :, None]
    assert media.difference_hash(media.integral(ramp)) == -1 and media.difference_hash(media.integral(ramp[:, ::-1])) == 0


def _bmp(w, h, bits, body, palette=b"", packed=0, masks=b""):
    head = 54 + len(masks) + len(palette)
    n = lambda v: v.to_bytes(4, "little", signed=True)
    return b"BM" + n(head + len(body)) + b"\0" * 4 + n(head) + n(40) + n(w) + n(h) + b"\1\0" + bytes([bits, 0]) + n(packed) + b"\0" * 20 + masks + palette + body


def test_bmp_palettes_and_bit_fields():
    rng = np.random.default_rng(3)
    for bits in (1, 4, 8):
        w, h = 11, 5
        colors = rng.integers(0, 256, (1 << bits, 3), dtype=np.uint8)
        index = rng.integers(0, 1 << bits, (h, w), dtype=np.uint8)
        rows = [np.packbits(np.unpackbits(r[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes() for r in index]
        body = b"".join(r + b"\0" * (-len(r) % 4) for r in rows)
        palette = b"".join(bytes([c[2], c[1], c[0], 0]) for c in colors.tolist())
        assert (media.decode(_bmp(w, -h, bits, body, palette)) == colors[index]).all()
    x = rng.integers(0, 256, (3, 4, 3), dtype=np.uint8)
    body = b"".join(bytes([r, g, b, 0]) for r, g, b in x.reshape(-1, 3).tolist())
    masks = b"".join(m.to_bytes(4, "little") for m in (0xFF, 0xFF00, 0xFF0000))
    assert (media.decode(_bmp(4, -3, 32, body, packed=3, masks=masks)) == x).all()
    low = x >> 3
    body = b"".join((int(r) << 10 | int(g) << 5 | int(b)).to_bytes(2, "little") for r, g, b in low.reshape(-1, 3))
    assert (media.decode(_bmp(4, -3, 16, body)) == (low.astype(int) * 255 + 15) // 31).all()
    masks = b"".join(m.to_bytes(4, "little") for m in (0xF800, 0x7E0, 0x1F))
    green = (x[:, :, 1] >> 2).astype(int)
    body = b"".join((int(r) << 11 | int(g) << 5 | int(b)).to_bytes(2, "little") for r, g, b in zip(low[:, :, 0].ravel(), green.ravel(), low[:, :, 2].ravel()))
    assert (media.decode(_bmp(4, -3, 16, body, packed=3, masks=masks))[:, :, 1] == (green * 255 + 31) // 63).all()
    with pytest.raises(ValueError):
        media.decode(_bmp(1, 1, 32, b"\0" * 4, packed=3, masks=b"\5\0\0\0" * 3))


def test_media_table(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["some text " * 50, "x", "", "é" * 100000, None] * 2)] + [(None, "n"), (0, "some text " * 50)], "doc_id long, text string")
    images = media.rendered(docs)
    out = media.tiles(images.withColumn("dhash", images["doc_id"])).collect()
    assert all((r["tile"] is None) == (r["text"] is None) and r["media_error"] is None for r in out)
    for r in out:
        if r["text"]:
            assert r["height"] * r["width"] * (r["channels"] or 1) >= len(r["text"].encode()) or r["width"] == 512
    bad = spark.createDataFrame([(b"P5 3 3 255 ab",), (b"BM",), (b"",), (b"GIF89a",), (b"P5 0 1 255 ",), (None,), (bytearray(b"P2 1 1 5 9"),)], "image binary")
    got = media.tiles(bad).collect()
    assert [r["media_error"] is None for r in got] == [False] * 5 + [True, False] and all(r["tile"] is None for r in got)
    assert media.tiles(bad.limit(0)).count() == 0
