"""Language identification with error-correcting output codes.

Every language has a codeword; each bit of it is predicted by a binary classifier over hashed
character n-grams. Decoding is loss-weighted: the chosen language is the one whose codeword loses
least against all margins, weighted by how well each classifier did on held-out rows. If the next
codeword loses hardly more, the answer is flagged as ambiguous.

The classifiers are trained (logistic regression, here; one task a bit of the code) on at most
`sample_per_language` labelled texts of each language, different ones, chosen by a hash of the text;
everything else reads whole texts of all rows. The sample's features are all that leaves the rows:
DIMENSIONS numbers a text, however long it is, for sample_per_language texts a language.

Defined results: texts that are NULL or have no letter get a NULL language, NULL margin and are
ambiguous. Codewords that lose equally much go to the language that is first in order, with margin 0.
Rows with NULL labels or texts aren't trained on; ids play no part. With one label, all texts get
it; with none, NULL. Equal rows get equal answers, empty tables empty ones; columns of the outputs'
names are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from ..runtime import ship
from . import frames, kernels as K

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 400
#: Languages above which the table of their counts is joined by shuffle instead of sent to all executors.
BROADCAST_LANGUAGES = 10_000
AMBIGUOUS = 0.1


def features(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Square roots of the frequencies of hashed letter 1-, 2- and 3-grams (word ends are blanks);
    rows of Euclidean length 1, or 0 for texts without letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for a, b in K.batches(texts, 1 << 19):
        cp, doc_starts = K.code_points([t.lower() for t in texts[a:b]])
        doc = np.repeat(np.arange(b - a), np.diff(doc_starts))
        letter = K.classes()[cp] == K.LETTER
        keep = letter.copy()
        keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])  # one blank after each word
        c = np.where(letter, cp, 32)[keep].astype(np.uint64)
        doc, letter = doc[keep], letter[keep]
        n = len(c)
        total = np.zeros((b - a) * dimensions, np.float32)
        h = np.zeros(n, np.uint64)
        for order in (1, 2, 3):
            if n < order:
                break
            m = n - order + 1
            h = (h[:m] * np.uint64(0x100000001B3)) ^ (c[order - 1 :] + np.uint64(order << 24))
            slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % dimensions
            ok = (doc[:m] == doc[order - 1 :]) & (letter[:m] | (order > 1))
            total += np.bincount(doc[:m][ok] * dimensions + slot[ok], minlength=len(total)).astype(np.float32)
        x = np.sqrt(total.reshape(b - a, dimensions))
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        out[a:b] = x / np.where(norm == 0, 1, norm)
    return out


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Codes of +1 and -1, a row each: exhaustive up to 5 languages, else random rows kept far apart."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        bits = 2 ** (languages - 1) - 1
        code = np.ones((languages, bits))
        for k in range(bits):
            for row in range(1, languages):
                code[row, k] = 1 if (k + 1) >> (row - 1) & 1 == 0 else -1
        return code
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        if (np.abs(code.sum(0)) == languages).any():
            continue
        near = int(((bits - code @ code.T) / 2 + np.eye(languages) * bits).min())
        if near > apart:
            best, apart = code, near
    return best


class Model:
    """Languages, codewords and the linear classifiers of the code's bits."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def predict(self, texts: list[str], ambiguous: float = AMBIGUOUS):
        """(language or None, margin or None, ambiguous) of each text."""
        out = []
        for lo in range(0, len(texts), 512):
            x = features(texts[lo : lo + 512])
            has = (x > 0).any(1)
            margins = x @ self.weights + self.bias
            # logistic loss of every codeword's bits against the margins
            loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2) / max(self.trust.sum(), 1e-9)
            order = np.argsort(loss, axis=1, kind="stable")
            for k, ok in enumerate(has):
                if not ok or not self.languages:
                    out.append((None, None, True))
                    continue
                gap = float(loss[k, order[k, 1]] - loss[k, order[k, 0]]) if len(self.languages) > 1 else 1.0
                out.append((self.languages[order[k, 0]], gap, gap < ambiguous))
        return out


def fit_bit(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 400, rate: float = 8.0, decay: float = 1e-5) -> tuple[np.ndarray, float, float]:
    """Weights, bias and trust of one bit's classifier: logistic regression of y (+1, -1) on the rows of
    x that aren't held out; these weigh the bit. Deterministic."""
    tx, ty = x[~held], y[~held]
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        g = (-ty / (1 + np.exp(np.clip(ty * (tx @ w.astype(np.float32) + b), -30, 30))) / len(tx)).astype(np.float32)
        vw, vb = 0.9 * vw - rate * (g @ tx + decay * w), 0.9 * vb - rate * float(g.sum())
        w, b = w + vw, b + vb
    right = float((np.sign(x[held] @ w + b) == y[held]).mean()) if held.any() else 1.0
    right = min(max(right, 0.5), 0.999)
    return w.astype(np.float32), b, float(np.log(right / (1 - right)) + 1e-3)


def sample(df: DataFrame, text_col: str, label_col: str, per_language: int) -> DataFrame:
    """(label, h, text): at most per_language different texts of each label, those with the least
    hashes. Equal texts are one before they meet, so a hot text is no hot group."""
    label, text = F.col(f"`{label_col}`").cast("string"), F.col(f"`{text_col}`")
    labelled = df.where(label.isNotNull() & text.isNotNull()).select(label.alias("label"), F.xxhash64(F.lit(11), text).alias("h"), text.alias("text"))
    counts = labelled.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))
    small = counts.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    # a bound on the hash leaves about 1.5 times the texts wanted, of all rows; the exact ones are then chosen
    bound = counts.select("label", (F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.col("n")) * F.lit(2.0**64) - F.lit(2.0**63)).alias("most"))
    few = labelled.join(F.broadcast(bound) if small else bound, "label").where("cast(h as double) <= most")
    once = few.groupBy("label", "h").agg(F.first("text").alias("text"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("nth") <= per_language).drop("nth")


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """The model of a table of labelled texts: features are computed where the texts are, each bit's
    classifier is trained in a task of its own; the driver gets the classifiers."""
    ship(df.sparkSession)

    def featured(it):
        import pyarrow as pa

        for batch in it:
            x = features(frames.strings(batch, "text"))
            yield pa.RecordBatch.from_arrays([frames.column(batch, "label"), frames.column(batch, "h"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "h", "x"])

    rows = frames.written(sample(df, text_col, label_col, sample_per_language).mapInArrow(featured, "label string, h long, x binary"))
    languages = sorted(r["label"] for r in rows.select("label").distinct().collect())
    code = codewords(len(languages))
    bits = code.shape[1] if languages else 1
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIMENSIONS, bits), np.float32), np.zeros(bits), np.ones(bits))

    def learn(key, table):
        import pyarrow as pa

        table = table.sort_by([("label", "ascending"), ("h", "ascending")])
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(table.num_rows, DIMENSIONS)
        y = code[[languages.index(v) for v in table.column("label").to_pylist()], key[0].as_py()]
        w, b, trust = fit_bit(x, y, np.arange(len(y)) % 5 == 4)
        return pa.table({"bit": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.tobytes()], pa.binary()), "b": [b], "trust": [trust]})

    each = rows.withColumn("bit", F.explode(F.expr(f"sequence(0, {bits - 1})")))
    got = sorted(each.repartition(bits, "bit").groupBy("bit").applyInArrow(learn, "bit int, w binary, b double, trust double").collect())
    return Model(languages, code, np.stack([np.frombuffer(r["w"], np.float32) for r in got], 1), np.array([r["b"] for r in got]), np.array([r["trust"] for r in got]))


def identify(df: DataFrame, model: Model, text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """df with predicted_lang, margin (of the losses of the two nearest codewords) and ambiguous."""
    held = df.sparkSession.sparkContext.broadcast((model.languages, model.code, model.weights, model.bias, model.trust))

    def make(batch):
        import pyarrow as pa

        got = Model(*held.value).predict([t or "" for t in frames.strings(batch, text_col)], ambiguous)
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]

    return frames.add_columns(df, make, [StructField("predicted_lang", StringType()), StructField("margin", DoubleType()), StructField("ambiguous", BooleanType())])
