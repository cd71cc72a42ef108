"""License scans: normalised text against licence templates by Dice's coefficient of word bigrams.

Normalised means: lower case, and words are runs of letters and numbers. A text is cut into pieces at
line breaks and after full stops, question and exclamation marks before white space; what is compared
with a template is every run of consecutive pieces, so a licence is found as a file, as several
paragraphs inside a longer text, as a line or as a sentence. The coefficient is
2 * common / (bigrams of the run + bigrams of the template), both as sets.

Sizes prune twice before anything is compared. With threshold t a run that reaches it shares at least
bigrams * t / (2 - t) with the template: texts that share fewer with it in all leave it out. And a
run has at most words * (2 - t) / t words, of those of the template: longer ones aren't units. Of the
other runs only those matter that begin and end with pieces that share a bigram, as the outer pieces
of others only lower the coefficient.

Defined results: texts that are NULL, blank or of one word have no licence and no row. A licence is
reported once a row of df with its best score, whichever templates and runs matched. Equal rows are
reported each; ties don't matter, as all licences above the threshold are reported. Ids pass through
in their own type, NULL included; other columns, whatever their names, play no part. Long texts are
scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..runtime import ship
from . import frames, kernels as K
from .license_texts import TEMPLATES

THRESHOLD = 0.8


def _bigrams(h: np.ndarray) -> np.ndarray:
    return K.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


class Templates:
    """Bigrams of all templates, and which template has which."""

    def __init__(self, templates=TEMPLATES):
        self.names = np.array([t[0] for t in templates])
        sets, words = [], []
        for _, _, text in templates:
            cp, at = K.code_points([text.lower()])
            h = K.Spans(cp).hash(*K.alnum_words(cp, at))
            sets.append(np.unique(_bigrams(h)))
            words.append(len(h))
        self.bigrams = np.unique(np.concatenate(sets))
        self.has = np.stack([np.isin(self.bigrams, s) for s in sets], 1)
        self.sizes, self.words = np.array([len(s) for s in sets]), np.array(words)
        # most bigrams of a corpus are in no template: a bit table tells it faster
        self._bits = np.zeros(1 << 16, bool)
        self._bits[(self.bigrams >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are bigrams of templates, and which ones."""
        maybe = np.flatnonzero(self._bits[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.bigrams, h[maybe]), len(self.bigrams) - 1)
        ok = self.bigrams[at] == h[maybe]
        return maybe[ok], at[ok]


def _pieces(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word a number of its piece, rising through the texts (which are cut elsewhere)."""
    cut = cp == 10
    stop = (cp[:-1] == 0x2E) | (cp[:-1] == 0x21) | (cp[:-1] == 0x3F)
    cut[:-1] |= stop & np.isin(cp[1:], (9, 10, 12, 13, 32))
    return np.cumsum(cut)[starts]


def _best_run(h: np.ndarray, piece: np.ndarray, at: np.ndarray, own: np.ndarray, size: int, words: int, threshold: float) -> float:
    """The best coefficient of the runs of pieces of one text with one template, 0.0 below the threshold.

    h, piece: the text's bigrams and its words' pieces; at: places of the template's bigrams in the
    text; own: which of the text's bigrams these are.
    """
    first = np.searchsorted(piece, np.unique(piece[at]))
    last = np.searchsorted(piece, np.unique(piece[at + 1]), "right")
    most, best = int(words * (2 - threshold) / threshold), 0.0
    for a in first.tolist():
        ends = last[(last > a + 1) & (last <= a + most)]
        if not len(ends):
            continue
        _, new = np.unique(h[a : ends[-1] - 1], return_index=True)
        fresh = np.zeros(int(ends[-1]) - a, np.int64)
        fresh[new + 1] = 1
        n = np.cumsum(fresh)[ends - a - 1]
        fresh[np.flatnonzero(~own[a : ends[-1] - 1]) + 1] = 0
        score = 2.0 * np.cumsum(fresh)[ends - a - 1] / (n + size)
        best = max(best, float(score.max()))
    return best if best >= threshold else 0.0


def scan(texts: list[str], templates: Templates, threshold: float = THRESHOLD) -> list[tuple[int, str, float]]:
    """(text, licence, score) of all licences found."""
    out: dict[tuple[int, str], float] = {}
    least = templates.sizes * threshold / (2 - threshold) - 1e-9
    for a, b in K.batches(texts):
        cp, doc_starts = K.code_points([t.lower() for t in texts[a:b]])
        starts, ends = K.alnum_words(cp, doc_starts)
        if len(starts) < 2:
            continue
        h = _bigrams(K.Spans(cp).hash(starts, ends))
        at, which = templates.find(h)
        doc = np.searchsorted(doc_starts, starts, "right") - 1
        inside = doc[at] == doc[at + 1]
        at, which = at[inside], which[inside]
        if not len(at):
            continue
        # different bigrams that each text shares with each template
        count = len(templates.bigrams)
        d, w = np.divmod(np.unique(doc[at] * count + which), count)
        first = np.flatnonzero(np.diff(d, prepend=-1))
        common = np.add.reduceat(templates.has[w].astype(np.int32), first, axis=0)
        piece = None
        for k, t in zip(*np.nonzero(common >= least)):
            piece = _pieces(cp, starts) if piece is None else piece
            lo, hi = np.searchsorted(doc, d[first[k]]), np.searchsorted(doc, d[first[k]], "right")
            mine = slice(*np.searchsorted(at, (lo, hi)))
            places = at[mine][templates.has[which[mine], t]] - lo
            own = np.zeros(hi - lo, bool)
            own[places] = True
            score = _best_run(h[lo : hi - 1], piece[lo:hi], places, own, int(templates.sizes[t]), int(templates.words[t]), threshold)
            if score:
                key = (a + int(d[first[k]]), str(templates.names[t]))
                out[key] = max(score, out.get(key, 0.0))
    return sorted((k, n, s) for (k, n), s in out.items())


def read_templates(folder: str) -> tuple[tuple[str, str, str], ...]:
    """TEMPLATES and every file of a folder of licence texts, named by the file."""
    import os

    files = sorted(f for f in os.scandir(folder) if f.is_file())
    own = [(f.name.removesuffix(".txt"), "text", open(f.path, encoding="utf-8", errors="replace").read()) for f in files]
    return TEMPLATES + tuple(t for t in own if len(t[2].split()) > 1)


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, score) of every licence in every text."""
    ship(df.sparkSession)
    state: dict = {}

    def run(it):
        import pyarrow as pa

        if "t" not in state:
            state["t"] = Templates(templates)
        for batch in it:
            found = scan([t or "" for t in frames.strings(batch, "text")], state["t"], threshold)
            ids = frames.column(batch, "doc_id").take(pa.array([k for k, _, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n, _ in found], pa.string()), pa.array([s for _, _, s in found], pa.float64())], names=["doc_id", "license", "score"])

    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(run, StructType([StructField("doc_id", src.schema["doc_id"].dataType), StructField("license", StringType()), StructField("score", DoubleType())]))


def oracle_sql(source: str = "documents", threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL: of the texts that share enough with a template, all its runs."""
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, _, t) in enumerate(TEMPLATES))
    norm = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return rf"""
with t as (
  select k, license, {pairs.format("w")} as tb, len(w) as tw from (select k, license, {norm.format("txt")} as w from (values {rows}) v(k, license, txt))
), d as (
  select row_number() over () as r, doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n|[.!?][ \t\n\f\r]'), lambda p: {norm.format("p")}), lambda p: len(p) > 0) as ps
  from {source} where text is not null
), f as (
  select r, doc_id, ps, flatten(ps) as w, list_transform(range(0, len(ps) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda p: len(p))), 0)::bigint) as upto from d
), c as (
  select r, doc_id, w, upto, k, license, tb, tw
  from (select *, {pairs.format("w")} as wb from f where len(w) > 1) join t on len(list_intersect(wb, tb)) >= len(tb) * {threshold} / {2 - threshold} - 1e-9
), s as (
  select *, unnest(range(1, len(upto))) as i from c
), e as (
  select *, unnest(list_filter(range(i + 1, len(upto) + 1), lambda j: upto[j] - upto[i] > 1 and upto[j] - upto[i] <= floor(tw * {2 - threshold} / {threshold}))) as j from s
), m as (
  select r, doc_id, license, tb, list_distinct(list_transform(range(upto[i] + 1, upto[j]), lambda x: w[x] || ' ' || w[x + 1])) as ub from e
), x as (
  select r, doc_id, license, max(2.0::double * len(list_intersect(ub, tb)) / (len(ub) + len(tb))) as score from m group by r, doc_id, license
)
select doc_id, license, score from x where score >= {threshold}"""
