"""Where texts may repeat: anchors chosen by content, and the ones that occur more than once.

Words are the white-space separated pieces of a text. Every window of `min_words` words has the
position in it whose next `GRAM` words have the least hash; these positions are the anchors. Equal
windows have their anchor at the same place, so any passage of at least `min_words` words that
occurs twice has an anchor whose `GRAM` words occur twice (winnowing: Schleimer, Wilkerson, Aiken
2003). Anchors that occur once can't be in a repeated passage and go no further: nothing is lost by
that, and exact comparison follows. About one word in 17 is an anchor, whatever the table's size.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from . import frames, kernels as K

MIN_WORDS, GRAM = 50, 18


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over a[i : i + width] for each i; as far as there is, at the end."""
    n, size = len(a), 1
    out = a.copy()
    while size * 2 <= width:
        out[: n - size] = op(out[: n - size], out[size:])
        size *= 2
    if size < width:
        rest = width - size
        out[: max(0, n - rest)] = op(out[: max(0, n - rest)], out[rest:])
    return out


def anchors(word_hashes: np.ndarray, doc_words: np.ndarray, min_words: int, gram: int = GRAM, spans: K.Spans | None = None):
    """Positions of the anchors among all words, the hashes of their grams, and at which distances
    before each (from, to) the windows start whose anchor it is: the leftmost place of their least.

    doc_words: where each document's words start, one more than documents.
    """
    n = len(word_hashes)
    none = np.empty(0, np.int64)
    if n < min_words:
        return none, none.astype(np.uint64), none, none
    gram = min(gram, min_words)
    width = min_words - gram + 1
    doc_end = np.repeat(doc_words[1:], np.diff(doc_words))
    at = np.arange(n)
    g = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    ok = np.flatnonzero(at + gram <= doc_end)
    g[ok] = ((spans or K.Spans(word_hashes)).hash(ok, ok + gram) >> np.uint64(1)) | np.uint64(1)
    least = _sliding(g, width, np.minimum)
    least[at + min_words > doc_end] = 0  # no whole window starts here
    most = _sliding(least[::-1], width, np.maximum)[::-1]
    chosen = np.flatnonzero((g == most) & (at + gram <= doc_end))
    h = g[chosen]
    # the last place before with the same hash: windows that reach it have their anchor there
    order = np.lexsort((chosen, h))
    before = np.full(len(chosen), -1, np.int64)
    same = h[order[1:]] == h[order[:-1]]
    before[order[1:][same]] = chosen[order[:-1][same]]
    low, high = np.full(len(chosen), width, np.int64), np.full(len(chosen), -1, np.int64)
    if width > 64 and len(chosen):  # each window's anchor at once: the next place of its least hash
        i = np.flatnonzero(least)
        names, own = np.unique(h, return_inverse=True)
        places = np.sort(own * (n + 1) + chosen)
        p = places[np.searchsorted(places, np.searchsorted(names, least[i]) * (n + 1) + i)] % (n + 1)
        k = np.searchsorted(chosen, p)
        np.minimum.at(low, k, p - i)
        np.maximum.at(high, k, p - i)
    for d in range(width if width <= 64 else 0):
        i = chosen - d
        own = np.flatnonzero((i >= 0) & (i > before))
        own = own[least[i[own]] == h[own]]
        low[own] = np.minimum(low[own], d)
        high[own] = d
    keep = high >= 0
    # least hashes are small ones: mixed again, they spread evenly over all ranges
    return chosen[keep], K.mix(h[keep]) >> np.uint64(1), low[keep], high[keep]


class Words:
    """The words of a batch of texts: their spans, hashes and, joined by single spaces, their bytes."""

    def __init__(self, texts: list[str]):
        self.cp, self.doc_starts = K.code_points(texts)
        self.starts, self.ends = K.words(self.cp, self.doc_starts)
        self.docs = np.searchsorted(self.starts, self.doc_starts)
        self.hashes = K.Spans(self.cp).hash(self.starts, self.ends)
        self._texts = texts

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, a space after each, and where each starts (one more than words)."""
        data = np.frombuffer(("".join(self._texts) + " ").encode("utf-8", "surrogatepass"), np.uint8)
        place = np.concatenate([[0], np.cumsum(K.utf8_lengths(self.cp))])
        a, sizes = place[self.starts], place[self.ends] - place[self.starts] + 1
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = data[K.ranges(a, sizes)]
        out[at[1:] - 1] = 0x20
        return out.tobytes(), at


def sources(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, text) of the rows that have a text: k1 and k2 name the row (frames.row_key), id is
    NULL unless ids are whole numbers."""
    return df.select(frames.whole_id(df, id_col).alias("id"), *frames.row_key(id_col, text_col), F.col(f"`{text_col}`").alias("text")).where("text is not null")


def _anchor_rows(src: DataFrame, min_words: int) -> DataFrame:
    """(k1, k2, h, times): the different anchors of each text and how often it has them."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            texts = frames.strings(batch, "text")
            for a, b in K.batches(texts):
                w = Words(texts[a:b])
                at, g, _, _ = anchors(w.hashes, w.docs, min_words)
                doc = np.searchsorted(w.docs, at, "right") - 1
                order = np.lexsort((g, doc))
                doc, g = doc[order], g[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                take = pa.array(doc[first] + a)
                times = np.diff(np.append(first, len(g)))
                yield pa.RecordBatch.from_arrays([frames.column(batch, "k1").take(take), frames.column(batch, "k2").take(take), pa.array(g[first].astype(np.int64)), pa.array(times.astype(np.int32))], names=["k1", "k2", "h", "times"])

    return src.mapInArrow(run, "k1 long, k2 long, h long, times int")


#: Occurrences of an anchor above which its places don't meet in one group.
HOT = 1 << 16


def candidates(df: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, int, int]:
    """(id, k1, k2, text, h array, hot array) of the texts that have anchors which occur repeatedly, and
    how many such anchors there are in all texts; hot: those that occur more than HOT times, apart.

    Anchors are counted before they meet (partial sums of each task), so one that a third of all texts
    have is one row a task; which texts have it is then a join, whose skew Spark can split.
    """
    if not 1 <= min_words < 1 << 16:
        raise ValueError("min_words must be from 1 to 65535")
    src = sources(df, id_col, text_col)
    rows = frames.written(_anchor_rows(src, min_words))
    often = rows.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("is_hot"))
    each = rows.join(often, "h").groupBy("k1", "k2").agg(F.expr("collect_set(if(is_hot, null, h))").alias("h"), F.expr("collect_set(if(is_hot, h, null))").alias("hot"))
    each = frames.written(each)
    places = each.agg(F.coalesce(F.sum(F.size("h")), F.lit(0)), F.coalesce(F.sum(F.size("hot")), F.lit(0))).first()
    return src.join(each.hint("merge"), ["k1", "k2"]).select("id", "k1", "k2", "text", "h", "hot"), places[0], places[1]


class Once:
    """Which rows of a task were not there before, by their names: of equal rows one is enough."""

    def __init__(self):
        self.seen: set[tuple[int, int]] = set()

    def filter(self, batch):
        import pyarrow as pa

        new = []
        for name in zip(*[frames.column(batch, c).to_pylist() for c in ("k1", "k2")]):
            new.append(name not in self.seen)
            self.seen.add(name)
        return batch if all(new) else batch.filter(pa.array(new, pa.bool_()))


#: Places that a part or shard holds, about: what sets the number of parts.
PART_PLACES = 1 << 17


def grouped(df: DataFrame, by: str, places: int, least: int):
    """df grouped by its number of the part, with as many tasks as parts where these are many."""
    parts = part_count(places, least)
    return (df.repartition(parts, by) if parts > least else df).groupBy(by)


def part_count(places: int, least: int) -> int:
    """Parts for so many places: their sizes don't grow with the corpus."""
    return max(least, -(-places // PART_PLACES))


def repeated_anchors(w: Words, hashes, min_words: int):
    """(document, position among all words, hash, from, to) of the anchors of a batch that are in its
    lists of hashes (an Arrow array of lists)."""
    at, g, low, high = anchors(w.hashes, w.docs, min_words)
    doc = np.searchsorted(w.docs, at, "right") - 1
    sizes = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
    wanted = K.mix(hashes.flatten().to_numpy(zero_copy_only=False).astype(np.uint64) + own * np.uint64(0x9E3779B97F4A7C15))
    keep = np.isin(K.mix(g + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), wanted)
    return doc[keep], at[keep], g[keep], low[keep], high[keep]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` ranges of the 63-bit hashes each belongs to."""
    return ((h.astype(np.uint64) >> np.uint64(31)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed blob."""
    import zstandard

    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(raw) + 1}q", len(raw), *map(len, raw)) + b"".join(raw))


def unpack(blob: bytes, *kinds) -> list:
    """What pack() was given; kinds: a dtype each, None for bytes."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", data)[0]
    sizes = struct.unpack_from(f"<{n}q", data, 8)
    out, at = [], 8 * (n + 1)
    for kind, size in zip(kinds, sizes):
        out.append(data[at : at + size] if kind is None else np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def islands(spans: DataFrame, keys: list[str], *aggs) -> DataFrame:
    """Unions of the overlapping or touching [s, e) of each combination of keys."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before >= F.col("s"), 0).otherwise(1))
    grouped = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), *aggs).drop("_island")
