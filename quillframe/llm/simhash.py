"""Near-duplicate documents: SimHash fingerprints and multi-index hashing.

A fingerprint has 128 bits: each different word of the lower-cased text (runs of letters and numbers;
the text itself if it has none) votes on every bit. Two texts are near duplicates if their
fingerprints differ in at most `radius` bits. Such fingerprints are at most radius // segments apart
in at least one segment, so every fingerprint looks up the small Hamming ball around each of its
segments in that segment's table and compares whole fingerprints with what it meets. This finds all
pairs within the radius: it is exact, not approximate. Equal fingerprints are one entry.

The tables are cut by the leading bits of a segment; a fingerprint is sent to the tables that its
ball reaches. Within a table only a spanning forest of the pairs found goes out, so what is written
grows with the documents and not with the square of a group.

Defined results: documents whose text is NULL, empty or only white space have no fingerprint and no
duplicates. Ids may have any type that can be compared and keep it; rows whose ids are NULL or
repeated are told apart by 128 bits of id and text. Of each group the row with the least id stays
(NULLs last; ties by these bits); of equal rows, one. Words are counted once a text, so very long
texts need no other treatment. An empty table gives an empty result. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..runtime import ship
from . import frames, kernels as K
from .components import components

BITS, SEGMENTS, RADIUS = 128, 7, 20
#: Entries of one table at most, about; it only sets how many leading bits cut the tables.
TABLE_ENTRIES = 1 << 19


def fingerprints(texts: list[str]) -> np.ndarray:
    """128-bit fingerprints, a row of two uint64 (low, high) for each text that isn't blank."""
    out = np.zeros((len(texts), 2), np.uint64)
    for a, b in K.batches(texts, 1 << 19):
        own = [t.lower() for t in texts[a:b]]
        cp, doc_starts = K.code_points(own)
        starts, ends = K.alnum_words(cp, doc_starts)
        doc = np.searchsorted(doc_starts, starts, "right") - 1
        # texts without words have themselves as their only feature
        bare = np.setdiff1d(np.arange(len(own)), doc)
        starts, ends, doc = (np.concatenate(x) for x in ((starts, doc_starts[bare]), (ends, doc_starts[bare + 1]), (doc, bare)))
        h = K.Spans(cp).hash(starts, ends)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        halves = np.stack([h, K.mix(h ^ np.uint64(0x94D049BB133111EB))], 1)
        first = np.searchsorted(doc, np.arange(len(own)))
        for lo in range(0, len(own), 256):
            hi = min(len(own), lo + 256)
            part = slice(first[lo], first[hi] if hi < len(own) else len(h))
            bits = np.unpackbits(halves[part].view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, first[lo:hi] - first[lo], axis=0, dtype=np.int32)
            size = np.diff(np.append(first[lo:hi] - first[lo], len(bits)))
            out[a + lo : a + hi] = np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def fingerprint_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, hi, lo) of every row with a text that isn't blank; k1 and k2 name the row."""
    ship(df.sparkSession)
    src = df.select(F.col(f"`{id_col}`").alias("id"), *frames.row_key(id_col, text_col), F.col(f"`{text_col}`").alias("text"))

    def run(it):
        import pyarrow as pa

        for batch in it:
            batch = batch.filter(pa.array([bool(t and t.strip()) for t in frames.strings(batch, "text")], pa.bool_()))
            if batch.num_rows:
                fp = fingerprints(frames.strings(batch, "text")).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[frames.column(batch, c) for c in ("id", "k1", "k2")], pa.array(fp[:, 1].copy()), pa.array(fp[:, 0].copy())], names=["id", "k1", "k2", "hi", "lo"])

    fields = [StructField(c, LongType()) for c in ("k1", "k2", "hi", "lo")]
    return src.mapInArrow(run, StructType([StructField("id", src.schema["id"].dataType), *fields]))


def cuts(bits: int, segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    at = [bits * k // segments for k in range(segments + 1)]
    return list(zip(at, np.diff(at).tolist()))


def segment(lo: np.ndarray, hi: np.ndarray, first: int, size: int) -> np.ndarray:
    """Values of one segment of the 128 bits."""
    mask = np.uint64((1 << size) - 1)
    if first >= 64:
        return (hi >> np.uint64(first - 64)) & mask
    out = lo >> np.uint64(first)
    if first + size > 64:
        out = out | (hi << np.uint64(64 - first))
    return out & mask


def ball(bits: range, radius: int) -> list[int]:
    """Masks of at most `radius` of the given bits."""
    out, last = [0], [(0, bits.start)]
    for _ in range(radius):
        last = [(m | 1 << b, b + 1) for m, at in last for b in range(at, bits.stop)]
        out += [m for m, _ in last]
    return out


class Forest:
    """Union-find over the entries of one table; join() returns the edges that connected something."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while True:
            q = p[r]
            if np.array_equal(q, r):
                p[x] = r
                return r
            r = q

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, used = self.parent, np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            while p[x] != x:
                p[x] = p[p[x]]
                x = p[x]
            while p[y] != y:
                p[y] = p[p[y]]
                y = p[y]
            if x != y:
                p[max(x, y)] = min(x, y)
                used[k] = True
        return used


def table_edges(lo, hi, rep, own, first: int, size: int, lead: int, radius: int, ball_radius: int, chunk: int = 1 << 21):
    """Edges of a spanning forest of the pairs within the radius that meet in one table.

    own marks the entries whose segment belongs to this table; the others only look up. Entries that
    look up from elsewhere flip the leading bits in which they differ from the table.
    """
    value = segment(lo, hi, first, size).astype(np.int64)
    tail = size - lead
    table = np.flatnonzero(own)
    if not len(table):
        return np.empty((0, 2), np.int64)
    prefix = int(value[table[0]]) >> tail
    low = value[table] & ((1 << tail) - 1)
    order = np.argsort(low, kind="stable")
    table, low = table[order], low[order]
    index = np.zeros((1 << tail) + 1, np.int64)
    np.cumsum(np.bincount(low, minlength=1 << tail), out=index[1:])
    forest, edges = Forest(len(value)), []
    away = np.bitwise_count(((value >> tail) ^ prefix).astype(np.uint64)).astype(np.int64)
    for distance in range(ball_radius + 1):
        probe = np.flatnonzero(away == distance)
        masks = np.array(ball(range(tail), ball_radius - distance), np.int64)
        step = max(1, (1 << 20) // len(masks))
        for at in range(0, len(probe), step):
            p = probe[at : at + step]
            v = (value[p] & ((1 << tail) - 1))[:, None] ^ masks
            s = index[v].ravel()
            n = index[v + 1].ravel() - s
            hit = np.flatnonzero(n)
            total = np.cumsum(n[hit])
            while len(hit):
                cut = max(1, int(np.searchsorted(total, chunk)))
                part, hit = hit[:cut], hit[cut:]
                total = total[cut:] - total[cut - 1]
                a = np.repeat(p[part // len(masks)], n[part])
                b = table[K.ranges(s[part], n[part])]
                keep = np.flatnonzero(a != b)
                a, b = a[keep], b[keep]
                near = (np.bitwise_count(lo[a] ^ lo[b]).astype(np.int16) + np.bitwise_count(hi[a] ^ hi[b])) <= radius
                a, b = a[near], b[near]
                apart = forest.roots(a) != forest.roots(b)
                a, b = a[apart], b[apart]
                if len(a):
                    used = forest.join(a, b)
                    edges.append(np.stack([rep[a[used]], rep[b[used]]], 1))
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def _pair_edges(prints: DataFrame, n: int, segments: int, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (entry, hi, lo)."""
    spark = prints.sparkSession
    sizes, reach = cuts(BITS, segments), radius // segments
    lead = min(min(s for _, s in sizes) - 1, max(2, int(np.ceil(np.log2(max(1, n / TABLE_ENTRIES))))))

    def send(it):
        import pyarrow as pa

        for batch in it:
            entry, hi, lo = (frames.column(batch, c).to_numpy() for c in ("entry", "hi", "lo"))
            for k, (first, size) in enumerate(sizes):
                top = (segment(lo.view(np.uint64), hi.view(np.uint64), first, size) >> np.uint64(size - lead)).astype(np.int64)
                for mask in ball(range(lead), reach):
                    grp = (k << lead) + (top ^ mask)
                    yield pa.RecordBatch.from_arrays([pa.array(grp.astype(np.int32)), pa.array(np.full(len(grp), mask == 0)), pa.array(entry), pa.array(hi), pa.array(lo)], names=["grp", "own", "entry", "hi", "lo"])

    def meet(key, table):
        import pyarrow as pa

        k = key[0].as_py() >> lead
        entry, hi, lo = (table.column(c).to_numpy() for c in ("entry", "hi", "lo"))
        e = table_edges(lo.view(np.uint64), hi.view(np.uint64), entry, table.column("own").to_numpy(zero_copy_only=False), *sizes[k], lead, radius, reach)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    sent = prints.mapInArrow(send, "grp int, own boolean, entry long, hi long, lo long")
    tables = segments << lead
    return sent.repartition(min(tables, max(frames.partitions(spark), 1) * 4), "grp").groupBy("grp").applyInArrow(meet, "a long, b long")


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(id, k1, k2, kept, repeated) of every row in a group of near duplicates.

    k1 and k2 name a row (frames.row_key); kept is a struct of the same three of the row of its group
    that stays. `repeated` is true where several rows are equal in id and text. Rows without near
    duplicates and repetitions are absent.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    prints = frames.written(fingerprint_table(df, id_col, text_col).groupBy("id", "k1", "k2", "hi", "lo").agg(F.count("*").alias("rows")))
    groups = prints.groupBy("hi", "lo").agg(F.min(order).alias("kept"), F.sum("rows").alias("rows"))
    # each distinct fingerprint is an entry, numbered once: what is written stays as it is
    distinct = frames.written(groups.withColumn("entry", F.monotonically_increasing_id()))
    links = components(_pair_edges(distinct.select("entry", "hi", "lo"), distinct.count(), segments, radius))
    placed = distinct.join(links.withColumnRenamed("node", "entry"), "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    best = placed.groupBy("root").agg(F.min("kept").alias("kept"), F.sum("rows").alias("size")).where("size > 1")
    kept = placed.select("hi", "lo", "root").join(best, "root")
    return prints.join(kept.select("hi", "lo", "kept"), ["hi", "lo"]).select("id", "k1", "k2", "kept", (F.col("rows") > 1).alias("repeated"))


_GOES = "not (k1 = kept.k1 and k2 = kept.k2)"


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, kept_doc_id): the documents that have a near duplicate to keep instead, each once."""
    d = duplicates(df, id_col, text_col, **options)
    return d.where(_GOES).select(F.col("id").alias("doc_id"), F.col("kept.id").alias("kept_doc_id")).distinct()


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each group of near duplicates, all columns as they were."""
    marks = frames.written(duplicates(df, id_col, text_col, **options).select("k1", "k2", F.expr(_GOES).alias("goes"), "repeated"))
    held = df.select(*frames.row_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    joined = held.join(marks.hint("merge"), ["k1", "k2"], "left").where("not coalesce(goes, false)")
    left = joined.where("not coalesce(repeated, false)").select("row")
    if not marks.where("repeated").isEmpty():
        left = left.union(joined.where("repeated").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row"))
    return left.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
