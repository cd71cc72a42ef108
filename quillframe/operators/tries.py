"""Pairs of texts within a number of edits, by search in tries.

Rows of the edit table are carried along the trie of one side's texts and given up where no cell is
within the bound, so texts that begin alike share the work, and what differs too much at its start is
never read to its end (Trie-Join: Wang, Feng, Li 2010). Only the band of cells that can be within the
bound is computed, for all live (text, node) pairs of a level at once.

The trie is cut at prefixes that about BLOCK texts have; a text goes to the blocks whose prefix it can
have within the bound. Whatever has no shorter cut (copies aside) is dealt by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..runtime import ship

#: Texts of a block on either side; the longest prefix; cells of a step.
BLOCK, DEPTH, CELLS = 4096, 32, 1 << 20
_END = "\0"


def _codes(texts: list[str], left: int = 0, right: int = 0):
    """Code points of texts as rows, 0 (no code point of a text: those are one up) where there is none."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), left + (int(sizes.max()) if len(texts) else 0) + right), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    rows = np.repeat(np.arange(len(texts)), sizes)
    out[rows, left + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def _parts(texts: list[str], cells: int) -> Iterator[list[str]]:
    """Slices of texts whose longest times their number is within cells, or one text."""
    start, most = 0, 0
    for k, t in enumerate(texts):
        most = max(most, len(t) + 1)
        if k > start and most * (k - start + 1) > cells:
            yield texts[start:k]
            start, most = k, len(t) + 1
    if texts:
        yield texts[start:]


def search(texts: list[str], bounds: list[int], others: list[str], prefix: bool = False) -> Iterator[tuple[str, str, int]]:
    """(text, other, distance) of all pairs within the text's bound; with prefix, of all pairs in which
    some start of the text is within the bound of the whole other one (the distance is a lower bound)."""
    by: dict[int, list[str]] = {}
    for t, d in zip(texts, bounds):
        by.setdefault(d, []).append(t)
    for ys in _parts(sorted(set(others)), 4 * CELLS):
        trie = _trie(ys)
        for d, mine in by.items():
            step = max(1, CELLS // (len(ys) * (2 * d + 1)))
            for k in range(0, len(mine), step):
                for xs in _parts(mine[k : k + step], 4 * CELLS):
                    yield from _walk(xs, ys, trie, d, prefix)


def _trie(ys: list[str]):
    """Codes and sizes of sorted different texts, and how many characters each begins with like the one before."""
    import numpy as np

    codes, sizes = _codes(ys, 0, 1)
    differ = codes[1:] != codes[:-1]
    return codes, sizes, np.concatenate(([-1], np.argmax(differ, axis=1)))


def _walk(xs: list[str], ys: list[str], trie, d: int, prefix: bool) -> Iterator[tuple[str, str, int]]:
    import numpy as np

    codes, sizes, alike = trie
    longest = int(sizes.max())
    x, m = _codes(xs, d, longest + 2 * d + 2)
    band = np.arange(2 * d + 1)
    none = d + 1
    small = np.uint8 if none < 250 else np.int32
    # cell k of a pair at depth j is the distance of the text's first j - d + k characters and the node's
    cells = np.tile(np.where(band >= d, band - d, none).astype(small), (len(xs), 1))
    cells[(band - d)[None, :] > m[:, None]] = none
    at, lo, hi = np.arange(len(xs)), np.zeros(len(xs), np.int64), np.full(len(xs), len(ys))
    for j in range(longest + 1):
        done = np.flatnonzero(sizes[lo] == j)
        if len(done):
            if prefix:
                found = cells[done].min(axis=1)
            else:
                k = m[at[done]] - j + d
                found = np.where((k >= 0) & (k <= 2 * d), cells[done, np.clip(k, 0, 2 * d)], none)
            for p in np.flatnonzero(found <= d):
                yield xs[at[done[p]]], ys[lo[done[p]]], int(found[p])
        if j == longest:
            return
        heads = np.flatnonzero(alike <= j)
        after = np.append(heads[1:], len(ys))
        longer = sizes[heads] > j
        heads, after = heads[longer], after[longer]
        first, last = np.searchsorted(heads, lo), np.searchsorted(heads, hi)
        n = last - first
        parent = np.repeat(np.arange(len(at)), n)
        child = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + first[parent]
        old, at = cells[parent], at[parent]
        lo, hi = heads[child], after[child]
        new = old + (x[at[:, None], j + band[None, :]] != codes[lo, j][:, None])
        np.minimum(new[:, :-1], old[:, 1:] + 1, out=new[:, :-1])
        for k in range(1, 2 * d + 1):
            np.minimum(new[:, k], new[:, k - 1] + 1, out=new[:, k])
        np.minimum(new, none, out=new)
        new[(j + 1 - d + band)[None, :] > m[at][:, None]] = none
        live = new.min(axis=1) <= d if len(new) else np.zeros(0, bool)
        cells, at, lo, hi = new[live].astype(small), at[live], lo[live], hi[live]
        if not len(at):
            return


def most_edits(n: int, t: float, longest: int) -> int:
    """Edits that a text of n characters and another one, no longer than `longest`, may have at a score of t."""
    return int((1 - t) * max(n, min(longest, int(n / t + 1e-9))) + 1e-9)


def _cuts(texts: DataFrame) -> dict[str, tuple[int, int]]:
    """Prefix (with the end of a text as a character) -> number of parts and longest text of its block."""
    ends = F.concat("s", F.lit(_END))
    prefixes = texts.select(F.length("s").alias("m"), F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length(ends), F.lit(DEPTH))), lambda k: F.substring(ends, F.lit(1), k))).alias("p"))
    sizes = prefixes.groupBy("p").agg(F.count("*").alias("n"), F.max("m").alias("m"))
    total = texts.count()
    block = max(BLOCK, total // 4096)
    above = sizes.where(F.col("n") > block).select(F.col("p").alias("q"))
    begun = sizes.where((F.col("n") <= block) | (F.length("p") == DEPTH)).withColumn("q", F.expr("substring(p, 1, length(p) - 1)"))
    cuts = begun.join(above, "q") if total > block else sizes.where("p = ''")
    return {r["p"]: (-(-r["n"] // block), r["m"]) for r in cuts.select("p", "n", "m").collect()}


def near_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(x, y, d): all pairs of texts, each of left (s) with each of right (s), whose Levenshtein score is
    at least the threshold, with their distance. The texts of a table are different and none is empty."""
    spark = left.sparkSession
    ship(spark)
    cuts = _cuts(right)
    longest = max((m for _, m in cuts.values()), default=0)
    bare: dict[str, list[str]] = {}
    for p in cuts:
        bare.setdefault(p.removesuffix(_END), []).append(p)

    def route(it):
        import pyarrow as pa

        for batch in it:
            texts = batch.column(0).to_pylist()
            s, p, part = [], [], []
            for x, q, least in search(texts, [most_edits(len(t), threshold, longest) for t in texts], list(bare), True):
                for cut in bare[q]:
                    for k in range(cuts[cut][0] if least <= most_edits(len(x), threshold, cuts[cut][1]) else 0):
                        s.append(x), p.append(cut), part.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(p, pa.string()), pa.array(part, pa.int32())], names=["s", "p", "part"])

    def place(it):
        import zlib

        import pyarrow as pa

        for batch in it:
            texts = batch.column(0).to_pylist()
            at = [next(q for k in range(DEPTH + 1) if (q := (t + _END)[:k]) in cuts) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(at, pa.string()), pa.array([zlib.crc32(t.encode()) % cuts[q][0] for t, q in zip(texts, at)], pa.int32())], names=["s", "p", "part"])

    def compare(it):
        import pyarrow as pa

        for batch in it:
            for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                most = max(map(len, ys))
                pairs = search(xs, [most_edits(len(t), threshold, most) for t in xs], ys)
                found = [(x, y, d) for x, y, d in pairs if d <= int((1 - threshold) * max(len(x), len(y)) + 1e-9)]
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found[k : k + 10_000]), (pa.string(), pa.string(), pa.int32()))], names=["x", "y", "d"])

    kind = "s string, p string, part int"
    routed = left.mapInArrow(route, kind)
    parts = routed.groupBy("p", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    mine = routed.join(parts, ["p", "part"]).groupBy("p", "part", F.pmod(F.xxhash64("s"), F.col("n")).alias("k")).agg(F.collect_list("s").alias("xs"))
    theirs = right.mapInArrow(place, kind).groupBy("p", "part").agg(F.collect_list("s").alias("ys"))
    blocks = mine.join(theirs, ["p", "part"]).select("xs", "ys").repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.mapInArrow(compare, "x string, y string, d int")
