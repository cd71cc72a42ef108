"""Repeated passages by a distributed merge sort of suffixes that knows common prefixes.

1. Each task sorts the suffixes that start at its texts' anchors (see repeats; a suffix goes on for
   the words of the windows whose anchor it is, as no more is asked) into runs, cuts them at fixed splitters and sends them
   front-coded: of each suffix only what follows the prefix it shares with the one before. The
   order is that of the anchor's hash, then of the words; the hash spreads evenly, so equal ranges
   of it are fair splitters, and equal suffixes meet.
2. Each receiver merges its runs with a loser tree whose entries carry the length of the prefix they
   share with the last suffix put out. Of two, the one that shares more comes first; only if they
   share equally much are bytes compared, from there on. No known prefix is compared again.
3. In the merged order all suffixes that share their first r words are neighbours. For every
   distance d before the anchor, suffixes with equal min_words - d words after it are grouped by the
   d words before it: what is then together are all occurrences of one window of min_words words.

Of the occurrences of a window the one with the least (doc_id, row name, position) is the first (a
NULL doc_id comes last; ids that aren't whole numbers have no order, the row name decides); the
others are copies. Windows are united to intervals.

Defined results: texts that are NULL or have fewer than `min_words` words have no passage. Equal
rows (doc_id and text) are one text. Rows with NULL or repeated ids are told apart by 128 bits of id
and text. Words are compared as they are, white space between them isn't. A passage repeated within
one text counts. Texts of any length are searched whole; an empty table gives an empty one; other
columns, whatever their names, don't matter and pass through drop_repeated_passages().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import frames, kernels as K
from .repeats import MIN_WORDS, Once, Words, candidates, grouped, islands, pack, part_count, part_of, repeated_anchors, unpack

#: Bytes of suffixes that a task sorts at once; what exceeds it makes another run.
RUN_BYTES = 16 << 20


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, which share their first `at` bytes."""
    n = min(len(a), len(b))
    step = 32
    while at < n:
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return at + m - (d.bit_length() + 7) // 8
        at += step
        step *= 4
    return n


def front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of each key the length shared with the one before, that of the rest, and all rests."""
    shared = np.zeros(len(keys), np.int32)
    last = b""
    rests = []
    for k, key in enumerate(keys):
        shared[k] = n = common(last, key, 0)
        rests.append(key[n:])
        last = key
    return shared, np.array([len(x) for x in rests], np.int32), b"".join(rests)


def front_decode(shared: np.ndarray, sizes: np.ndarray, rests: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for n, size in zip(shared.tolist(), sizes.tolist()):
        last = last[:n] + rests[at : at + size]
        at += size
        out.append(last)
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """The (run, place) of all keys in order, and how many bytes each shares with the one before.

    runs: sorted keys, and of each the bytes it shares with the one before it in the run.
    """
    width = 1
    while width < len(runs):
        width *= 2
    at = [0] * width
    current = [keys[0] if keys else None for keys, _ in runs] + [None] * (width - len(runs))
    known = [0 if x is not None else -1 for x in current]  # shared with the last put out; -1: run ended

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y, n = current[a], current[b], known[a]
        m = common(x, y, n)
        if x[m : m + 1] <= y[m : m + 1]:
            known[b] = m
            return a, b
        known[a] = m
        return b, a

    losers = [0] * width
    winners = list(range(width))
    size = width
    while size > 1:
        up = []
        for k in range(0, size, 2):
            w, x = play(winners[k], winners[k + 1])
            losers[(size + k) >> 1] = x
            up.append(w)
        winners, size = up, size // 2
    w = winners[0]
    order: list[tuple[int, int]] = []
    shared: list[int] = []
    while known[w] >= 0:
        k = at[w]
        order.append((w, k))
        shared.append(known[w])
        k += 1
        at[w] = k
        keys, lcps = runs[w]
        if k < len(keys):
            current[w], known[w] = keys[k], lcps[k]
        else:
            current[w], known[w] = None, -1
        node = (w + width) >> 1
        while node:
            o = losers[node]
            n, m = known[w], known[o]
            if m > n:
                losers[node], w = w, o
            elif m == n and n >= 0:
                x, y = current[w], current[o]
                m = common(x, y, n)
                if x[m : m + 1] <= y[m : m + 1]:
                    known[o] = m
                else:
                    known[w] = m
                    losers[node], w = w, o
            node >>= 1
    return order, shared


def window_groups(shared_words, right_words, left: list[bytes], low, high, rank, ranges, min_words: int):
    """For suffixes in order, which windows that start d words before them (column d) are repeated.

    Returns (copy, first, least): copy and first are boolean tables of suffixes x d, least the rank
    of the first occurrence, where there is one.
    """
    n, reach = len(right_words), int(high.max()) + 1 if len(high) else 0
    copy, first = np.zeros((n, reach), bool), np.zeros((n, reach), bool)
    least = np.full((n, reach), -1, np.int64)
    if not n:
        return copy, first, least
    data = np.frombuffer(b"".join(left), np.uint8)
    ends = np.flatnonzero(data == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    hashes = K.hash_spans(data, starts, ends)
    sizes = np.cumsum([len(x) for x in left])
    upto = np.searchsorted(ends, sizes, "left")  # words of all left contexts up to this one
    lefts = np.diff(upto, prepend=0)
    before = np.zeros(n, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for d in range(reach):
        if d:
            has = lefts >= d
            word = np.zeros(n, np.uint64)
            word[has] = hashes[upto[has] - d]
            before = K.mix(before * base + word)
        ok = np.flatnonzero((low <= d) & (d <= high) & (lefts >= d) & (right_words >= min_words - d))
        run = np.cumsum(shared_words < min_words - d)
        h = K.mix(before[ok] + K.mix(run[ok].astype(np.uint64)) * base)
        order = np.lexsort((rank[ok], h))
        own, h = ok[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        # a suffix that stands for a range of places is repeated by itself
        several = (size > 1) | np.logical_or.reduceat(ranges[own], start) if len(start) else size > 1
        many = np.repeat(several, size)
        first[own[new & many], d] = True
        copy[own[~new], d] = True
        least[own[many], d] = np.repeat(rank[own[start]], size)[many]
    return copy, first, least


def _bit_runs(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the runs of True in each row."""
    padded = np.zeros((table.shape[0], table.shape[1] + 2), np.int8)
    padded[:, 1:-1] = table
    step = np.diff(padded, axis=1)
    r, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return r, a, b - 1


def _spans(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, k1, k2, copy, s, e, first_id, first_k1, first_k2): windows as intervals, not yet united."""
    least_parts = frames.partitions(df.sparkSession)
    found, places, hot = candidates(df, id_col, text_col, min_words)
    parts = part_count(places, least_parts)

    def sort(it):
        import pyarrow as pa

        keys: list[bytes] = []
        lefts: list[bytes] = []
        meta: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal size
            m = np.concatenate(meta)
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
            m = m[order]
            part = part_of(m[:, 8], parts)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            names, blobs = part[cut], []
            for a, b in zip(cut, np.append(cut[1:], len(part))):
                own = order[a:b].tolist()
                shared, sizes, rests = front_code([keys[k] for k in own])
                left = [lefts[k] for k in own]
                blobs.append(pack(shared, sizes, rests, np.array([len(x) for x in left], np.int32), b"".join(left), m[a:b, :8]))
            keys.clear(), lefts.clear(), meta.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "run"])

        once = Once()
        for batch in map(once.filter, it):
            texts = frames.strings(batch, "text")
            ids, (k1, k2) = frames.column(batch, "id"), (frames.column(batch, c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            hashes = frames.column(batch, "h")
            for a, b in K.batches(texts):
                w = Words(texts[a:b])
                data, at = w.joined()
                doc, p, h, near, far = repeated_anchors(w, hashes.slice(a, b - a), min_words)
                pos = p - w.docs[doc]
                m = np.stack([nulls[a + doc], ids[a + doc], k1[a + doc], k2[a + doc], pos, pos, near, far, h.astype(np.int64)], 1).astype(np.int64)
                # places in a row: runs of one word have equal suffixes, which become one with a range
                row = np.zeros(len(p), bool)
                row[1:] = (np.diff(p) == 1) & (doc[1:] == doc[:-1]) & (h[1:] == h[:-1]) & (near[1:] == near[:-1]) & (far[1:] == far[:-1])
                heads = h.astype(">i8").tobytes()
                x, y = at[p].tolist(), at[np.minimum(p - near + min_words, w.docs[doc + 1])].tolist()
                z = at[np.maximum(p - far, w.docs[doc])].tolist()
                kept: list[int] = []
                for j, (i, end, start, again) in enumerate(zip(x, y, z, row.tolist())):
                    key, left = heads[8 * j : 8 * j + 8] + data[i:end], data[start:i]
                    if again and key == keys[-1] and left == lefts[-1]:
                        m[kept[-1], 5] += 1
                        continue
                    kept.append(j)
                    keys.append(key)
                    lefts.append(left)
                    size += end - start + 130
                meta.append(m[kept])
                if size > RUN_BYTES:
                    yield flush()
        if keys:
            yield flush()

    def join(key, table):
        import pyarrow as pa

        runs, lefts, metas = [], [], []
        for blob in table.column("run").to_pylist():
            shared, sizes, rests, left_sizes, left, meta = unpack(blob, np.int32, np.int32, None, np.int32, None, np.int64)
            runs.append((front_decode(shared, sizes, rests), shared.tolist()))
            end = np.cumsum(left_sizes).tolist()
            lefts.append([left[e - n : e] for e, n in zip(end, left_sizes.tolist())])
            metas.append(meta.reshape(-1, 8))
        order, shared = merge(runs)
        n = len(order)
        words = np.fromiter((runs[r][0][k].count(b" ", 8, s) if s > 8 else 0 for (r, k), s in zip(order, shared)), np.int64, n)
        right = np.fromiter((runs[r][0][k].count(b" ", 8) for r, k in order), np.int64, n)
        first_row = np.cumsum([0] + [len(m) for m in metas])
        meta = np.concatenate(metas)[np.array([first_row[r] + k for r, k in order], np.int64)] if n else np.empty((0, 8), np.int64)
        left = [lefts[r][k] for r, k in order]
        # the same text may come from equal rows: one occurrence
        by = np.lexsort((meta[:, 4], meta[:, 3], meta[:, 2], meta[:, 1], meta[:, 0]))
        same = np.zeros(n, bool)
        same[by[1:]] = (meta[by[1:]] == meta[by[:-1]]).all(1)
        rank = np.empty(n, np.int64)
        rank[by] = np.cumsum(~same[by]) - 1
        keep = np.flatnonzero(~same)
        # what is left out shares all its words with an equal suffix: the least stays between the others
        low = np.minimum.reduceat(words, np.concatenate([[0], keep[:-1] + 1])) if len(keep) else words[:0]
        where = np.empty(len(keep), np.int64)
        where[rank[keep]] = keep
        copy, first, least = window_groups(low, right[keep], [left[k] for k in keep.tolist()], meta[keep, 6], meta[keep, 7], rank[keep], meta[keep, 5] > meta[keep, 4], min_words)
        out = []
        for table_, is_copy in ((copy, True), (first, False)):
            r, a, b = _bit_runs(table_)
            own = meta[keep[r]]
            lowest = np.array([least[i, x : y + 1].min() for i, x, y in zip(r.tolist(), a.tolist(), b.tolist())], np.int64)
            src = meta[where[lowest]] if len(r) else np.empty((0, 8), np.int64)
            rows = (own[:, 1], own[:, 0] != 0, own[:, 2], own[:, 3], np.full(len(r), is_copy), own[:, 4] - b, (own[:, 5] if is_copy else own[:, 4]) - a + min_words, src[:, 1], src[:, 0] != 0, src[:, 2], src[:, 3])
            out.append(rows)
            if not is_copy and (more := own[:, 5] > own[:, 4]).any():
                # the other places of a range are copies of its first
                rest = [c[more] for c in rows]
                rest[4] = np.full(len(rest[4]), True)
                rest[5] = rest[5] + 1
                rest[6] = rest[6] + (own[:, 5] - own[:, 4])[more]
                out.append(tuple(rest))
        c = [np.concatenate(x) for x in zip(*out)]
        whole = {"k1": c[2], "k2": c[3], "copy": c[4], "s": c[5].astype(np.int32), "e": c[6].astype(np.int32), "first_k1": c[9], "first_k2": c[10]}
        return pa.table({"id": pa.array(c[0], mask=c[1]), "first_id": pa.array(c[7], mask=c[8])} | {k: pa.array(v) for k, v in whole.items()}).select(["id", "k1", "k2", "copy", "s", "e", "first_id", "first_k1", "first_k2"])

    runs = found.mapInArrow(sort, "part int, run binary")
    spans = grouped(runs, "part", places, least_parts).applyInArrow(join, _SPANS)
    return spans.union(_hot_spans(found.where("size(hot) > 0"), min_words)) if hot else spans


_SPANS = "id long, k1 long, k2 long, copy boolean, s int, e int, first_id long, first_k1 long, first_k2 long"


def _hot_spans(found: DataFrame, min_words: int) -> DataFrame:
    """The same for the windows of hot anchors: of each window, its count and its first place are
    partial aggregates of each task, so no group of places meets anywhere."""

    def windows(it):
        import pyarrow as pa

        for batch in it:
            texts = frames.strings(batch, "text")
            for a, b in K.batches(texts):
                w = Words(texts[a:b])
                doc, p, _, near, far = repeated_anchors(w, frames.column(batch, "hot").slice(a, b - a), min_words)
                many = far - near + 1
                start = K.ranges(p - far, many)
                of = np.repeat(doc, many)
                whole = start + min_words <= w.docs[of + 1]
                start, of = start[whole], of[whole]
                one = K.Spans(w.hashes).hash(start, start + min_words)
                two = K.Spans(K.mix(w.hashes ^ np.uint64(0x9E3779B97F4A7C15))).hash(start, start + min_words)
                take = pa.array(of + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *[frames.column(batch, c).take(take) for c in ("id", "k1", "k2")], pa.array((start - w.docs[of]).astype(np.int32))], names=["w1", "w2", "id", "k1", "k2", "s"]
                )

    each = frames.written(found.mapInArrow(windows, "w1 long, w2 long, id long, k1 long, k2 long, s int").distinct())
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "s")
    firsts = each.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("w1", "w2", "first")
    both = each.join(firsts, ["w1", "w2"])
    copy = ~((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("s") == F.col("first.s")))
    return both.select("id", "k1", "k2", copy.alias("copy"), "s", (F.col("s") + min_words).cast("int").alias("e"), F.col("first.id").alias("first_id"), F.col("first.k1").alias("first_k1"), F.col("first.k2").alias("first_k2"))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, is_copy, first_doc_id): the words [start_word, end_word) of the
    text lie in windows of min_words words that occur elsewhere too: in copies, or in the first
    occurrences. first_doc_id is a document in which one of these windows occurs first."""
    spans = _spans(df, id_col, text_col, min_words)
    least = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "first_k1", "first_k2")).alias("first")
    united = islands(spans, ["id", "k1", "k2", "copy"], least).select("id", "k1", "k2", "copy", "s", "e", "first.*")
    if not frames.whole_ids(df, id_col):
        united = frames.named(frames.named(united.drop("id", "first_id"), df, id_col, text_col, "id"), df, id_col, text_col, "first_id", "first_k1", "first_k2")
    return united.select(F.col("id").alias("doc_id"), F.col("s").alias("start_word"), F.col("e").alias("end_word"), F.col("copy").alias("is_copy"), F.col("first_id").alias("first_doc_id"))


def cut_words(texts: list[str], cuts: list[list[tuple[int, int]] | None]) -> list[str]:
    """The texts without the given ranges of words, and without the white space after these."""
    out = list(texts)
    of = [k for k, c in enumerate(cuts) if c]
    for x, y in K.batches([texts[k] for k in of]):
        own = of[x:y]
        cp, doc_starts = K.code_points([texts[k] for k in own])
        starts, _ = K.words(cp, doc_starts)
        docs = np.searchsorted(starts, doc_starts)
        for j, k in enumerate(own):
            begin = (starts[docs[j] : docs[j + 1]] - doc_starts[j]).tolist() + [len(texts[k])]
            kept, at = [], 0
            for s, e in sorted(cuts[k]):
                kept.append(texts[k][at : begin[s]])
                at = begin[e]
            out[k] = "".join(kept) + texts[k][at:]
    return out


def drop_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """df without the copies of passages: the first occurrence of each stays in its text.

    Texts of which nothing but white space is left go, with their rows; other rows stay, and their
    chars_col, if df has it, is the length of what is left. All other columns are as they were.
    """
    spans = islands(_spans(df, id_col, text_col, min_words).where("copy"), ["k1", "k2"])
    a, b, c = frames.unused(df, "_k1", "_k2", "_cuts")
    each = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias(c)).select(F.col("k1").alias(a), F.col("k2").alias(b), c)
    keyed = df.withColumns(dict(zip((a, b), frames.row_key(id_col, text_col))))
    joined = keyed.join(each.hint("merge"), [a, b], "left").drop(a, b)
    cols = df.columns
    chars = next((x for x in cols if x.lower() == chars_col.lower()), None)

    def run(it):
        import pyarrow as pa

        for batch in it:
            cuts = [None if x is None else [(y["s"], y["e"]) for y in x] for x in frames.strings(batch, c)]
            texts = frames.strings(batch, text_col)
            new = cut_words([t or "" for t in texts], cuts)
            new = [None if t is None else n for t, n in zip(texts, new)]
            keep = pa.array([x is None or bool(n.strip()) for x, n in zip(cuts, new)], pa.bool_())
            arrays = [frames.column(batch, x) for x in cols]
            arrays[cols.index(text_col)] = pa.array(new, pa.string())
            if chars:
                k = cols.index(chars)
                old = arrays[k].to_pylist()
                arrays[k] = pa.array([o if x is None else len(n) for o, x, n in zip(old, cuts, new)], arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=cols).filter(keep)

    return joined.mapInArrow(run, df.schema)


