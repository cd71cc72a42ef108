"""Repeated substrings by matching statistics on compressed FM-indexes.

Shards are made by content, not by document: the words around a text's anchors (see repeats) go to
the shard of the anchor's hash, so the occurrences of any passage of `min_words` words meet in one
shard and every text is compared with all others without being sent to all shards. Within a shard
one text's places are united, so that no word of it is there twice. The shard's index is

* the Burrows-Wheeler transform of the words in a wavelet matrix of packed bits with block counts,
* the lengths of the prefixes that neighbouring suffixes share.

Its sequences stream through it by backward search, many pieces of them at a time: the matching
statistics say how many words from each place occur twice. A piece starts from what the suffix at its
end shares with its neighbours, so no passage ends at a piece's end. (Other texts are streamed by
matches().)

A passage is found whole, whatever its length and the number of shards: windows of min_words, twice,
four times as many words and so on have anchors of their own, and where a longest match of `size` to
2 * size words may start, 2 * size words go to the shard of the anchor of its first `size` words.
A longest match starts where not all occurrences have the same word before, or at a text's start:
that is seen by hashes from the word before an anchor's first window to the anchor. As any repeated
window is part of such a match, nothing else need be sent.

Equal places are indexed twice and searched once, which changes no answer to "at least two".

Defined results: as in suffixes; NULL or short texts have no passage, equal rows are one text, rows
with NULL or repeated ids are told apart by 128 bits of id and text, white space between words
doesn't count, texts of any length are searched whole, an empty table gives an empty one, and other
columns, whatever their names, play no part.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import frames, kernels as K
from .repeats import GRAM, MIN_WORDS, Once, Words, anchors, grouped, islands, pack, part_count, part_of, sources, unpack

#: Bytes of places that a task holds before it sends them.
SEND_BYTES = 16 << 20
#: A place is several hundred words on average: it counts as so many of repeats.PART_PLACES.
PLACE_WEIGHT = 8
#: Words of a sequence that stream in one piece.
PIECE = 64


#: The bits below each of a block.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with rank: 64-bit blocks and the ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.blocks), np.int64)
        np.cumsum(np.bitwise_count(self.blocks[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        k = i >> 6
        return self.before.take(k) + np.bitwise_count(self.blocks.take(k) & BELOW.take(i & 63))


class Wavelet:
    """A wavelet matrix over small integers: rank of a symbol in a prefix, for arrays of both."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.levels: list[tuple[Bits, int]] = []
        s = symbols
        self.depth = max(1, int(count - 1).bit_length())
        for level in reversed(range(self.depth)):
            bit = (s >> level) & 1
            zeros = np.flatnonzero(bit == 0)
            self.levels.append((Bits(bit), len(zeros)))
            s = np.concatenate([s[zeros], s[bit == 1]])
        self.first = self._walk(np.arange(count), np.zeros(count, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in zip(reversed(range(self.depth)), self.levels):
            one = bits.rank(i)
            i = np.where((symbol >> level & 1).astype(bool), zeros + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before position i; i may have several rows of positions."""
        return self._walk(symbol, i) - self.first[symbol]


class Index:
    """FM-index of sequences of words (word >= 1); no match goes from one sequence to the next."""

    def __init__(self, words: np.ndarray, sequence_ends: np.ndarray, count: int):
        n, s = len(words) + len(sequence_ends), len(sequence_ends)
        text = np.zeros(n, np.int64)  # 0 ends a sequence
        separators = sequence_ends + np.arange(s)
        is_word = np.ones(n, bool)
        is_word[separators] = False
        text[is_word] = words
        longest = int(np.diff(sequence_ends, prepend=0).max()) + 1 if s else 1
        # prefix doubling, from as many words as a sort key holds; every separator is a symbol of its own.
        # A rank is the first place of those that are still equal, and only these are sorted on: they
        # share words only, so what follows them is inside.
        value = text + s - 1
        value[separators] = np.arange(s)
        bits = (count + s).bit_length()
        head = max(1, 63 // bits)
        key = np.zeros(n, np.int64)
        for k in range(head):
            key <<= bits
            key[: max(0, n - k)] |= value[k:]
        live = np.argsort(key)
        key, old, rank = key[live], 0, np.zeros(n, np.int32)
        levels, k = [], head
        while True:
            rank = rank.copy()
            rank[live] += (_group_starts(key) - old).astype(np.int32)
            levels.append(rank)
            live = live[_shared(key)]
            if not len(live) or k > longest:
                break
            key = (rank[live].astype(np.int64) << 32) + rank[live + k]
            by = np.argsort(key)
            live, key = live[by], key[by]
            old = _group_starts(key >> 32)
            k *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        # what neighbouring suffixes share is compared where the words before them differ; from a place
        # to the next one in the text it is one word less where they are the same
        last = text[suffixes - 1]
        differ = np.ones(n, bool)
        differ[1:] = (last[1:] != last[:-1]) | (last[1:] == 0)
        pair = np.flatnonzero(differ)
        pair = pair[pair > 0]
        a, b = suffixes[pair - 1], suffixes[pair]
        reach = np.zeros(n, np.int64)
        reach[suffixes[:1]] = suffixes[:1]
        for level in reversed(range(len(levels))):
            r = levels[level]
            same = np.flatnonzero(r[a] == r[b])
            a[same] += head << level
            b[same] += head << level
        for _ in range(head - 1):
            same = np.flatnonzero(value[a] == value[b])
            a[same] += 1
            b[same] += 1
        reach[suffixes[pair]] = b
        kind = np.uint8 if longest < 1 << 7 else np.uint16 if longest < 1 << 15 else np.int32
        lcp = np.zeros(n + 1, kind)  # lcp[i]: shared by suffixes i - 1 and i
        lcp[:n] = (np.maximum.accumulate(reach) - np.arange(n))[suffixes]
        self.rank = rank
        self.n, self.lcp, self.suffixes, self.count = n, lcp, suffixes, count
        self.text, self.is_word, self.ends, self.last = text, is_word, sequence_ends, last
        self.starts = np.concatenate([[0, s], s + np.cumsum(np.bincount(words, minlength=count)[1:count])])[: count + 1]

    @cached_property
    def least(self) -> list[np.ndarray]:
        """The lcp, then the lesser of each two of them, of these and so on up to one."""
        levels = [self.lcp]
        while len(levels[-1]) > 1:
            below = np.append(levels[-1], levels[-1][-1:]) if len(levels[-1]) & 1 else levels[-1]
            levels.append(np.minimum(below[::2], below[1::2]))
        return levels

    def smaller(self, i: np.ndarray, side: int) -> np.ndarray:
        """The next places before (side 0) or after (side 1) others, where some words are shared, that
        share fewer."""
        most, node, out = self.lcp[i], i, np.empty(len(i), np.int64)
        wait, found = np.arange(len(i)), []
        for values in self.least:
            # up, until the sibling on that side has one
            beside = node + 2 * side - 1
            has = np.flatnonzero(((node & 1) != side) & (values.take(beside, mode="clip") < most[wait]))
            found.append((wait[has], beside[has]))
            go = np.ones(len(wait), bool)
            go[has] = False
            wait, node = wait[go], node[go] >> 1
            if not len(wait):
                break
        own, node = found.pop()
        while found:
            # down, to the child nearest to the place
            values = self.least[len(found) - 1]
            node = 2 * node + 1 - side
            node = np.where(values.take(node, mode="clip") < most[own], node, node + 2 * side - 1)
            more, at = found.pop()
            own, node = np.concatenate([own, more]), np.concatenate([node, at])
        out[own] = node
        return out

    @cached_property
    def transform(self) -> Wavelet:
        return Wavelet(self.last, self.count)

    def passages(self, sequences: int, least: int):
        """(sequence, position, length) of the longest repeated passages of the first `sequences` indexed
        ones, from positions that can't be continued to the left: whole, however long they are."""
        ms = self.statistics(sequences)
        starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[:sequences] + np.arange(sequences)
        at = np.flatnonzero(ms >= least)
        seq = np.searchsorted(starts, at, "right") - 1
        begins = (at == starts[seq]) | (ms[at - 1] != ms[at] + 1)
        at, seq = at[begins], seq[begins]
        return seq, at - starts[seq], ms[at]

    def statistics(self, sequences: int) -> np.ndarray:
        """Matching statistics of the first `sequences` indexed ones: for each place in the text how many
        words from there occur elsewhere too. All stream by backward search in pieces of PIECE words, a
        word of each piece at a time. Where a piece starts, and where a passage can't be continued, the
        search goes on from what the place's suffix shares with its neighbours."""
        base = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[:sequences] + np.arange(sequences)
        lengths = np.diff(self.ends[:sequences], prepend=0)
        pieces = -(-lengths // PIECE)
        first = K.ranges(np.zeros(len(pieces), np.int64), pieces) * PIECE
        size = np.minimum(PIECE, np.repeat(lengths, pieces) - first)
        order = np.argsort(-size)
        size, at = size[order], (np.repeat(base, pieces) + first + size)[order]
        lo, hi, q = self.own(at)
        ms = np.zeros(self.n, np.int64)
        for m in np.searchsorted(-size, -np.arange(1, PIECE + 1), "right").tolist():
            # the first m pieces have so many words
            at, q = at[:m] - 1, q[:m] + 1
            lo, hi = self.search(self.text[at], lo[:m], hi[:m])
            fail = np.flatnonzero(hi - lo < 2)
            lo[fail], hi[fail], q[fail] = self.own(at[fail])
            ms[at] = q
        return ms

    def longest(self, at: np.ndarray) -> np.ndarray:
        """How many words from a place in the text occur elsewhere too."""
        r = self.rank[at]
        return np.maximum(self.lcp[r], self.lcp[r + 1]).astype(np.int64)

    def search(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the passages that have one more word in front."""
        lo, hi = self.starts[word] + self.transform.rank(word, np.stack([lo, hi]))
        return lo, hi

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider intervals, and for how many words their suffixes agree."""
        return self.around(np.where(self.lcp[lo] >= self.lcp[hi], lo, hi))

    def around(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of all suffixes that share as much as the ones at i and before do, and how much."""
        most = self.lcp[i].astype(np.int64)
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), self.n)
        some = np.flatnonzero(most)
        lo[some], hi[some] = self.smaller(i[some], 0), self.smaller(i[some], 1)
        return lo, hi, most

    def own(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of the longest passages from places in the text that occur elsewhere too, and how
        long they are: what their suffixes share with their neighbours."""
        r = self.rank[at]
        return self.around(r + (self.lcp[r] < self.lcp[r + 1]))

    def matches(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int):
        """(sequence, position, length) of the longest repeated passages from a position that can't
        be continued to the left, of at least `least` words.

        Long sequences stream in pieces that overlap by least - 1 words, so each window of `least`
        words is in one piece; a passage is then reported in parts that overlap.
        """
        step = 4 * max(PIECE, least) - least + 1
        pieces = np.maximum(1, -((least - 1 - lengths) // step))
        seq = np.repeat(np.arange(len(lengths)), pieces)
        first = K.ranges(np.zeros(len(pieces), np.int64), pieces) * step
        stop = starts[seq] + first
        at = starts[seq] + np.minimum(first + step + least - 1, lengths[seq])
        lo, hi, q = np.zeros(len(seq), np.int64), np.full(len(seq), self.n, np.int64), np.zeros(len(seq), np.int64)
        fresh = np.zeros(len(seq), bool)  # the passage from `at` is the longest there
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(at > stop)
        while len(live):
            a, b = self.search(words[at[live] - 1], lo[live], hi[live])
            ok = b - a >= 2
            own = live[ok]
            lo[own], hi[own] = a[ok], b[ok]
            q[own] += 1
            at[own] -= 1
            fresh[own] = True
            done = own[(at[own] == stop[own]) & (q[own] >= least)]
            fail = live[~ok]
            ended = np.concatenate([done, fail[fresh[fail] & (q[fail] >= least)]])
            out.append((seq[ended], at[ended] - starts[seq[ended]], q[ended]))
            fresh[fail] = False
            root = q[fail] == 0
            at[fail[root]] -= 1
            fail = fail[~root]
            if len(fail):
                lo[fail], hi[fail], q[fail] = self.parent(lo[fail], hi[fail])
            live = live[at[live] > stop[live]]
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """For each of some sorted keys where its equals start."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _shared(sorted_keys: np.ndarray) -> np.ndarray:
    """Which of some sorted keys occur more than once."""
    new = np.ones(len(sorted_keys) + 1, bool)
    new[1:-1] = sorted_keys[1:] != sorted_keys[:-1]
    return ~(new[:-1] & new[1:])


def word_runs(hashes: np.ndarray, docs: np.ndarray, over: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of more than `over` equal words start and end; docs: where texts start."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(hashes) + 1, bool)
    new[1:-1] = hashes[1:] != hashes[:-1]
    new[docs] = True
    at = np.flatnonzero(new)
    size = np.diff(at)
    return at[:-1][size > over], at[1:][size > over]


def _scales(w: Words, min_words: int):
    """(size, base, position, text, hash, head hash, forced, near, far) of the anchors of windows of
    min_words, 2 min_words, 4 min_words and so on words, as far as the texts reach.

    The head hash is that of the words from one before the anchor's first window: where all
    occurrences of the anchor agree in it, no longest match starts in the anchor's windows.
    """
    size = min_words
    while True:
        # only texts with a window of that size
        docs = np.flatnonzero(np.diff(w.docs) >= size)
        if not len(docs):
            return
        begin, count = w.docs[docs], w.docs[docs + 1] - w.docs[docs]
        hashes, own = (w.hashes, w.docs) if len(docs) == len(w.docs) - 1 else (w.hashes[K.ranges(begin, count)], np.concatenate([[0], np.cumsum(count)]))
        gram = min(size, max(GRAM, size * GRAM // MIN_WORDS))
        spans = K.Spans(hashes)
        at, h, near, far = anchors(hashes, own, size, gram, spans)
        doc = np.searchsorted(own, at, "right") - 1
        h = K.mix(h + np.uint64(size) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
        start = at - far - 1
        forced = start < own[doc]
        head = K.mix(spans.hash(np.maximum(start, own[doc]), at + gram) + K.mix(h + forced.astype(np.uint64))) >> np.uint64(1)
        yield size, at + (begin - own[:-1])[doc], docs[doc], h, head, forced, near, far
        size *= 2


def _candidates(df: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, int]:
    """(id, k1, k2, text, places array): texts, and which of their words (hash, start, end) are to be
    compared where; and how many such places there are in all texts.

    A text is named by the first half of its row's name here: another text of the same half sends the
    same places too, which are compared like others.
    """
    if not 1 <= min_words < 1 << 16:
        raise ValueError("min_words must be from 1 to 65535")
    src = sources(df, id_col, text_col)

    def run(it):
        import pyarrow as pa

        for batch in it:
            texts, k1 = frames.strings(batch, "text"), frames.column(batch, "k1").to_numpy(zero_copy_only=False)
            for a, b in K.batches(texts):
                w = Words(texts[a:b])
                for size, p, doc, h, head, forced, near, far in _scales(w, min_words):
                    # long runs of one word: only their ends, in which all other windows that they touch are
                    first, last = word_runs(w.hashes, w.docs, 2 * size)
                    k = np.searchsorted(first, p, "right") - 1
                    inside = k >= 0
                    inside[inside] = (p[inside] > first[k[inside]]) & (p[inside] < last[k[inside]] - 2 * size)
                    x = np.flatnonzero(inside)
                    x = x[np.lexsort((head[x], doc[x]))]
                    new = np.ones(len(x), bool)
                    new[1:] = (doc[x[1:]] != doc[x[:-1]]) | (head[x[1:]] != head[x[:-1]])
                    of = np.concatenate([np.flatnonzero(~inside), x[new]])
                    times = np.concatenate([np.ones(len(of) - new.sum(), np.int64), np.diff(np.append(np.flatnonzero(new), len(x)))])
                    start = p - far - w.docs[doc]
                    end = np.minimum(p - near + 2 * size, w.docs[doc + 1]) - w.docs[doc]
                    end[inside] = 0
                    cols = [k1[a + doc[of]], h[of].view(np.int64), head[of].view(np.int64), forced[of], start[of].astype(np.int32), end[of].astype(np.int32), times.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k1", "h", "head", "forced", "s", "e", "times"])

    rows = frames.written(src.mapInArrow(run, "k1 long, h long, head long, forced boolean, s int, e int, times int"))
    # counted before they meet, as in candidates(): partial sums of each task, and joins whose skew can be split
    heads = rows.groupBy("h", "head").agg(F.sum("times").alias("same"))
    often = heads.groupBy("h").agg(F.sum("same").alias("n")).where("n > 1")
    chosen = heads.join(often, "h").select("head", "h", (F.col("same") < F.col("n")).alias("starts"))
    found = rows.where("e > 0").select("k1", "head", "forced", "s", "e").join(chosen, "head").where("forced or starts")
    each = frames.written(found.groupBy("k1").agg(F.collect_set(F.struct("h", "s", "e")).alias("places")))
    return src.join(each.hint("merge"), "k1").select("id", "k1", "k2", "text", "places"), each.agg(F.sum(F.size("places"))).first()[0] or 0


def _places(w: Words, lists):
    """(text, hash, start, end) of the places in an Arrow array of lists, among all words."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    flat = lists.flatten()
    h, s, e = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    base, top = w.docs[doc], w.docs[doc + 1]
    return doc, h, np.minimum(base + s, top), np.minimum(base + e, top)


def _spans(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, k1, k2, s, e, longest): passages found, not yet united."""
    least_shards = frames.partitions(df.sparkSession)
    found, places = _candidates(df, id_col, text_col, min_words)
    shards = part_count(places * PLACE_WEIGHT, least_shards)

    def send(it):
        import pyarrow as pa

        held: list[tuple] = []
        runs: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal size
            meta = np.concatenate([m for m, _ in held])
            texts = [t for _, ts in held for t in ts]
            direct = np.concatenate(runs)
            names = np.unique(np.concatenate([meta[:, 0], direct[:, 0]]))
            order = np.argsort(meta[:, 0], kind="stable")
            cut = np.searchsorted(meta[order, 0], np.append(names, names[-1:] + 1))
            blobs = []
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                own = order[a:b]
                pieces = [texts[x] for x in own.tolist()]
                blobs.append(pack(meta[own, 1:], np.array([len(x) for x in pieces], np.int64), b"".join(pieces), direct[direct[:, 0] == names[k], 1:]))
            held.clear(), runs.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "places"])

        once = Once()
        for batch in map(once.filter, it):
            texts = frames.strings(batch, "text")
            ids, (k1, k2) = frames.column(batch, "id"), (frames.column(batch, c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            lists = frames.column(batch, "places")
            for a, b in K.batches(texts):
                w = Words(texts[a:b])
                data, at = w.joined()
                doc, h, s, e = _places(w, lists.slice(a, b - a))
                shard = part_of(h, shards)
                # a long run of one word repeats itself: it is reported at once
                first, last = word_runs(w.hashes, w.docs, 2 * min_words)
                own = np.searchsorted(w.docs, first, "right") - 1
                runs.append(np.stack([np.mod(k1[a + own], shards), nulls[a + own], ids[a + own], k1[a + own], k2[a + own], first - w.docs[own], last - w.docs[own]], 1).astype(np.int64))
                order = np.lexsort((e, s, doc, shard))
                doc, shard, s, e = doc[order], shard[order], s[order], e[order]
                group = shard * (b - a) + doc
                # running end within a shard and text: groups are made disjoint first
                shift = (np.cumsum(np.diff(group, prepend=group[:1]) != 0)) * (len(w.starts) + 1)
                reach = np.maximum.accumulate(e + shift)
                new = np.ones(len(s), bool)
                new[1:] = (s + shift)[1:] > reach[:-1]
                first = np.flatnonzero(new)
                end = (reach - shift)[np.append(first[1:], len(s)) - 1] if len(first) else first
                s, doc, shard = s[first], doc[first], shard[first]
                meta = np.stack([shard, nulls[a + doc], ids[a + doc], k1[a + doc], k2[a + doc], s - w.docs[doc]], 1).astype(np.int64)
                cutouts = [data[x:y] for x, y in zip(at[s].tolist(), at[end].tolist())]
                held.append((meta, cutouts))
                size += sum(map(len, cutouts)) + 100 * len(cutouts)
                if size > SEND_BYTES:
                    yield flush()
        if held:
            yield flush()

    def search(key, table):
        return search_shard(table.column("places").to_pylist(), min_words)

    blobs = found.mapInArrow(send, "shard int, places binary")
    return grouped(blobs, "shard", places * PLACE_WEIGHT, least_shards).applyInArrow(search, "id long, k1 long, k2 long, s int, e int, longest int")


def search_shard(blobs: list[bytes], min_words: int):
    """The passages of a shard's places: (id, k1, k2, s, e, longest) as an Arrow table."""
    import pyarrow as pa

    metas, lengths, parts, direct = [], [], [], []
    for blob in blobs:
        meta, size, data, runs = unpack(blob, np.int64, np.int64, None, np.int64)
        metas.append(meta.reshape(-1, 5))
        lengths.append(size)
        parts.append(data)
        direct.append(runs.reshape(-1, 6))
    meta, size = np.concatenate(metas), np.concatenate(lengths)
    data = np.frombuffer(b"".join(parts), np.uint8)
    del parts
    end = np.cumsum(size)
    whole = K.hash_spans(data, end - size, end).view(np.int64)
    # equal rows of the table give one place
    order = np.lexsort((whole, meta[:, 4], meta[:, 3], meta[:, 2]))
    rows = np.column_stack([meta, whole])[order]
    keep = np.ones(len(order), bool)
    keep[1:] = (rows[1:] != rows[:-1]).any(1)
    own = order[keep]
    _, first, which, times = np.unique(whole[own], return_index=True, return_inverse=True, return_counts=True)
    kind = own[first]
    order = np.argsort(kind)
    kind, times = kind[order], times[order]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    which = back[which]
    data = data[K.ranges(end[kind] - size[kind], size[kind])]
    stop = np.flatnonzero(data == 0x20)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    hashes = K.hash_spans(data, start, stop)
    names, words = np.unique(hashes, return_inverse=True)
    words = words + 1
    ends = np.searchsorted(stop, np.cumsum(size[kind]))
    lens = np.diff(ends, prepend=0)
    twice = np.flatnonzero(times > 1)
    again = words[K.ranges(ends[twice] - lens[twice], lens[twice])]
    index = Index(np.concatenate([words, again]), np.concatenate([ends, len(words) + np.cumsum(lens[twice])]), len(names) + 1)
    seq, pos, longest = index.passages(len(lens), min_words)
    # to every text that has the place
    by = np.argsort(which, kind="stable")
    at = np.searchsorted(which[by], np.arange(len(kind) + 1))
    n = at[seq + 1] - at[seq]
    rows = own[by[K.ranges(at[seq], n)]]
    s = meta[rows, 4] + np.repeat(pos, n)
    longest = np.repeat(longest, n)
    found = np.column_stack([meta[rows, :4], s, s + longest, longest])
    # a run of n equal words repeats n - 1 of them
    direct = np.unique(np.concatenate(direct), axis=0)
    found = np.concatenate([found, np.column_stack([direct, direct[:, 5] - direct[:, 4] - 1])])
    whole = {"k1": found[:, 2], "k2": found[:, 3], "s": found[:, 4].astype(np.int32), "e": found[:, 5].astype(np.int32), "longest": found[:, 6].astype(np.int32)}
    return pa.table({"id": pa.array(found[:, 1], mask=found[:, 0] != 0)} | {k: pa.array(v) for k, v in whole.items()})


def repeated_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, longest_match): intervals of words that are covered by passages
    of at least min_words words which occur twice or more; longest_match is the longest of these."""
    united = islands(_spans(df, id_col, text_col, min_words), ["id", "k1", "k2"], F.max("longest").alias("longest"))
    if not frames.whole_ids(df, id_col):
        united = frames.named(united.drop("id"), df, id_col, text_col, "id")
    return united.select(F.col("id").alias("doc_id"), F.col("s").alias("start_word"), F.col("e").alias("end_word"), F.col("longest").alias("longest_match"))
