"""Byte-pair encoding and decoding with a vocabulary given as ranks.

Every pre-token keeps its live symbols in a linked list and the ranks of its adjacent pairs in the
leaves of a segment tree of minima. The root is the lowest rank at its leftmost place; a merge
changes at most three leaves, so each takes a logarithmic number of point updates, until the root
says that no pair is left. The trees of thousands of different pre-tokens are worked on together,
one merge of each per round; of a very long pre-token there are seldom several, so the same tree is
worked on alone. What a pre-token gives is kept for later batches (as many as KEPT), since it
depends on nothing else; it is found by a hash and compared byte by byte.

Defined results: NULL text gives NULL ids and NULL count; empty text gives no ids. Texts of any
length are encoded whole. Rows are independent: repeated rows give repeated results, an empty table
an empty one. Ids that are NULL or not in the vocabulary decode to U+FFFD, as do bytes that aren't
UTF-8. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from . import frames, kernels as K

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_NONE = np.iinfo(np.int32).max
#: Pre-tokens of more bytes than this are merged one at a time.
_ALONE = 256
#: Bytes of different pre-tokens that a task keeps the ids of, about; beyond, it starts anew.
KEPT = 2 << 20


class Vocabulary:
    """Ranks, the pairs that merge, and a hash table of these for whole arrays of lookups."""

    def __init__(self, content: bytes, alone: bytes | None = None):
        #: For each rank whether its string was proved to encode alone as this token.
        self.alone = None if alone is None else np.unpackbits(np.frombuffer(alone, np.uint8)).astype(bool)
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        get = self.ranks.get
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = get(t[:i]), get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        self._table(np.array(keys, np.int64), np.array(values, np.int32))
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = int(max(8, len(keys) * 4)).bit_length()
        self._shift = np.uint64(64 - bits)
        self._keys = np.full((1 << bits) + 64, -1, np.int64)
        self._values = np.full((1 << bits) + 64, _NONE, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self._keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self._keys[slot[put]], self._values[slot[put]] = keys[put], values[put]
            left = left[self._keys[slot[left]] != keys[left]]
            slot[left] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); _NONE where they don't merge."""
        keys = (a.astype(np.int64) << 32) | b
        slot = self._slot(keys)
        found = self._keys[slot]
        out = self._values[slot]
        miss = np.flatnonzero((found != keys) & (found >= 0))
        out[(found != keys)] = _NONE
        while len(miss):
            slot[miss] += 1
            found = self._keys[slot[miss]]
            hit = found == keys[miss]
            out[miss[hit]] = self._values[slot[miss[hit]]]
            miss = miss[~hit & (found >= 0)]
        return out

    def merge_alone(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the same segment tree, for one piece of any length."""
        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        width = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        tree = [none] * (2 * width)
        known: dict[tuple[int, int], int | None] = {}

        def pair(ab: tuple[int, int]) -> int | None:
            if ab not in known:
                r = int(self.rank(np.array(ab[:1]), np.array(ab[1:]))[0])
                known[ab] = None if r == _NONE else r
            return known[ab]

        for i in range(n - 1):
            r = pair((ids[i], ids[i + 1]))
            if r is not None:
                tree[width + i] = (r, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def put(i: int, r: int | None) -> None:
            k = width + i
            tree[k] = none if r is None else (r, i)
            k >>= 1
            while k:
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
                k >>= 1

        while tree[1] is not none and tree[1][0] < 1 << 62:
            r, i = tree[1]
            j = after[i]
            ids[i], live[j], after[i] = r, False, after[j]
            put(j, None)
            if after[i] < n:
                before[after[i]] = i
            put(i, pair((r, ids[after[i]])) if after[i] < n else None)
            if before[i] >= 0:
                put(before[i], pair((ids[before[i]], r)))
        return [x for x, on in zip(ids, live) if on]

    def _merge_many(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Merges each row of ids (rows x width, a power of 2) in place; returns which slots live."""
        rows, width = ids.shape
        bits = width.bit_length() - 1
        place = np.arange(width, dtype=np.int32)
        live = place < lens[:, None]
        tree = np.full((rows, 2 * width), _NONE, np.int32)
        r, c = np.nonzero(place[: width - 1] + 1 < lens[:, None])
        rank = self.rank(ids[r, c], ids[r, c + 1])
        ok = rank != _NONE
        tree[r[ok], width + c[ok]] = (rank[ok] << bits) | c[ok]
        k = width >> 1
        while k:
            np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
            k >>= 1
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (rows, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (rows, 1))
        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            root = tree[row, 1]
            i, rank = root & (width - 1), root >> bits
            j = after[row, i]
            n = after[row, j]
            p = before[row, i]
            ids[row, i] = rank
            live[row, j] = False
            after[row, i] = n
            before[row, n] = i
            tree[row, width + j] = _NONE
            leaf = np.full(len(row), _NONE, np.int32)
            has = np.flatnonzero(n < lens[row])
            got = self.rank(rank[has], ids[row[has], n[has]])
            ok = got != _NONE
            leaf[has[ok]] = (got[ok] << bits) | i[has[ok]]
            tree[row, width + i] = leaf
            has = np.flatnonzero(p >= 0)
            got = self.rank(ids[row[has], p[has]], rank[has])
            tree[row[has], width + p[has]] = np.where(got != _NONE, (got << bits) | p[has], _NONE)
            nodes = [width + i, width + j, width + np.where(p >= 0, p, i)]
            for _ in range(bits):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[row, x] = np.minimum(tree[row, 2 * x], tree[row, 2 * x + 1])
            row = row[tree[row, 1] != _NONE]
        return live

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece data[start:end] has, and all their ids in a row."""
        size = (ends - starts).astype(np.int64)
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        width = 1
        while width <= _ALONE:
            of = np.flatnonzero((size > width // 2) & (size <= width))
            step = max(1, (1 << 19) // width)
            for at in range(0, len(of), step):
                own = of[at : at + step]
                ids = np.zeros((len(own), width), np.int32)
                inside = np.arange(width) < size[own, None]
                ids[inside] = self.byte_ids[data[K.ranges(starts[own], size[own])]]
                live = self._merge_many(ids, size[own]) if width > 1 else inside
                counts[own] = live.sum(1)
                parts.append((own, ids[live]))
            width *= 2
        for k in np.flatnonzero(size > _ALONE):
            got = np.array(self.merge_alone(data[starts[k] : ends[k]].tobytes()), np.int32)
            counts[k] = len(got)
            parts.append((np.array([k]), got))
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(at[-1], np.int32)
        for own, ids in parts:
            flat[K.ranges(at[own], counts[own])] = ids
        return counts, flat

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the length of each; unknown ids give U+FFFD."""
        known = (ids >= 0) & (ids < len(self.tokens))
        at = np.where(known, ids, 0)
        bad = ~known | (self.lengths[at] == 0)
        table = np.concatenate([self.bytes, np.frombuffer("�".encode(), np.uint8)])
        lengths = np.where(bad, 3, self.lengths[at])
        return table[K.ranges(np.where(bad, len(self.bytes), self.offsets[at]), lengths)], lengths

    def prove(self) -> bytes:
        """Which of the vocabulary's strings encode alone as one token, by merging each: a bit a rank."""
        counts, _ = self.encode_pieces(self.bytes, self.offsets[:-1], self.offsets[1:])
        return np.packbits(counts == 1).tobytes()


def pretokens(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of '(?:[sdmt]|ll|ve|re)| ?letters| ?numbers| ?others|white space,
    whose last character is left to what follows it."""
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    c = K.classes()[cp]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    begin = first[:n].copy()
    begin[1:] |= c[1:] != c[:-1]
    space = c == K.SPACE
    last = np.zeros(n, bool)  # white space before something else in the same text
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    taken = np.zeros(n, bool)
    taken[1:] = last[:-1] & (cp[:-1] == 0x20)
    begin |= last
    begin &= ~taken
    quote = np.flatnonzero((cp == 0x27) & begin)
    if len(quote):
        padded = np.concatenate([cp, np.zeros(3, np.uint32)])
        inside = np.concatenate([~first[:n], np.zeros(3, bool)])  # goes on in the same text
        a, b = padded[quote + 1], padded[quote + 2]
        one = inside[quote + 1] & np.isin(a, [ord(x) for x in "stmd"])
        two = inside[quote + 1] & inside[quote + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        begin[quote[one | two] + 1] = False
        for at in (quote[one] + 2, quote[two] + 3):
            begin[at[at < n]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes batches of texts; remembers what each different pre-token gave."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()
        self._whole = None

    def _forget(self) -> None:
        self._hashes = np.empty(0, np.uint64)
        self._slots = np.empty(0, np.int64)
        self._counts = np.empty(0, np.int64)
        self._offsets = np.zeros(1, np.int64)
        self._flat = np.empty(0, np.int32)
        self._bytes, self._ends = np.empty(0, np.uint8), np.zeros(1, np.int64)

    def _ids_of(self, hashes: np.ndarray, first: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of the pre-tokens data[a:b] at `first`, which have different hashes."""
        a, b = a[first], b[first]
        if len(self._bytes) > KEPT:
            self._forget()
        at = np.searchsorted(self._hashes, hashes)
        new = np.ones(len(hashes), bool)
        ok = at < len(self._hashes)
        new[ok] = self._hashes[at[ok]] != hashes[ok]
        if new.any():
            counts, flat = self.vocabulary.encode_pieces(data, a[new], b[new])
            slots = len(self._counts) + np.arange(len(counts))
            self._hashes = np.insert(self._hashes, at[new], hashes[new])
            self._slots = np.insert(self._slots, at[new], slots)
            self._counts = np.concatenate([self._counts, counts])
            self._offsets = np.concatenate([self._offsets, self._offsets[-1] + np.cumsum(counts)])
            self._flat = np.concatenate([self._flat, flat])
            self._bytes = np.concatenate([self._bytes, data[K.ranges(a[new], b[new] - a[new])]])
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(b[new] - a[new])])
            at = np.searchsorted(self._hashes, hashes)
        slot = self._slots[at]
        counts, flat = self._counts[slot], self._flat[K.ranges(self._offsets[slot], self._counts[slot])]
        if not same_bytes(data, a, b, self._bytes, self._ends[slot], self._ends[slot + 1]):
            counts, flat = self.vocabulary.encode_pieces(data, a, b)  # equal hashes of different strings
        return counts, flat

    def _different(self, texts: list[str]):
        """The bytes of all texts, where their pre-tokens start and end, which pre-token texts start with,
        and of the different pre-tokens their hashes, first places, and which one each is."""
        cp, doc_starts = K.code_points(texts)
        starts = pretokens(cp, doc_starts)
        ends = np.concatenate([starts[1:], [len(cp)]]).astype(np.int64) if len(starts) else starts
        hashes, first, which = np.unique(K.Spans(cp).hash(starts, ends), return_index=True, return_inverse=True)
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        place = np.concatenate([[0], np.cumsum(K.utf8_lengths(cp))])
        a, b = place[starts], place[ends]
        if not same_bytes(data, a, b, data, a[first][which], b[first][which]):
            first = which = np.arange(len(starts))  # equal hashes of different strings: each by itself
            hashes = None
        return data, a, b, np.searchsorted(starts, doc_starts), hashes, first, which

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text start (one more than texts), and all ids in a row."""
        data, a, b, docs, hashes, first, which = self._different(texts)
        if hashes is None:
            counts, flat = self.vocabulary.encode_pieces(data, a, b)
        else:
            counts, flat = self._ids_of(hashes, first, data, a, b)
        at = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(counts[which])])
        return total[docs], flat[K.ranges(at[which], counts[which])]

    def _whole_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes, and ranks, of the strings that are proved to encode alone as one token."""
        if self._whole is None:
            v = self.vocabulary
            alone = v.alone if v.alone is not None else np.unpackbits(np.frombuffer(v.prove(), np.uint8)).astype(bool)
            ranks, texts = [], []
            for k in np.flatnonzero(alone[: len(v.tokens)]).tolist():
                try:
                    texts.append(v.tokens[k].decode())
                    ranks.append(k)
                except UnicodeDecodeError:
                    continue
            cp, at = K.code_points(texts)
            h = K.Spans(cp).hash(at[:-1], at[1:])
            order = np.argsort(h)
            self._whole = h[order], np.array(ranks, np.int64)[order]
        return self._whole

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text: whole tokens count one without being merged."""
        data, a, b, docs, hashes, first, which = self._different(texts)
        counts = np.ones(len(first), np.int64)
        one = np.zeros(len(first), bool)
        whole, ranks = self._whole_tokens()
        if hashes is not None and len(whole):
            at = np.minimum(np.searchsorted(whole, hashes), len(whole) - 1)
            one = whole[at] == hashes
            of, v = ranks[at[one]], self.vocabulary
            if not same_bytes(data, a[first[one]], b[first[one]], v.bytes, v.offsets[of], v.offsets[of + 1]):
                one[:] = False
        rest = np.flatnonzero(~one)
        if len(rest):
            counts[rest] = self._ids_of(hashes[rest], first[rest], data, a, b)[0] if hashes is not None else self.vocabulary.encode_pieces(data, a, b)[0]
        total = np.concatenate([[0], np.cumsum(counts[which])])
        return np.diff(total[docs])


def same_bytes(x: np.ndarray, xa: np.ndarray, xb: np.ndarray, y: np.ndarray, ya: np.ndarray, yb: np.ndarray) -> bool:
    """Whether the strings x[xa:xb] and y[ya:yb] are equal, each to each."""
    size = xb - xa
    return np.array_equal(size, yb - ya) and np.array_equal(x[K.ranges(xa, size)], y[K.ranges(ya, size)])


_loaded: dict[int, Vocabulary] = {}


def loaded(content: bytes, alone: bytes | None = None) -> Vocabulary:
    """The vocabulary, made once in each process."""
    key = zlib.crc32(content)
    if key not in _loaded or (alone is not None and _loaded[key].alone is None):
        _loaded.clear()
        _loaded[key] = Vocabulary(content, alone)
    return _loaded[key]


@lru_cache(maxsize=4)
def proved(content: bytes) -> bytes:
    """Vocabulary.prove(), done once for a vocabulary by the driver before any text is read."""
    return loaded(content).prove()


def _content(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def _broadcast(df: DataFrame, vocabulary: str):
    return df.sparkSession.sparkContext.broadcast(_content(vocabulary))  # a vocabulary: about a megabyte, whatever the corpus


def _encoded(encoder: Encoder, texts: list):
    """Arrow lists of the ids of texts."""
    import pyarrow as pa

    plain = [t or "" for t in texts]
    starts, parts, total = [np.zeros(1, np.int64)], [], 0
    for a, b in K.batches(plain):
        at, ids = encoder.encode(plain[a:b])
        starts.append(at[1:] + total)
        parts.append(ids)
        total += len(ids)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    mask = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(starts).astype(np.int32)), pa.array(flat), mask=mask)


def _decoded(vocab: Vocabulary, lists):
    """Arrow strings of the texts that lists of ids stand for."""
    import pyarrow as pa

    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    data, lengths = vocab.decode(ids)
    at = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
    raw = data.tobytes()
    nulls = lists.is_null().to_pylist()
    return pa.array([None if no else raw[a:b].decode("utf-8", "replace") for no, a, b in zip(nulls, at[:-1].tolist(), at[1:].tolist())], pa.string())


_IDS = ArrayType(IntegerType())


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, decoded_col: str | None = None) -> DataFrame:
    """df with the token ids of its texts as an array of integers; with decoded_col, also with what
    these ids decode to, in the same pass."""
    content = _broadcast(df, vocabulary)
    state: dict = {}

    def make(batch):
        if "encoder" not in state:
            state["encoder"] = Encoder(loaded(content.value))
        ids = _encoded(state["encoder"], frames.strings(batch, text_col))
        return [ids] if decoded_col is None else [ids, _decoded(state["encoder"].vocabulary, ids)]

    return frames.add_columns(df, make, [StructField(ids_col, _IDS)] + ([] if decoded_col is None else [StructField(decoded_col, StringType())]))


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """df with the texts that its arrays of token ids stand for."""
    content = _broadcast(df, vocabulary)
    return frames.add_columns(df, lambda batch: [_decoded(loaded(content.value), frames.column(batch, ids_col))], [StructField(text_col, StringType())])
