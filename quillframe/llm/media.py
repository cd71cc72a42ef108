"""Media columns: Netpbm and BMP images decoded to arrays, resized by area, kept as NPY tiles.

Formats: PBM, PGM, PPM in plain and raw form (P1 to P6, samples of 8 or 16 bits) and Windows BMP
(1, 4, 8 bits with a palette, 16, 24 and 32 bits, also with bit fields of their own, bottom-up or
top-down, uncompressed). A tile has
TILE x TILE pixels; each is the mean of the image's area that it covers, fractions of pixels
included, read off an integral image. The difference hash has 64 bits: in the image resized to 9 x 8
grey pixels, each bit tells whether a pixel is brighter than its left neighbour.

Defined results: NULL gives NULL everywhere; so do bytes that aren't an image of these formats, or
hold fewer pixels than they say, with the reason in `media_error`. Images of one pixel are enlarged
like others. Rows are independent: repeated rows get equal tiles, empty tables give empty ones; an
image of any size is used whole (in memory: eight bytes a sample). Columns of the outputs' names are
replaced.
"""

from __future__ import annotations

import io
import re
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField

from . import frames

TILE = 32
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise ValueError("bad header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    top = head[2] if len(head) > 2 else 1
    if not w or not h or not 0 < top < 65536:
        raise ValueError("bad size")
    channels = 3 if kind in (3, 6) else 1
    n = w * h * channels
    if kind <= 3:
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        if kind == 1:
            x = np.frombuffer(re.sub(rb"\s+", b"", body)[:n], np.uint8).astype(np.int64) - 48
        else:
            x = np.array(body.split()[:n], np.int64)
    elif kind == 4:
        row = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: row * h]
        if len(raw) < row * h:
            raise ValueError("too few pixels")
        x = np.unpackbits(raw.reshape(h, row), axis=1)[:, :w].ravel().astype(np.int64)
    else:
        size = 2 if top > 255 else 1
        x = np.frombuffer(data[at + 1 : at + 1 + n * size], ">u2" if size == 2 else np.uint8)
    if len(x) < n:
        raise ValueError("too few pixels")
    if kind in (1, 4):
        x = 1 - x
    if x.max(initial=0) > top or x.min(initial=0) < 0:
        raise ValueError("sample out of range")
    if top != 255:
        x = (x.astype(np.int64) * 255 + top // 2) // top
    return x.astype(np.uint8).reshape(h, w, channels)


def _field(value: np.ndarray, mask: int, bits: int) -> np.ndarray:
    """One colour of pixels whose bits a mask says, as bytes; colours without bits are 0."""
    if not mask:
        return np.zeros(value.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    if top & (top + 1) or mask >> bits:
        raise ValueError("bad bit fields")
    return ((((value & mask) >> low) * 255 + top // 2) // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    offset, size, w, h, planes, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    used = struct.unpack_from("<I", data, 46)[0]
    if packed not in (0, 3) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or (packed == 3 and bits not in (16, 32)):
        raise ValueError("unsupported BMP")
    down, h = h < 0, abs(h)
    if w <= 0 or not h:
        raise ValueError("bad size")
    row = (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, offset=offset)[: row * h]
    if len(raw) < row * h:
        raise ValueError("too few pixels")
    raw = raw.reshape(h, row)
    if packed == 3 or bits == 16:
        value = np.ascontiguousarray(raw[:, : w * bits // 8]).view(f"<u{bits // 8}").astype(np.int64)
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        x = np.stack([_field(value, m, bits) for m in masks], 2)
    elif bits >= 24:
        step = bits // 8
        x = raw[:, : w * step].reshape(h, w, step)[:, :, 2::-1]
    else:
        palette = np.frombuffer(data, np.uint8, (used or 1 << bits) * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        index = np.unpackbits(raw, axis=1).reshape(h, -1, bits) if bits < 8 else raw[:, :w]
        if bits < 8:
            index = (index.astype(np.int64) << np.arange(bits)[::-1]).sum(2)[:, :w]
        if index.max(initial=0) >= len(palette):
            raise ValueError("color out of range")
        x = palette[index]
    return x if down else x[::-1]


def decode(data: bytes) -> np.ndarray:
    """The pixels of an image: height x width x (1 or 3) bytes."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError("truncated header") from e
    raise ValueError("not Netpbm or BMP")


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole parts and fractions of the m + 1 borders of m equal pieces of n pixels."""
    at = np.arange(m + 1) * n
    return at // m, (at % m) / m


def integral(x: np.ndarray) -> np.ndarray:
    """Sums of all pixels above and left of each corner."""
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1, x.shape[2]))
    np.cumsum(x, axis=0, out=s[1:, 1:], dtype=np.float64)
    np.cumsum(s[1:, 1:], axis=1, out=s[1:, 1:])
    return s


def resize(s: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal pieces of the image of an integral image; fractions by interpolation,
    which is exact, since the integral is linear within a pixel."""
    n, m = s.shape[0] - 1, s.shape[1] - 1
    y, fy = _edges(n, height)
    x, fx = _edges(m, width)
    rows = s[y] + (s[np.minimum(y + 1, n)] - s[y]) * fy[:, None, None]
    both = rows[:, x] + (rows[:, np.minimum(x + 1, m)] - rows[:, x]) * fx[:, None]
    sums = np.diff(np.diff(both, axis=0), axis=1)
    return sums * (height * width / (n * m))


def difference_hash(s: np.ndarray) -> int:
    """64 bits as a signed integer, first bit highest."""
    grey = resize(s, 8, 9)
    grey = grey[:, :, 0] if grey.shape[2] == 1 else grey @ np.array([0.299, 0.587, 0.114])
    bits = np.round(grey[:, 1:], 6) > np.round(grey[:, :-1], 6)
    return int(np.packbits(bits).view(">i8")[0])


def npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(x), allow_pickle=False)
    return out.getvalue()


def tile(data: bytes, size: int = TILE) -> tuple[int, int, int, bytes, int]:
    """(height, width, channels, NPY bytes, difference hash) of an image."""
    x = decode(data)
    s = integral(x)
    small = np.clip(np.floor(resize(s, size, size) + 0.5), 0, 255).astype(np.uint8)
    return x.shape[0], x.shape[1], x.shape[2], npy(small), difference_hash(s)


def tiles(df: DataFrame, image_col: str = "image", size: int = TILE) -> DataFrame:
    """df with height, width, channels, tile (NPY bytes), dhash and media_error."""

    def make(batch):
        import pyarrow as pa

        rows = []
        for value in frames.column(batch, image_col):
            data = value.as_py()
            if data is None:
                rows.append((None,) * 6)
                continue
            try:
                rows.append((*tile(data, size), None))
            except ValueError as e:
                rows.append((None,) * 5 + (str(e)[:200],))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string())
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    fields = [StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("channels", IntegerType()), StructField("tile", BinaryType()), StructField("dhash", LongType()), StructField("media_error", StringType())]
    return frames.add_columns(df, make, fields)


def _little(value: Column) -> Column:
    """An integer as 4 bytes, lowest first."""
    h = F.lpad(F.hex(value), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def rendered(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with an image column made of the bytes of its whole texts: PGM, PPM, PBM, and BMP of 24 and
    8 bits in turn by id. The tables have no images; this makes a media column of their size."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    gray = "".join(f"{k:02x}{k:02x}{k:02x}00" for k in range(256))

    def framed(row: int) -> tuple[Column, Column]:
        h = F.greatest(F.lit(1), F.ceil(n / row)).cast("int")
        return h, F.rpad(raw, h * row, F.lit(b"\0"))

    def pnm(magic: str, width: int, row: int, tail: str) -> Column:
        h, body = framed(row)
        return F.concat(F.encode(F.concat(F.lit(f"{magic}\n{width} "), h.cast("string"), F.lit(f"\n{tail}")), "UTF-8"), body)

    def bmp(width: int, row: int, bits: int, palette: str) -> Column:
        h, body = framed(row)
        head = 54 + len(palette) // 2
        return F.concat(
            F.unhex(F.lit("424d")), _little(h * row + head), F.unhex(F.lit("00000000")), _little(F.lit(head)), _little(F.lit(40)), _little(F.lit(width)), _little(h),
            F.unhex(F.lit(f"0100{bits:02x}00" + "00" * 24 + palette)), body,
        )

    kind = F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(5))
    image = (
        F.when(F.col(text_col).isNull(), F.lit(None))
        .when(kind == 0, pnm("P5", 64, 64, "255\n"))
        .when(kind == 1, pnm("P6", 64, 192, "255\n"))
        .when(kind == 2, pnm("P4", 512, 64, ""))
        .when(kind == 3, bmp(64, 192, 24, ""))
        .otherwise(bmp(64, 64, 8, gray))
    )
    return df.withColumn("image", image)
