"""PNG files as arrays, and their reduction by area averages, in numpy over Arrow batches."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type, and the places and steps of the passes of an interlaced picture (fixed values of the format).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
SHORT_EDGE = 256
MOST_PIXELS = 1 << 28


class NotAPicture(ValueError):
    """The bytes are no whole PNG file of a kind that is read here."""


def chunks(data: bytes):
    """(kind, body) of the parts of a PNG file; checksums are tested."""
    if not data.startswith(SIGNATURE):
        raise NotAPicture("no PNG signature")
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(body) < length or len(data) < at + 12 + length or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise NotAPicture("a damaged part")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + length
    raise NotAPicture("no end")


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the rows whose filters are undone. kinds: filter of each row; step: bytes from a pixel to the next.

    Without average and Paeth filters, rows are sums (along a row, or down). These two need the pixel to the left, so pictures with them are undone along
    diagonals: all pixels of one diagonal have their left and upper neighbours on the two before it."""
    h, n = rows.shape
    if not h or not n:
        return rows
    if not np.isin(kinds, (3, 4)).any():
        out = np.empty_like(rows)
        above = np.zeros(n, np.uint8)
        for r in range(h):
            row = rows[r]
            if kinds[r] == 1:
                row = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            elif kinds[r] == 2:
                row = row + above
            out[r] = above = row
        return out
    w = n // step
    given = rows.reshape(h, w, step).astype(np.int16)
    out = np.zeros((h + 1, w + 1, step), np.int16)  # with a row above and a pixel to the left, all zero
    kind = kinds[:, None]
    r = np.arange(h)
    for t in range(h + w - 1):
        on = r[max(0, t - w + 1) : min(h, t + 1)]
        c = t - on
        left, up, corner, k = out[on + 1, c], out[on, c + 1], out[on, c], kind[on]
        p = left + up - corner
        a, b, d = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, paeth, 0))))
        out[on + 1, c + 1] = (given[on, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, n)


def samples(data: bytes, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, bytes]:
    """(height, width, channels) of the first rows in the unpacked data, and the data after them; 16 bits give their upper 8."""
    line = (width * channels * depth + 7) // 8
    need = height * (line + 1)
    if len(data) < need:
        raise NotAPicture("too few rows")
    rows = np.frombuffer(data, np.uint8, need).reshape(height, line + 1)
    if (rows[:, 0] > 4).any():
        raise NotAPicture("an unknown filter")
    body = unfiltered(rows[:, 0], rows[:, 1:], max(1, channels * depth // 8))
    if depth == 16:
        body = body.reshape(height, -1, 2)[:, :, 0]
    elif depth < 8:
        bits = np.unpackbits(body, axis=1).reshape(height, -1, depth)
        body = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return body[:, : width * channels].reshape(height, width, channels), data[need:]


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG file; grey is repeated, a palette looked up, transparency left out."""
    head, palette, packed = None, None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise NotAPicture("no head")
    width, height, depth, colour, _, _, interlaced = head
    if colour not in CHANNELS or not width or not height or width * height > MOST_PIXELS:
        raise NotAPicture(f"{width} x {height} pixels of colour type {colour}")
    channels = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise NotAPicture(str(e)) from e
    if interlaced:
        x = np.zeros((height, width, channels), np.uint8)
        for top, left, down, right in PASSES:
            h, w = len(range(top, height, down)), len(range(left, width, right))
            if h and w:
                x[top::down, left::right], raw = samples(raw, w, h, depth, channels)
    else:
        x, _ = samples(raw, width, height, depth, channels)
    if colour == 3:
        if palette is None or int(x.max()) >= len(palette):
            raise NotAPicture("a colour beyond the palette")
        return palette[x[:, :, 0]]
    if colour in (0, 4):
        if depth < 8:
            x = x * (255 // ((1 << depth) - 1))
        return np.repeat(x[:, :, :1], 3, axis=2)
    return x[:, :, :3]


def encode_png(x: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) bytes."""
    h, w, _ = x.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(x, dtype=np.uint8).reshape(h, 3 * w)], axis=1)
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + part(b"IEND", b"")


def averaged(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    """n area averages along an axis: each output covers an equal stretch of the input, cut pixels counting by their share."""
    x = np.moveaxis(np.asarray(x, np.float64), axis, 0)
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    edge = np.arange(n + 1) * (len(x) / n)
    whole = np.minimum(edge.astype(np.int64), len(x) - 1)
    at = total[whole] + (edge - whole).reshape(-1, *[1] * (x.ndim - 1)) * x[whole]
    return np.moveaxis((at[1:] - at[:-1]) / (len(x) / n), 0, axis)


def reduced_size(width: int, height: int, short: int) -> tuple[int, int]:
    """Width and height with a short edge of `short`; never more than they are."""
    scale = short / min(width, height)
    return (max(1, round(width * scale)), max(1, round(height * scale))) if scale < 1 else (width, height)


def reduced(x: np.ndarray, short: int = SHORT_EDGE) -> np.ndarray:
    """A picture whose short edge is at most `short`, by area averages, rounded half up."""
    w, h = reduced_size(x.shape[1], x.shape[0], short)
    if (h, w) == x.shape[:2]:
        return x
    return np.floor(averaged(averaged(x, h, 0), w, 1) + 0.5).astype(np.uint8)


def downscaled(files: DataFrame, short: int = SHORT_EDGE, column: str = "content") -> DataFrame:
    """The files with their contents reduced, and width, height (of the new content; null where it is no PNG file that is read here) and
    reduced. Contents that are small enough, or no PNG, stay as they are, byte by byte. Other columns are kept."""
    names = files.columns
    out = T.StructType([*files.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("reduced", T.BooleanType())])

    def one(data: bytes | None):
        try:
            x = decode_png(data or b"")
        except NotAPicture:
            return data, None, None, False
        small = reduced(x, short)
        return (data if small is x else encode_png(small)), small.shape[1], small.shape[0], small is not x

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a picture at a time: unpacked, one may have a gigabyte
                row = batch.slice(i, 1)
                content, width, height, changed = one(row.column(names.index(column))[0].as_py())
                columns = [pa.array([content], pa.binary()) if n == column else row.column(k) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([changed])], names=[*names, "width", "height", "reduced"])

    return files.mapInArrow(task, out)
