"""PNG files and their reduction against a pixel-by-pixel version."""

import struct
import zlib

import numpy as np
import pytest

from prismet.functions import pictures as P


def packed(x, depth, colour, filters, palette=None, interlaced=False):
    """A PNG file written one byte at a time; filters: by row, in turn."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def lines(x):
        h, w, channels = x.shape
        step = max(1, channels * depth // 8)
        above, out = bytes((w * channels * depth + 7) // 8), b""
        for r in range(h):
            if depth == 16:
                row = b"".join(struct.pack(">H", int(v) * 257) for v in x[r].ravel())
            elif depth == 8:
                row = bytes(int(v) for v in x[r].ravel())
            else:
                bits = "".join(format(int(v), f"0{depth}b") for v in x[r].ravel())
                row = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
            kind, line = filters[r % len(filters)], bytearray()
            for i, v in enumerate(row):
                a, b = row[i - step] if i >= step else 0, above[i]
                c = above[i - step] if i >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
            out += bytes([kind]) + bytes(line)
            above = row
        return out

    h, w, _ = x.shape
    if interlaced:
        raw = b"".join(lines(x[t::d, left::s]) for t, left, d, s in P.PASSES if x[t::d, left::s].size)
    else:
        raw = lines(x)
    body = zlib.compress(raw)
    more = part(b"PLTE", palette.tobytes()) if palette is not None else b""
    return P.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))) + more + part(b"IDAT", body[:7]) + part(b"IDAT", body[7:]) + part(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("filters", [(0,), (1, 2), (4,), (3, 0, 4, 2, 1)])
@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 2), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_decoding(colour, depth, filters, interlaced):
    rng = np.random.default_rng(colour * 20 + depth)
    x = rng.integers(0, min(256, 1 << depth), (11, 13, P.CHANNELS[colour]))
    palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if colour == 3 else None
    got = P.decode_png(packed(x, depth, colour, filters, palette, interlaced))
    if colour == 3:
        want = palette[x[:, :, 0]]
    elif colour in (0, 4):
        want = np.repeat(x[:, :, :1] * (255 // ((1 << depth) - 1) if depth < 8 else 1), 3, axis=2)
    else:
        want = x[:, :, :3]
    assert np.array_equal(got, want)


def plain_reduced(x, w, h):
    """Each output pixel is the mean of the input that it covers, by areas."""
    out = np.zeros((h, w, 3))
    for i in range(h):
        for j in range(w):
            total = area = 0.0
            top, bottom, left, right = i * x.shape[0] / h, (i + 1) * x.shape[0] / h, j * x.shape[1] / w, (j + 1) * x.shape[1] / w
            for r in range(int(top), min(x.shape[0], int(np.ceil(bottom)))):
                for c in range(int(left), min(x.shape[1], int(np.ceil(right)))):
                    share = max(0.0, min(bottom, r + 1) - max(top, r)) * max(0.0, min(right, c + 1) - max(left, c))
                    total, area = total + share * x[r, c], area + share
            out[i, j] = total / area
    return out


@pytest.mark.parametrize("size", [(20, 31), (16, 16), (40, 17), (33, 90)])
def test_reduction_against_a_plain_version(size):
    x = np.random.default_rng(size[0]).integers(0, 256, (*size, 3)).astype(np.uint8)
    got = P.reduced(x, 8)
    w, h = P.reduced_size(size[1], size[0], 8)
    assert got.shape == (h, w, 3) and min(h, w) == 8
    assert np.abs(got - plain_reduced(x, w, h)).max() <= 0.5 + 1e-9


def test_never_enlarged_and_round_trip():
    x = np.random.default_rng(0).integers(0, 256, (5, 9, 3)).astype(np.uint8)
    assert P.reduced(x, 5) is x and P.reduced(x, 100) is x
    assert P.reduced_size(1000, 256, 256) == (1000, 256) and P.reduced_size(3000, 2000, 256) == (384, 256)
    assert np.array_equal(P.decode_png(P.encode_png(x)), x)


def test_damaged_files():
    x = np.zeros((4, 4, 3), np.uint8)
    good = P.encode_png(x)
    for bad in (b"", b"GIF89a", good[:-1], good[:40], good.replace(b"IDAT", b"IDAX"), good[:33] + good[-12:]):
        with pytest.raises(P.NotAPicture):
            P.decode_png(bad)


def test_files_are_downscaled_in_place(spark):
    rng = np.random.default_rng(1)
    large, small = (rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for h, w in ((40, 60), (8, 30)))
    rows = [("a.png", P.encode_png(large), 1), ("b.png", P.encode_png(small), 2), ("c.jpg", b"\xff\xd8 no png", 3), ("d.png", None, 4), ("e.png", b"", 5)]
    got = {r["file"]: r for r in P.downscaled(spark.createDataFrame(rows, "file string, content binary, more int"), 10).collect()}
    assert np.array_equal(P.decode_png(bytes(got["a.png"]["content"])), P.reduced(large, 10)) and (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["reduced"]) == (15, 10, True)
    assert bytes(got["b.png"]["content"]) == rows[1][1] and (got["b.png"]["width"], got["b.png"]["reduced"]) == (30, False)
    assert bytes(got["c.jpg"]["content"]) == rows[2][1] and got["c.jpg"]["width"] is None and got["d.png"]["content"] is None and [got[f]["more"] for f in sorted(got)] == [1, 2, 3, 4, 5]
