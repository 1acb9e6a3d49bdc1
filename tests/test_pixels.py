"""Pixel operators on synthetic textures, and header parsing on bytes made by hand."""

import struct

import numpy as np
import pytest

from provena.sources import metadata, pixels
from provena.sources.pixels import Raster


def smooth(n):
    y, x = np.mgrid[0:n, 0:n] / n
    v = 128 + 60 * np.sin(6 * np.pi * x) + 40 * np.cos(9 * np.pi * y) + 30 * np.sin(13 * np.pi * (x + y)) + 20 * np.sin(25 * np.pi * x * y)
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)


def noisy(n, seed=1.0):
    i, j = np.mgrid[0:n, 0:n]
    r = np.sin(127.1 * j + 311.7 * i + 74.7 * seed) * 43758.5453
    v = 128 + 40 * np.sin(6 * np.pi * j / n + seed) + 20 * np.cos(9 * np.pi * i / n + seed) + (r - np.floor(r) - 0.5) * 100
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)


def checkerboard(n, block=20):
    i, j = np.mgrid[0:n, 0:n] // block
    return np.where((i + j) % 2, 20, 235).astype(np.uint8)


def raster(plane):
    return Raster(np.repeat(plane[:, :, None], 3, axis=2), False)


def shrunk(plane, n):
    return pixels.resize(plane, n, n).astype(np.uint8)


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        a = rng.integers(0, 256, (7, 5, n), dtype=np.uint8)
        got = pixels.decode(pixels.encode_png(a))
        assert (got.data == a).all() and got.has_alpha == (n in (2, 4))
    with pytest.raises(pixels.Undecodable):
        pixels.decode(pixels.encode_png(a)[:40])
    with pytest.raises(pixels.Undecodable):
        pixels.decode(pixels.encode_png(a), max_pixels=10)


def test_png_filters():
    import zlib

    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    flat, lines = want.reshape(5, -1).astype(int), []
    for y in range(5):
        row, up = flat[y], flat[y - 1] if y else np.zeros(18, int)
        left = np.concatenate(([0] * 3, row[:-3]))
        corner = np.concatenate(([0] * 3, up[:-3]))
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros(18, int), left, up, (left + up) // 2, paeth][y]
        lines.append(bytes([y]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, c: struct.pack(">I", len(c)) + k + c + struct.pack(">I", zlib.crc32(k + c))
    data = pixels.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (pixels.decode(data).data == want).all()


def test_dct_is_orthonormal():
    c = pixels.dct_basis(32)
    assert np.allclose(c @ c.T, np.eye(32))


def test_hashes_survive_resizing_and_see_turning():
    a, b, c = raster(smooth(320)), raster(shrunk(smooth(320), 120)), raster(checkerboard(320))
    for f in (pixels.difference_hash, pixels.perceptual_hash):
        assert distance(f(a), f(b)) <= 6 < 10 < distance(f(a), f(c))
        for t in pixels.TRANSFORMS:
            assert f(a, t) == f(Raster(pixels.turn(a.data, t), False))


def test_similarity_and_confirmation():
    a, b = raster(smooth(320)), raster(shrunk(smooth(320), 140))
    assert pixels.similarity(a, a, 256) == pytest.approx(1.0)
    assert pixels.confirm(a, b, 0.96)[2] == "none" and pixels.confirm(a, b, 0.96)[0] > 0.96
    turned = Raster(pixels.turn(a.data, "rotate180"), False)
    score, scale, transform = pixels.confirm(a, turned, 0.96)
    assert transform == "rotate180" and score > 0.96 and scale == 256
    assert pixels.confirm(a, turned, 0.96, rotate=False)[0] < 0.5
    assert pixels.confirm(a, raster(checkerboard(320)), 0.96)[0] < 0.5


def test_crop_is_found_where_it_was_cut():
    full = smooth(400)
    crop = raster(full[40:360, 40:360])
    found = pixels.find_crop(raster(full), crop)
    assert found["correlation"] >= 0.85 and found["ssim"] >= 0.75
    assert abs(found["box"]["left"] - 0.1) < 0.04 and abs(found["box"]["width"] - 0.8) < 0.05 and abs(found["retained_area"] - 0.64) < 0.08
    other = pixels.find_crop(raster(full), raster(noisy(320)))
    assert other is None or other["ssim"] < 0.75


def test_upscales_have_no_more_detail():
    large, small = noisy(500), shrunk(noisy(500), 120)
    s, big, up = pixels.upscale_features(raster(large), raster(small))
    assert big / up >= 1.15
    fake = raster(shrunk(noisy(120), 500))
    s, big, up = pixels.upscale_features(fake, raster(noisy(120)))
    assert s >= 0.9 and big / up < 1.15


def test_alpha_and_colour():
    a = np.full((4, 4, 4), 200, np.uint8)
    assert pixels.meaningful_alpha(Raster(a, True)) and not pixels.meaningful_alpha(Raster(np.full((4, 4, 4), 255, np.uint8), True))
    assert pixels.channel_means(Raster(a, True)) == [200.0] * 4


def test_orientation_is_undone():
    a = np.arange(6).reshape(2, 3)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, 3), 7: np.rot90(a, 2).T, 8: np.rot90(a, 1)}
    for o, w in want.items():
        assert (pixels.auto_orient(a, o) == w).all(), o


def tiff(order, texts, sub=()):
    """A TIFF block with text tags in the first directory and in the one it points to."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    n = len(texts) + bool(sub) + 1
    at = 8 + 2 + 12 * n + 4
    body, tail = b"", b""
    sub_at = at + sum(len(t) + 1 for _, t in texts)
    for tag, t in texts:
        raw = t.encode() + b"\0"
        body += pack("HHI", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else pack("I", at + len(tail)))
        tail += raw
    tail = tail.ljust(sub_at - at, b"\0")
    body += pack("HHI", 0x0112, 3, 1) + pack("HH", 6, 0)
    if sub:
        body += pack("HHII", 0x8769, 4, 1, sub_at)
        inner, texts_at = b"", sub_at + 2 + 12 * len(sub) + 4
        rest = b""
        for tag, t in sub:
            raw = t.encode() + b"\0"
            inner += pack("HHII", tag, 2, len(raw), texts_at + len(rest))
            rest += raw
        tail += pack("H", len(sub)) + inner + pack("I", 0) + rest
    return (b"II" if order == "<" else b"MM") + pack("HI", 42, 8) + pack("H", n) + body + pack("I", 0) + tail


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    block = tiff(order, [(0x010F, "Maker"), (0x0110, "X1"), (0x0132, "2020:01:01 00:00:00")], [(0x9003, "2019:05:06 07:08:09")])
    assert metadata.parse_exif(block) == {"camera_make": "Maker", "camera_model": "X1", "capture_date": "2019:05:06 07:08:09", "orientation": 6}
    for bad in (None, b"", b"XX", block[:20], b"II*\0\xff\xff\xff\xff"):
        assert metadata.parse_exif(bad) == {}


def test_headers():
    assert metadata.dimensions(pixels.encode_png(np.zeros((3, 9, 4)))) == (9, 3)
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 8) + b"Exif\0\0" + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 20, 30, 3) + b"\xff\xd9"
    assert metadata.read_header(jpeg) | {"exif": None} == {"format": "jpeg", "has_alpha": False, "icc": False, "exif": None, "xmp": False, "iptc": False, "width": 30, "height": 20, "bit_depth": 8, "channels": 3}
    assert metadata.dimensions(b"GIF89a" + struct.pack("<HH", 7, 8) + b"\0" * 5) == (7, 8)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + bytes([16, 0, 0, 0]) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert metadata.dimensions(webp) == (100, 50) and metadata.read_header(webp)["has_alpha"]
    assert metadata.dimensions(b"\0\0\0\x1cftypavif....ispe\0\0\0\0" + struct.pack(">II", 5, 6)) == (5, 6)
    assert metadata.dimensions(b"junk") is None
