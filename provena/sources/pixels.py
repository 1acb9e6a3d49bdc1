"""Pixels in NumPy: PNG codec, resizing, hashes, structural similarity, detail, crops.

Formats without a codec here raise Undecodable; callers turn that into a
recorded error.  Pillow, where it is installed, adds its formats.
"""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
TRANSFORMS = ("rotate180", "flipHorizontal", "flipVertical")
GRID = 32
# Fixed values of crop detection: share of the width a crop keeps, and the offsets tried, in grid cells.
CROP_WIDTHS = range(16, 32, 2)
CROP_LIMITS = (16, 31)
CROP_OFFSETS = (-1.0, -0.5, 0.0, 0.5, 1.0)
CROP_SCALE = 128


class Undecodable(ValueError):
    """No codec here reads this content."""


@dataclass
class Raster:
    """Pixels as height x width x channels, 0 to 255; alpha, if any, is the last channel."""

    data: np.ndarray
    has_alpha: bool

    @property
    def width(self) -> int:
        return self.data.shape[1]

    @property
    def height(self) -> int:
        return self.data.shape[0]


# --- Codec ---------------------------------------------------------------------------


def png_chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    rows = raw.reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int32)
        if kind == 1:  # differences to the left: a running sum per channel
            pad = -len(line) % step
            line = np.cumsum(np.pad(line, (0, pad)).reshape(-1, step), axis=0).ravel()[: len(line)] & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            for x in range(stride):
                left = line[x - step] if x >= step else 0
                corner = above[x - step] if x >= step else 0
                up = above[x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                line[x] = (line[x] + guess) & 255
        elif kind:
            raise Undecodable(f"filter type {kind}")
        out[y] = line
        above = out[y].astype(np.int32)
    return out


def decode_png(data: bytes) -> Raster:
    if not data.startswith(SIGNATURE):
        raise Undecodable("not a PNG")
    try:
        parts = list(png_chunks(data))
        head = next(c for k, c in parts if k == b"IHDR")
        width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head)
        if interlaced or kind not in CHANNELS or depth not in (1, 2, 4, 8, 16):
            raise Undecodable("an unsupported kind of PNG")
        n = CHANNELS[kind]
        stride = (width * n * depth + 7) // 8
        raw = np.frombuffer(zlib.decompress(b"".join(c for k, c in parts if k == b"IDAT")), np.uint8)
        lines = _unfilter(raw, height, stride, max(1, n * depth // 8))
        if depth == 16:
            lines = lines.reshape(height, -1, 2)[:, :, 0]
        elif depth < 8:
            bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
            lines = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)[:, : width * n]
            if kind != 3:
                lines = lines * (255 // ((1 << depth) - 1))
        pixels = lines[:, : width * n].reshape(height, width, n)
        see_through = next((c for k, c in parts if k == b"tRNS"), None)
        if kind == 3:
            palette = np.frombuffer(next(c for k, c in parts if k == b"PLTE"), np.uint8).reshape(-1, 3)
            colours = palette[pixels[:, :, 0]]
            if see_through is not None:
                alpha = np.full(256, 255, np.uint8)
                alpha[: len(see_through)] = np.frombuffer(see_through, np.uint8)
                colours = np.dstack([colours, alpha[pixels[:, :, 0]]])
            return Raster(colours, see_through is not None)
        return Raster(pixels, kind in (4, 6))
    except (StopIteration, ValueError, zlib.error, struct.error, IndexError) as e:
        raise Undecodable(str(e) or "damaged PNG") from e


def encode_png(data: np.ndarray) -> bytes:
    data = np.ascontiguousarray(data, np.uint8)
    if data.ndim == 2:
        data = data[:, :, None]
    h, w, n = data.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), data.reshape(h, w * n)], axis=1)
    chunk = lambda k, c: struct.pack(">I", len(c)) + k + c + struct.pack(">I", zlib.crc32(k + c))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes, max_pixels: int = 100_000_000) -> Raster:
    from provena.sources.metadata import dimensions

    size = dimensions(data)
    if size and size[0] * size[1] > max_pixels:
        raise Undecodable(f"{size[0]}x{size[1]} exceeds the limit of {max_pixels} pixels")
    if data.startswith(SIGNATURE):
        return decode_png(data)
    try:
        from PIL import Image
    except ImportError:
        raise Undecodable("no codec for this format") from None
    try:
        image = Image.open(io.BytesIO(data))
        alpha = image.mode in ("RGBA", "LA") or "transparency" in image.info
        return Raster(np.asarray(image.convert("RGBA" if alpha else "RGB")), alpha)
    except Exception as e:
        raise Undecodable(str(e)) from e


# --- Resizing ------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def _kernel(source: int, target: int) -> np.ndarray:
    """Rows of Lanczos-3 weights that map ``source`` samples to ``target``."""
    scale = source / target
    support = 3.0 * max(1.0, scale)
    centre = (np.arange(target) + 0.5) * scale
    x = (np.arange(source) + 0.5)[None, :] - centre[:, None]
    x = x / max(1.0, scale)
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    w[np.abs((np.arange(source) + 0.5)[None, :] - centre[:, None]) > support] = 0
    return w / w.sum(axis=1, keepdims=True)


def resize(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Stretch to exactly width x height."""
    out = np.tensordot(_kernel(plane.shape[0], height), plane.astype(float), axes=(1, 0))
    out = np.moveaxis(np.tensordot(_kernel(plane.shape[1], width), out, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255)


def grey(r: Raster) -> np.ndarray:
    d = r.data[:, :, :-1] if r.has_alpha and r.data.shape[2] > 1 else r.data
    return d[:, :, 0].astype(float) if d.shape[2] == 1 else d[:, :, :3].astype(float) @ np.array([0.2126, 0.7152, 0.0722])


def rgba(r: Raster) -> np.ndarray:
    colour = r.data[:, :, :-1] if r.has_alpha else r.data
    colour = np.repeat(colour, 3, axis=2) if colour.shape[2] == 1 else colour[:, :, :3]
    alpha = r.data[:, :, -1:] if r.has_alpha else np.full((*r.data.shape[:2], 1), 255, np.uint8)
    return np.concatenate([colour, alpha], axis=2)


def turn(a: np.ndarray, transform: str) -> np.ndarray:
    if transform == "rotate180":
        return a[::-1, ::-1]
    if transform == "flipHorizontal":
        return a[:, ::-1]
    return a[::-1] if transform == "flipVertical" else a


def auto_orient(a: np.ndarray, orientation: int | None) -> np.ndarray:
    steps = {2: (False, 0, True), 3: (False, 2, False), 4: (False, 2, True), 5: (True, 0, False), 6: (False, 3, False), 7: (True, 2, False), 8: (False, 1, False)}
    if orientation not in steps:
        return a
    swap, turns, mirror = steps[orientation]
    out = np.swapaxes(a, 0, 1) if swap else np.rot90(a, turns)
    if swap and turns:
        out = np.rot90(out, 2)
    return out[:, ::-1] if mirror else out


# --- Hashes -----------------------------------------------------------------------------------


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel().astype(np.uint8)).tobytes().hex()


@lru_cache(maxsize=4)
def dct_basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II matrix."""
    k = np.arange(n)[:, None]
    m = np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def difference_hash(r: Raster, transform: str = "none") -> str:
    g = resize(turn(grey(r), transform), 9, 8)
    return _hex(g[:, :-1] < g[:, 1:])


def perceptual_hash(r: Raster, transform: str = "none") -> str:
    c = dct_basis(GRID)
    low = (c @ resize(turn(grey(r), transform), GRID, GRID) @ c.T)[:8, :8]
    return _hex(low > np.median(low))


# --- Similarity -----------------------------------------------------------------------------------


def _blur(a: np.ndarray, radius: int = 5, sigma: float = 1.5) -> np.ndarray:
    g = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    g /= g.sum()
    rows = sum(w * a[i : a.shape[0] - 2 * radius + i] for i, w in enumerate(g))
    return sum(w * rows[:, i : rows.shape[1] - 2 * radius + i] for i, w in enumerate(g))


def ssim(x: np.ndarray, y: np.ndarray) -> float:
    """Mean structural similarity of two planes of equal size (Gaussian window, usual constants)."""
    if min(x.shape) < 11:
        pad = [(0, max(0, 11 - n)) for n in x.shape]
        x, y = np.pad(x, pad, mode="edge"), np.pad(y, pad, mode="edge")
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = _blur(x), _blur(y)
    vx, vy, cov = _blur(x * x) - mx * mx, _blur(y * y) - my * my, _blur(x * y) - mx * my
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def luma_at(r: Raster, scale: int, transform: str = "none", orientation: int | None = None) -> np.ndarray:
    a = resize(auto_orient(rgba(r), orientation), scale, scale)
    return turn(a[:, :, :3] @ np.array([0.299, 0.587, 0.114]), transform)


def similarity(a: Raster, b: Raster, scale: int, transform: str = "none", orientations: tuple = (None, None)) -> float:
    return ssim(luma_at(a, scale, orientation=orientations[0]), luma_at(b, scale, transform, orientations[1]))


def confirm(a: Raster, b: Raster, threshold: float, rotate: bool = True, orientations: tuple = (None, None)) -> tuple[float, int, str]:
    """(similarity, scale, transform): at 256 px, finer where it is worthwhile, turned where it does not reach the threshold."""
    scale, transform = 256, "none"
    score = similarity(a, b, 256, "none", orientations)
    fine = min(a.width, a.height, b.width, b.height, 1024)
    if fine > 256 and score >= 0.5:
        score, scale = similarity(a, b, fine, "none", orientations), fine
    if rotate and score < threshold:
        turned = [(similarity(a, b, 256, t, orientations), t) for t in TRANSFORMS]
        best = max(turned, key=lambda x: x[0])
        if best[0] > score:
            score, scale, transform = best[0], 256, best[1]
    return score, scale, transform


def channel_means(r: Raster) -> list[float]:
    return [float(x) for x in r.data.reshape(-1, r.data.shape[2]).mean(axis=0)]


def meaningful_alpha(r: Raster) -> bool:
    return r.has_alpha and int(r.data[:, :, -1].min()) < 250


def detail_score(r: Raster, width: int, height: int) -> float:
    """Standard deviation of the (clipped) Laplacian of the grey image at the given size."""
    g = np.pad(resize(grey(r), width, height), 1, mode="edge")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(np.clip(lap, 0, 255).std())


def upscale_features(large: Raster, small: Raster) -> tuple[float, float, float]:
    """(similarity at the small size, detail of the large, detail of the small enlarged)."""
    w, h = min(large.width, 512), min(large.height, 512)
    return similarity(large, small, min(small.width, small.height, 256)), detail_score(large, w, h), detail_score(small, w, h)


# --- Crops --------------------------------------------------------------------------------------------


def _correlations(full: np.ndarray, crop: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Correlation of the crop's grid with every box (left, top, width, height) of the full grid, all at once."""
    step = np.arange(GRID) / GRID
    xs = np.minimum(GRID - 1, boxes[:, 0, None] + np.floor(step * boxes[:, 2, None]).astype(int))
    ys = np.minimum(GRID - 1, boxes[:, 1, None] + np.floor(step * boxes[:, 3, None]).astype(int))
    views = full[ys[:, :, None], xs[:, None, :]].reshape(len(boxes), -1)
    views = views - views.mean(axis=1, keepdims=True)
    target = crop.ravel() - crop.mean()
    norm = np.sqrt((views**2).sum(axis=1) * (target**2).sum())
    return np.divide(views @ target, norm, out=np.zeros(len(boxes)), where=norm > 0)


def _box_height(width: int, aspect: float) -> int:
    return min(GRID, max(1, round(width / aspect)))


def best_box(full: np.ndarray, crop: np.ndarray, aspect: float) -> tuple[float, tuple[int, int, int, int]]:
    """Coarse search over widths and places, then the neighbourhood of the best box at single steps."""
    coarse = [(x, y, w, h) for w in CROP_WIDTHS for h in [_box_height(w, aspect)] for y in range(0, GRID - h + 1, 2) for x in range(0, GRID - w + 1, 2)]
    boxes = np.array(coarse)
    scores = _correlations(full, crop, boxes)
    x0, y0, w0, _ = boxes[scores.argmax()]
    near = {tuple(boxes[scores.argmax()])}
    for w in {int(np.clip(w0 + d, *CROP_LIMITS)) for d in range(-2, 3)}:
        h = _box_height(w, aspect)
        near |= {(int(np.clip(x0 + dx, 0, GRID - w)), int(np.clip(y0 + dy, 0, GRID - h)), w, h) for dx in range(-2, 3) for dy in range(-2, 3)}
    boxes = np.array(sorted(near))
    scores = _correlations(full, crop, boxes)
    return float(scores.max()), tuple(int(v) for v in boxes[scores.argmax()])


def find_crop(full: Raster, crop: Raster, least_correlation: float = 0.85) -> dict | None:
    """Where ``crop`` lies in ``full``: correlation, similarity, box as shares of the full frame, retained area."""
    correlation, box = best_box(resize(grey(full), GRID, GRID), resize(grey(crop), GRID, GRID), crop.width / crop.height)
    if correlation < least_correlation:
        return None
    cell = np.array([full.width, full.height, full.width, full.height]) / GRID
    left, top, width, height = np.rint(np.array(box) * cell)
    target = luma_at(crop, CROP_SCALE)
    tried = []
    for dx in CROP_OFFSETS:
        for dy in CROP_OFFSETS:
            x = int(np.clip(round(left + dx * cell[0]), 0, full.width - 1))
            y = int(np.clip(round(top + dy * cell[1]), 0, full.height - 1))
            w, h = int(np.clip(width, 1, full.width - x)), int(np.clip(height, 1, full.height - y))
            view = Raster(full.data[y : y + h, x : x + w], full.has_alpha)
            tried.append((ssim(luma_at(view, CROP_SCALE), target), (x, y, w, h)))
    score, (x, y, w, h) = max(tried, key=lambda t: t[0])
    shares = {"left": x / full.width, "top": y / full.height, "width": w / full.width, "height": h / full.height}
    return {"correlation": correlation, "ssim": score, "box": shares, "retained_area": w * h / (full.width * full.height)}


# --- Report assets ------------------------------------------------------------------------------------------


def thumbnail(r: Raster, most: int = 320) -> np.ndarray:
    scale = min(1.0, most / max(r.width, r.height))
    return resize(rgba(r), max(1, round(r.width * scale)), max(1, round(r.height * scale))).astype(np.uint8)


def detail_crops(r: Raster) -> tuple[np.ndarray, np.ndarray]:
    """(centre crop, the most detailed cell of a 4x4 raster of crops), both 320 px square."""
    side = min(r.width, r.height, 512)
    full = rgba(r)
    cut = lambda x, y: full[y : y + side, x : x + side]
    places = [(round(i * (r.width - side) / 3), round(j * (r.height - side) / 3)) for j in range(4) for i in range(4)]
    sharpest = max(dict.fromkeys(places), key=lambda p: detail_score(Raster(cut(*p), True), 96, 96))
    return tuple(resize(cut(x, y), 320, 320).astype(np.uint8) for x, y in (((r.width - side) // 2, (r.height - side) // 2), sharpest))
