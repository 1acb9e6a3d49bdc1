"""Image metadata from file headers: dimensions, depth, alpha, embedded blocks, EXIF text tags."""

from __future__ import annotations

import struct

# EXIF tags with text that is kept.
TEXT_TAGS = {0x010F: "camera_make", 0x0110: "camera_model", 0x0132: "capture_date", 0x013B: "creator", 0x8298: "copyright", 0x9003: "capture_date"}
SUB_IFD, ORIENTATION, ASCII_TYPE = 0x8769, 0x0112, 2


def _png(d: bytes) -> dict:
    from provena.sources.pixels import png_chunks

    kinds = {k: c for k, c in png_chunks(d)}
    w, h, depth, colour = struct.unpack(">IIBB", kinds[b"IHDR"][:10])
    xmp = b"iTXt" in kinds and kinds[b"iTXt"].startswith(b"XML:com.adobe.xmp")
    return {
        "format": "png", "width": w, "height": h, "bit_depth": depth, "channels": {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.get(colour), "has_alpha": colour in (4, 6) or b"tRNS" in kinds,
        "icc": b"iCCP" in kinds, "exif": kinds.get(b"eXIf"), "xmp": xmp, "iptc": False,
    }


def _jpeg(d: bytes) -> dict:
    out = {"format": "jpeg", "has_alpha": False, "icc": False, "exif": None, "xmp": False, "iptc": False}
    at = 2
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            break
        kind, n = d[at + 1], struct.unpack(">H", d[at + 2 : at + 4])[0]
        body = d[at + 4 : at + 2 + n]
        if kind in (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            depth, h, w, channels = struct.unpack(">BHHB", body[:6])
            out |= {"width": w, "height": h, "bit_depth": depth, "channels": channels}
        elif kind == 0xE1 and body.startswith(b"Exif\0\0"):
            out["exif"] = body[6:]
        elif kind == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/"):
            out["xmp"] = True
        elif kind == 0xE2 and body.startswith(b"ICC_PROFILE"):
            out["icc"] = True
        elif kind == 0xED:
            out["iptc"] = True
        elif kind == 0xDA:
            break
        at += 2 + n
    return out


def _gif(d: bytes) -> dict:
    w, h = struct.unpack("<HH", d[6:10])
    return {"format": "gif", "width": w, "height": h, "bit_depth": 8, "channels": 3, "has_alpha": b"\x21\xf9\x04" in d and bool(d[d.index(b"\x21\xf9\x04") + 3] & 1), "icc": False, "exif": None, "xmp": False, "iptc": False}


def _webp(d: bytes) -> dict:
    out = {"format": "webp", "bit_depth": 8, "has_alpha": False, "icc": False, "exif": None, "xmp": False, "iptc": False}
    at = 12
    while at + 8 <= len(d):
        kind, n = d[at : at + 4], struct.unpack("<I", d[at + 4 : at + 8])[0]
        body = d[at + 8 : at + 8 + n]
        if kind == b"VP8X":
            size = lambda b: int.from_bytes(b, "little") + 1
            out |= {"width": size(body[4:7]), "height": size(body[7:10]), "has_alpha": bool(body[0] & 16)}
        elif kind == b"VP8 " and "width" not in out:
            w, h = struct.unpack("<HH", body[6:10])
            out |= {"width": w & 0x3FFF, "height": h & 0x3FFF}
        elif kind == b"VP8L" and "width" not in out:
            bits = int.from_bytes(body[1:5], "little")
            out |= {"width": (bits & 0x3FFF) + 1, "height": ((bits >> 14) & 0x3FFF) + 1, "has_alpha": bool(bits >> 28 & 1)}
        elif kind == b"ICCP":
            out["icc"] = True
        elif kind == b"EXIF":
            out["exif"] = body.removeprefix(b"Exif\0\0")
        elif kind == b"XMP ":
            out["xmp"] = True
        at += 8 + n + n % 2
    out["channels"] = 4 if out["has_alpha"] else 3
    return out


def _avif(d: bytes) -> dict:
    at = d.index(b"ispe") + 8
    w, h = struct.unpack(">II", d[at : at + 8])
    alpha = b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha" in d
    return {"format": "avif", "width": w, "height": h, "bit_depth": 8, "channels": 4 if alpha else 3, "has_alpha": alpha, "icc": b"colrprof" in d or b"colrrICC" in d, "exif": None, "xmp": False, "iptc": False}


def read_header(d: bytes) -> dict:
    """Metadata of a whole file; raises ValueError where it cannot be read."""
    try:
        if d.startswith(b"\x89PNG\r\n\x1a\n"):
            out = _png(d)
        elif d.startswith(b"\xff\xd8\xff"):
            out = _jpeg(d)
        elif d[:6] in (b"GIF87a", b"GIF89a"):
            out = _gif(d)
        elif d[:4] == b"RIFF" and d[8:12] == b"WEBP":
            out = _webp(d)
        elif d[4:8] == b"ftyp" and d[8:12] in (b"avif", b"avis"):
            out = _avif(d)
        else:
            raise ValueError("unrecognised image format")
        if not out.get("width") or not out.get("height"):
            raise ValueError("no image dimensions found")
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError(f"damaged header: {e}") from e
    return out


def dimensions(d: bytes) -> tuple[int, int] | None:
    try:
        out = read_header(d)
    except ValueError:
        return None
    return out["width"], out["height"]


def parse_exif(block: bytes | None) -> dict:
    """Text tags and orientation of a TIFF block; anything malformed gives an empty dict."""
    try:
        if not block or block[:2] not in (b"II", b"MM"):
            return {}
        order = "<" if block[:2] == b"II" else ">"
        if struct.unpack(order + "H", block[2:4])[0] != 42:
            return {}
        out: dict = {}
        ifds = [struct.unpack(order + "I", block[4:8])[0]]
        for depth in range(2):  # the first directory, then the one it points to
            if depth == len(ifds):
                break
            at = ifds[depth]
            (entries,) = struct.unpack_from(order + "H", block, at)
            for i in range(entries):
                tag, kind, count, value = struct.unpack_from(order + "HHI4s", block, at + 2 + 12 * i)
                if tag == SUB_IFD and depth == 0:
                    ifds.append(struct.unpack(order + "I", value)[0])
                elif tag == ORIENTATION and depth == 0:
                    out["orientation"] = struct.unpack(order + "H", value[:2])[0]
                elif tag in TEXT_TAGS and kind == ASCII_TYPE:
                    start = struct.unpack(order + "I", value)[0]
                    raw = value[:count] if count <= 4 else block[start : start + count]
                    if len(raw) < count:
                        return {}
                    text = raw.split(b"\0")[0].decode("ascii", "replace").strip()
                    if text:
                        out[TEXT_TAGS[tag]] = text
        return out
    except (struct.error, IndexError):
        return {}
