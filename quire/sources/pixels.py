"""Image files from image streams: coded bytes as they are, raw samples as PNG, CCITT within TIFF."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from quire.sources.values import Malformed

CHANNELS = {"/DeviceGray": 1, "/CalGray": 1, "/DeviceRGB": 3, "/CalRGB": 3, "/DeviceCMYK": 4, "/CalCMYK": 4, "/Indexed": 1}


def samples(raw: bytes, width: int, height: int, channels: int, bits: int) -> np.ndarray:
    """``height x width x channels`` samples of 0 to 2^bits - 1 (of 16 bits the high byte); rows are padded to bytes."""
    if bits not in (1, 2, 4, 8, 16) or min(width, height, channels) < 1:
        raise Malformed("an image of such a size or depth")
    row = (width * channels * bits + 7) // 8
    if len(raw) < row * height:
        raise Malformed("too few bytes of samples")
    data = np.frombuffer(raw, np.uint8, row * height).reshape(height, row)
    if bits == 16:
        data = data[:, ::2]
    elif bits < 8:
        shifts = np.arange(8 - bits, -1, -bits)
        data = ((data[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(height, -1).astype(np.uint8)
    return data[:, : width * channels].reshape(height, width, channels)


def scaled(values: np.ndarray, bits: int) -> np.ndarray:
    """Samples of fewer than 8 bits as 0 to 255."""
    return values * (255 // ((1 << bits) - 1)) if bits < 8 else values


def decoded(values: np.ndarray, decode: list[float]) -> np.ndarray:
    """0 to 255 through a /Decode array; rounds half to even."""
    lo, hi = (np.clip(np.array(decode[i::2], float), 0, 1) for i in (0, 1))
    return np.rint(255 * lo + values * (hi - lo)).astype(np.uint8)


def rgb_of_cmyk(values: np.ndarray) -> np.ndarray:
    c = values.astype(np.uint16)
    return ((255 - c[..., :3]) * (255 - c[..., 3:]) // 255).astype(np.uint8)


def through_palette(values: np.ndarray, lookup: bytes, base: str) -> np.ndarray:
    """Indexes as the colours of an Indexed space."""
    n = CHANNELS.get(base, 3)
    table = np.frombuffer(lookup[: len(lookup) // n * n], np.uint8).reshape(-1, n)
    if not len(table):
        raise Malformed("an empty palette")
    return table[np.minimum(values[..., 0], len(table) - 1)]


def colorkey(values: np.ndarray, ranges: list[int]) -> np.ndarray:
    """0 where every channel lies in its range, else 255."""
    lo, hi = np.array(ranges[::2]), np.array(ranges[1::2])
    return np.where(((values >= lo) & (values <= hi)).all(axis=-1), 0, 255).astype(np.uint8)


def fitted(alpha: np.ndarray, height: int, width: int) -> np.ndarray:
    """A mask in the size of its image, each sample the nearest."""
    rows, columns = (np.minimum((np.arange(new) + 0.5) * old / new, old - 1).astype(int) for new, old in ((height, alpha.shape[0]), (width, alpha.shape[1])))
    return alpha[rows][:, columns]


def with_alpha(values: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Pixels with a mask, which is brought to their size."""
    return np.dstack([values, fitted(alpha, *values.shape[:2])])


def png16(raw: bytes, width: int, height: int) -> bytes:
    """Grey of 16 bits as it is."""
    if len(raw) < 2 * width * height:
        raise Malformed("too few bytes of samples")
    rows = b"".join(b"\0" + raw[2 * width * y : 2 * width * (y + 1)] for y in range(height))
    return _png(width, height, 16, 0, rows)


def _png(width: int, height: int, bits: int, kind: int, rows: bytes) -> bytes:
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def png(values: np.ndarray) -> bytes:
    """Grey, grey and alpha, RGB or RGB and alpha, 8 bits."""
    height, width, n = values.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    rows = np.hstack([np.zeros((height, 1), np.uint8), values.reshape(height, -1)]).tobytes()
    return _png(width, height, 8, kind, rows)


def ccitt_tiff(raw: bytes, width: int, height: int, parms: dict) -> bytes:
    """A one-page TIFF around CCITT data."""
    k = parms.get("/K", 0)
    black = 1 if parms.get("/BlackIs1", False) is True else 0
    entries = [(256, 4, width), (257, 4, height), (258, 3, 1), (259, 3, 4 if k < 0 else 3), (262, 3, black), (273, 4, 0), (277, 3, 1), (278, 4, height), (279, 4, len(raw))]
    if k >= 0:
        entries.append((292, 4, 1 if k > 0 else 0))
    at = 8 + 2 + 12 * len(entries) + 4
    body = b"".join(struct.pack("<HHI", t, kind, 1) + (struct.pack("<HH", v, 0) if kind == 3 else struct.pack("<I", at if t == 273 else v)) for t, kind, v in entries)
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + body + struct.pack("<I", 0) + raw


def extract(raw: bytes, width: int, height: int, bits: int, colorspace: str, left: list[str], parms: dict | None = None, lookup: bytes = b"", base: str = "/DeviceRGB", decode: list[float] | None = None, alpha: np.ndarray | None = None, keys: list[int] | None = None) -> tuple[str, bytes]:
    """Suffix and bytes of an image file; ``raw`` is decoded but for the filters ``left``.

    ``alpha``: a soft mask's or stencil's samples, 0 to 255; ``keys``: the ranges of a colour key.
    """
    if left:
        kind = {"/DCTDecode": ".jpg", "/JPXDecode": ".jp2"}.get(left[0])
        if kind and len(left) == 1:
            return kind, raw
        if left == ["/CCITTFaxDecode"]:
            return ".tif", ccitt_tiff(raw, width, height, parms or {})
        raise Malformed(f"no decoder for {' '.join(left)}")
    if colorspace not in CHANNELS:
        raise Malformed(f"no pixels for {colorspace}")
    values = samples(raw, width, height, CHANNELS[colorspace], bits)
    if colorspace == "/Indexed":
        values = through_palette(values, lookup, base)
        values = rgb_of_cmyk(values) if base == "/DeviceCMYK" else values
        if alpha is not None and values.shape[-1] == 1:
            values = np.repeat(values, 3, axis=-1)  # a palette with a mask becomes RGB
        return ".png", png(values if alpha is None else with_alpha(values, alpha))
    if bits == 16 and colorspace in ("/DeviceGray", "/CalGray") and not decode and alpha is None:
        return ".png", png16(raw, width, height)
    values = scaled(values, bits)
    if keys and alpha is None and bits == 8 and len(keys) == 2 * values.shape[-1]:
        alpha = colorkey(values, keys)
    if decode and len(decode) == 2 * values.shape[-1]:
        values = decoded(values, decode)
    values = rgb_of_cmyk(values) if colorspace in ("/DeviceCMYK", "/CalCMYK") else values
    if alpha is not None and bits == 16 and values.shape[-1] == 1:
        values = np.repeat(values, 3, axis=-1)  # as its mode holds no alpha
    return ".png", png(values if alpha is None else with_alpha(values, alpha))
