"""Image properties and pixels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channels of the colour spaces that a raw image can have.
CHANNELS = {"/DeviceGray": 1, "/CalGray": 1, "/DeviceRGB": 3, "/CalRGB": 3, "/DeviceCMYK": 4, "/Lab": 3}
PIXEL_LIMIT = 500_000_000


def bits_per_component(bpc: Column, is_mask: Column) -> Column:
    """Missing or zero: 1 for a mask, else 8."""
    return F.when(F.coalesce(bpc, F.lit(0)) == 0, F.when(is_mask, 1).otherwise(8)).otherwise(bpc)


def profile_space(profile: Column) -> Column:
    """The colour space that an ICC profile says its data is in: GRAY, RGB, CMYK, ...; null where it is no profile."""
    said = F.decode(profile.substr(F.lit(17), F.lit(4)), "ISO-8859-1")
    return F.when((F.length(profile) >= 128) & (F.decode(profile.substr(F.lit(37), F.lit(4)), "ISO-8859-1") == "acsp"), F.rtrim(said))


def mode(colorspace: Column, bpc: Column, is_mask: Column, base: Column, components: Column | None = None, profile: Column | None = None) -> Column:
    """The pixel mode: 1, L, I;16, P, RGB, CMYK, LAB, DeviceN or Separation; null where it can't be told.

    ``base``: that of an Indexed colour space; ``components``: the number that an ICCBased one tells,
    and ``profile``: what its profile's data is (``profile_space``), which decides where there are several.
    """
    grey, none = ("/DeviceGray", "/CalGray"), F.lit(None).cast("string")
    named = lambda name: (colorspace == name) | ((colorspace == "/Indexed") & (base == name))
    by_profile = none if components is None else F.when(components == 1, "L").when((none if profile is None else profile).isin("RGB", "CMYK"), profile)
    return (
        F.when(F.coalesce(named("/DeviceN"), F.lit(False)), "DeviceN")
        .when(F.coalesce(named("/Separation"), F.lit(False)), "Separation")
        .when(is_mask | ((bpc == 1) & colorspace.isin(*grey)), "1")
        .when(colorspace == "/Indexed", "P")
        .when(colorspace.isin(*grey) & (bpc == 16), "I;16")
        .when(colorspace.isin(*grey), "L")
        .when(colorspace.isin("/DeviceRGB", "/CalRGB"), "RGB")
        .when(colorspace.isin("/DeviceCMYK", "/CalCMYK"), "CMYK")
        .when(colorspace == "/Lab", "LAB")
        .when(colorspace == "/ICCBased", by_profile)
    )


def mask_kind(smask: Column, mask: Column, bpc: Column, pixel_mode: Column) -> Column:
    """Which mask gives an image its alpha: a soft mask before a stencil before a colour key, which takes 8 bits and L, RGB or CMYK; null if none.

    ``smask``, ``mask``: tags of the two entries (``stream``, ``array`` or null).
    """
    return F.when(smask == "stream", "soft").when(mask == "stream", "stencil").when((mask == "array") & (bpc == 8) & pixel_mode.isin("L", "RGB", "CMYK"), "colorkey")


def default_decode(colorspace: Column, bpc: Column) -> Column:
    """The /Decode array that is meant where there is none."""
    ends = lambda n: F.array(*[F.lit(x) for _ in range(n) for x in (0.0, 1.0)])
    lab = F.array(*map(F.lit, (0.0, 100.0, -100.0, 100.0, -100.0, 100.0)))
    return F.when(colorspace == "/Indexed", F.array(F.lit(0.0), F.pow(F.lit(2.0), bpc) - 1)).when(colorspace.isin("/DeviceGray", "/CalGray"), ends(1)).when(colorspace.isin("/DeviceRGB", "/CalRGB"), ends(3)).when(colorspace == "/DeviceCMYK", ends(4)).when(colorspace == "/Lab", lab)


def apply_decode(sample: Column, low: Column, high: Column) -> Column:
    """A sample of 0 to 255 through a /Decode pair with ends within 0 and 1; rounds half to even."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    lo, hi = clamp(low), clamp(high)
    return F.bround(255 * lo + sample * (hi - lo), 0).cast("int")


def bomb_check(width: Column, height: Column, limit: int | None = PIXEL_LIMIT) -> Column:
    """``ok``, ``warn`` over the limit, ``error`` over twice the limit; no limit: always ``ok``."""
    pixels = width.cast("long") * height.cast("long")
    return F.lit("ok") if limit is None else F.when(pixels > 2 * limit, "error").when(pixels > limit, "warn").otherwise("ok")


def unpack_samples(byte: Column, bits: int) -> Column:
    """The samples in one byte, most significant first, scaled to 0 to 255."""
    if bits not in (1, 2, 4, 8):
        raise ValueError("1, 2, 4 or 8 bits")
    most = (1 << bits) - 1
    return F.array(*((F.shiftright(byte.cast("int"), s).bitwiseAND(most) * (255 // most)) for s in range(8 - bits, -1, -bits)))


def row_bytes(width: Column, channels: Column, bpc: Column) -> Column:
    """Bytes of a row of pixels, padded to a whole one."""
    return F.floor((width * channels * bpc + 7) / 8)


def colorkey_alpha(bands: Column, ranges: list[tuple[float, float]]) -> Column:
    """0 where each band is within its range, else 255."""
    inside = F.lit(True)
    for i, (lo, hi) in enumerate(ranges):
        inside &= F.get(bands, i).between(lo, hi)
    return F.when(inside, 0).otherwise(255)


def simple_filters(filters: Column) -> Column:
    """The filters left after the lossless ones that stand first are undone."""
    return F.filter(filters, lambda f: ~f.isin("/FlateDecode", "/LZWDecode", "/ASCII85Decode", "/ASCIIHexDecode", "/RunLengthDecode"))


def extract_kind(filters: Column, has_mask: Column, pixel_mode: Column) -> Column:
    """How an image is written out: its coded bytes as they are, or pixels anew."""
    last = F.get(simple_filters(filters), F.size(simple_filters(filters)) - 1)
    direct = F.when(last == "/CCITTFaxDecode", ".tif").when(last == "/DCTDecode", ".jpg").when(last == "/JPXDecode", ".jp2")
    return F.coalesce(F.when(~has_mask, direct), F.when(pixel_mode.isin("CMYK", "LAB"), ".tiff").otherwise(".png"))
