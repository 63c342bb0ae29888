"""Matrices (a b c d e f, acting on row vectors) and rectangles as structs of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES, SIDES = "abcdef", ("llx", "lly", "urx", "ury")


def matrix(*six: Column | float) -> Column:
    return F.struct(*((x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for x, n in zip(six, AXES, strict=True)))


IDENTITY = (1, 0, 0, 1, 0, 0)


def product(m: Column, n: Column) -> Column:
    """First ``m``, then ``n``."""
    return matrix(
        m.a * n.a + m.b * n.c, m.a * n.b + m.b * n.d,
        m.c * n.a + m.d * n.c, m.c * n.b + m.d * n.d,
        m.e * n.a + m.f * n.c + n.e, m.e * n.b + m.f * n.d + n.f,
    )


def translated(m: Column, x: Column, y: Column) -> Column:
    """A translation before ``m``."""
    return product(matrix(1, 0, 0, 1, x, y), m)


def scaled(m: Column, x: Column, y: Column) -> Column:
    """A scaling before ``m``."""
    return product(matrix(x, 0, 0, y, 0, 0), m)


def rotated(m: Column, degrees: Column) -> Column:
    """A counterclockwise rotation before ``m``."""
    angle = F.radians(degrees)
    return product(matrix(F.cos(angle), F.sin(angle), -F.sin(angle), F.cos(angle), 0, 0), m)


def inverse(m: Column) -> Column:
    """The true inverse, translation included; null if the determinant is zero."""
    det = m.a * m.d - m.b * m.c
    safe = F.when(det != 0, det)
    made = matrix(m.d / safe, -m.b / safe, -m.c / safe, m.a / safe, (m.c * m.f - m.d * m.e) / safe, (m.b * m.e - m.a * m.f) / safe)
    return F.when(det != 0, made)


def transform_point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m.a * x + m.c * y + m.e).alias("x"), (m.b * x + m.d * y + m.f).alias("y"))


def rectangle(llx: Column, lly: Column, urx: Column, ury: Column) -> Column:
    return F.struct(*(x.cast("double").alias(n) for x, n in zip((llx, lly, urx, ury), SIDES, strict=True)))


def normalized(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A rectangle from two opposite corners in any order."""
    return rectangle(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def transform_rectangle(m: Column, r: Column) -> Column:
    """The box around the four transformed corners."""
    xs = [m.a * x + m.c * y + m.e for x in (r.llx, r.urx) for y in (r.lly, r.ury)]
    ys = [m.b * x + m.d * y + m.f for x in (r.llx, r.urx) for y in (r.lly, r.ury)]
    return rectangle(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def intersection(r: Column, s: Column) -> Column:
    """Greatest lower and least upper sides; inverted where the two don't meet."""
    return rectangle(F.greatest(r.llx, s.llx), F.greatest(r.lly, s.lly), F.least(r.urx, s.urx), F.least(r.ury, s.ury))


def inside(r: Column, s: Column) -> Column:
    """Whether ``r`` lies within ``s``, sides included."""
    return (r.llx >= s.llx) & (r.lly >= s.lly) & (r.urx <= s.urx) & (r.ury <= s.ury)


def width(r: Column) -> Column:
    return r.urx - r.llx


def height(r: Column) -> Column:
    return r.ury - r.lly


def bbox(r: Column) -> Column:
    """The rectangle moved to the origin."""
    return rectangle(F.lit(0.0), F.lit(0.0), width(r), height(r))


def page_boxes(media: Column, crop: Column, bleed: Column, trim: Column, art: Column) -> Column:
    """The five boxes with their defaults: crop falls back to media, the others to crop."""
    c = F.coalesce(crop, media)
    return F.struct(media.alias("media"), c.alias("crop"), F.coalesce(bleed, c).alias("bleed"), F.coalesce(trim, c).alias("trim"), F.coalesce(art, c).alias("art"))


def effective_rotation(rotate: Column) -> Column:
    """In [0, 360); a missing one is 0."""
    return F.pmod(F.coalesce(rotate, F.lit(0)), F.lit(360))


def rotate(rotation: Column, angle: int, relative: bool = True) -> Column:
    if angle % 90:
        raise ValueError("a rotation is a multiple of 90 degrees")
    return F.pmod((effective_rotation(rotation) if relative else F.lit(0)) + angle, F.lit(360))


def placement(source: Column, target: Column) -> Column:
    """The matrix that scales ``source`` evenly into ``target`` and centres it."""
    scale = F.least(width(target) / width(source), height(target) / height(source))
    return matrix(scale, 0, 0, scale, target.llx + (width(target) - width(source) * scale) / 2 - source.llx * scale, target.lly + (height(target) - height(source) * scale) / 2 - source.lly * scale)


def shorthand(m: Column) -> Column:
    """The six numbers."""
    return F.array(*(m[x] for x in AXES))


def encode(m: Column, digits: int = 5) -> Column:
    """The six numbers as a content stream writes them, without needless zeros."""
    short = lambda x: F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), "[.]?0+$", ""), "^-0$", "0")
    return F.concat_ws(" ", *(short(m[x]) for x in AXES))


def corners(r: Column) -> Column:
    """Lower left, lower right, upper right and upper left."""
    return F.array(*(F.struct(r[x].alias("x"), r[y].alias("y")) for x, y in (("llx", "lly"), ("urx", "lly"), ("urx", "ury"), ("llx", "ury"))))
