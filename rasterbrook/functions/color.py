"""Colour functions on columns. Channels are doubles; linear RGB lies in 0..1, 8-bit values in 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights of 8-bit grey and of linear Rec. 709 RGB.
GRAY = (0.299, 0.587, 0.114)
REC709 = (0.2126, 0.7152, 0.0722)
#: Linear Rec. 709 RGB to XYZ under D65, the way back, and the white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)

RGB = ("r", "g", "b")


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def smoothstep(lo: float, hi: float, c: Column) -> Column:
    t = clamp((c - lo) / max(hi - lo, 1e-12))
    return t * t * (3.0 - 2.0 * t)


def dot(weights, cols) -> Column:
    a, b, c = (float(w) * x for w, x in zip(weights, cols, strict=True))
    return a + b + c


def gray(r: Column, g: Column, b: Column) -> Column:
    return dot(GRAY, (r, g, b))


def luma(r: Column, g: Column, b: Column) -> Column:
    return dot(REC709, (r, g, b))


def chroma_spread(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def srgb_encode(c: Column) -> Column:
    c = clamp(c)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def srgb_decode(c: Column) -> Column:
    c = clamp(c)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Linear RGB to L (0..1), a and b (L* a* b* over 100)."""
    d = 6 / 29

    def f(t: Column) -> Column:
        return F.when(t > d**3, F.cbrt(t)).otherwise(t / (3 * d * d) + 4 / 29)

    x, y, z = (f(dot(row, (r, g, b)) / w) for row, w in zip(TO_XYZ, WHITE, strict=True))
    return 1.16 * y - 0.16, 5.0 * (x - y), 2.0 * (y - z)


def from_lab(lightness: Column, a: Column, b: Column) -> tuple[Column, ...]:
    """L, a and b as lab() gives them to linear RGB, not clipped."""
    d = 6 / 29

    def inv(t: Column) -> Column:
        return F.when(t > d, t * t * t).otherwise(3 * d * d * (t - 4 / 29))

    fy = (lightness + 0.16) / 1.16
    xyz = [inv(t) * w for t, w in zip((fy + a / 5.0, fy, fy - b / 2.0), WHITE, strict=True)]
    return tuple(dot(row, xyz) for row in FROM_XYZ)


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation, 0..1."""
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / top).otherwise(0.0)


def with_saturation(r: Column, g: Column, b: Column, new: Column) -> tuple[Column, ...]:
    """The same value and hue with another HSV saturation; grey stays grey."""
    top, old = F.greatest(r, g, b), saturation(r, g, b)
    return tuple(F.when(old > 0, top - (top - c) * new / old).otherwise(c) for c in (r, g, b))
