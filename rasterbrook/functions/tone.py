"""Tone and density functions on columns: row-local, so they fuse into one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import clamp, luma, saturation, smoothstep, with_saturation


def u8(c: Column) -> Column:
    """8-bit steps cut off, they don't round."""
    return F.floor(clamp(c, 0, 255)).cast("double")


def invert(c: Column) -> Column:
    return 255.0 - c


def stretch(c: Column, lo: Column, hi: Column) -> Column:
    """lo..hi to 0..255; a channel without spread keeps its values."""
    return u8(F.when(hi - lo < 1, c).otherwise((c - lo) * 255.0 / F.greatest(hi - lo, F.lit(1.0))))


def gamma_u8(c: Column, gamma: float) -> Column:
    return c if abs(gamma - 1) < 0.01 else u8(F.pow(c / 255.0, F.lit(float(gamma))) * 255.0)


def compress_highlights(c: Column, amount: float) -> Column:
    s = c / 255.0
    return c if amount <= 0.001 else u8(s * (1.0 - amount * s) * 255.0)


def lift_shadows(c: Column, lift: float) -> Column:
    return c if lift == 0 else u8(c + float(lift))


def vibrance(r: Column, g: Column, b: Column, amount: float) -> tuple[Column, ...]:
    if abs(amount) < 0.01:
        return r, g, b
    s = saturation(r, g, b)
    return with_saturation(r, g, b, clamp(s + amount * (1.0 - s)))


def desaturate(r: Column, g: Column, b: Column, mask: Column, strength: float) -> tuple[Column, ...]:
    return with_saturation(r, g, b, saturation(r, g, b) * (1.0 - clamp(mask * float(strength))))


def transmission(c: Column, base: Column) -> Column:
    return clamp(c / F.greatest(base, F.lit(1e-6)), 1e-6, 1.0)


def density(t: Column) -> Column:
    return -F.ln(t)


def normalise_density(d: Column, lo: Column, hi: Column) -> Column:
    return clamp((d - lo) / F.greatest(hi - lo, F.lit(1e-4)))


def to_positive(d: Column, upper: Column, compat: bool = False) -> Column:
    """Dense parts of a negative are bright in the positive; compat gives the opposite polarity."""
    p = clamp(d / F.greatest(upper, F.lit(1e-4)))
    return 1.0 - p if compat else p


def expm1_positive(d: Column, gain: float) -> Column:
    return F.expm1(clamp(d * float(gain), 0, 8))


def matrix_blend(cols, matrix, strength: float) -> list[Column]:
    """x + s (M x - x)."""
    out = []
    for c, row in zip(cols, matrix, strict=True):
        m = sum((float(w) * x for w, x in zip(row[1:], cols[1:], strict=True)), float(row[0]) * cols[0])
        out.append(c + strength * (m - c))
    return out


def black_level(c: Column, black: Column, white: Column) -> Column:
    return F.when(black.isNull(), clamp(c)).otherwise(clamp((c - black / white) / (1.0 - black / white)))


def tone_curve(c: Column, gamma: float, contrast: float, lift: float) -> Column:
    v = 0.5 + (F.pow(clamp(c), F.lit(float(gamma))) - 0.5) * (1.0 + contrast)
    return clamp(v + float(lift) if lift > 0 else v)


def neutral_damp(r: Column, g: Column, b: Column, strength: float, sigma: float) -> list[Column]:
    c = F.greatest(r, g, b) - F.least(r, g, b)
    w = strength * F.exp(-c * c / (2 * sigma * sigma))
    mean = (r + g + b) / 3.0
    return [x + w * (mean - x) for x in (r, g, b)]


def red_guard(r: Column, g: Column, b: Column, threshold: float, strength: float) -> Column:
    return r - strength * F.greatest(r - 0.5 * (g + b) - threshold, F.lit(0.0))


def zoned_tone(v: Column, shadow: float, highlight: float, shadow_gamma: float, k: float, pivot: float, rolloff: float) -> Column:
    """Power law in the shadows, logistic in the middle, roll-off in the highlights; smooth weights."""
    low = F.pow(clamp(v), F.lit(float(shadow_gamma)))
    mid = 1.0 / (1.0 + F.exp(-k * (v - pivot)))
    high = v / (1.0 + rolloff * F.greatest(v - highlight, F.lit(0.0)))
    w_low, w_high = 1.0 - smoothstep(shadow - 0.1, shadow + 0.1, v), smoothstep(highlight - 0.1, highlight + 0.1, v)
    w_mid = F.greatest(1.0 - w_low - w_high, F.lit(0.0))
    return (w_low * low + w_mid * mid + w_high * high) / (w_low + w_mid + w_high)


def rolloff(v: Column, alpha: float, power: float) -> Column:
    return v / (1.0 + alpha * F.pow(F.greatest(v, F.lit(0.0)), F.lit(float(power))))


def chroma_scale(v: Column, base: float, gain: float, centre: float, sigma: float, decay: float, lo: float, hi: float) -> Column:
    return clamp(base + gain * F.exp(-(v - centre) * (v - centre) / (2 * sigma * sigma)) - decay * v, lo, hi)


def hue_adjust(a: Column, b: Column, red: float, green: float, blue: float) -> tuple[Column, Column]:
    """Scales chroma by hue range; ranges are tested on the hue as it comes."""
    hue = F.atan2(b, a)
    s = (
        F.when((hue >= -0.45) & (hue <= 0.55), float(red)).otherwise(1.0)
        * F.when((hue >= 0.9) & (hue <= 1.8), float(green)).otherwise(1.0)
        * F.when(F.abs(hue) > 2.1, float(blue)).otherwise(1.0)
    )
    return a * s, b * s


def protect_neutral(a: Column, b: Column, limit: Column, shrink: float = 0.45) -> tuple[Column, Column]:
    s = F.when(F.sqrt(a * a + b * b) < limit, float(shrink)).otherwise(1.0)
    return a * s, b * s


def trim(cols, ev: float, black: float, white: float, contrast: float, temperature: float, tint: float) -> list[Column]:
    gains = (1 + temperature, 1 + tint, 1 - temperature)
    return [clamp((0.5 + ((c * 2.0**ev - black) / (white - black) - 0.5) * (1 + contrast)) * k) for c, k in zip(cols, gains, strict=True)]


def weight_by_lightness(v: Column, threshold: float, strength: float, bright: bool) -> Column:
    """Factor for a and b: fades the colour of highlights (bright) or of shadows."""
    w = smoothstep(threshold - 0.05, threshold + 0.05, v)
    return 1.0 - strength * (w if bright else 1.0 - w)


def filmic(r: Column, g: Column, b: Column, gain: Column, compression: float = 0.5, contrast: float = 6.0, pivot: float = 0.5) -> list[Column]:
    """Middle-grey gain, luminance compression, then a normalised logistic."""
    y = F.greatest(luma(r, g, b) * gain, F.lit(1e-6))
    k = (y / (1.0 + compression * y)) / y
    lo, hi = F.lit(1.0) / (1.0 + F.exp(F.lit(contrast * pivot))), F.lit(1.0) / (1.0 + F.exp(F.lit(-contrast * (1 - pivot))))
    return [clamp((1.0 / (1.0 + F.exp(-contrast * (c * gain * k - pivot))) - lo) / (hi - lo)) for c in (r, g, b)]


def grain(c: Column, y: Column, x: Column, brightness: Column, strength: float, seed: int = 445) -> Column:
    """Noise from a hash of the place, so that every executor and every retry sees the same grain."""
    u = (F.pmod(F.xxhash64(F.lit(seed), y, x), F.lit(1 << 40)) + 1.0) / float((1 << 40) + 1)
    v = F.pmod(F.xxhash64(F.lit(seed + 1), y, x), F.lit(1 << 40)) / float(1 << 40)
    normal = F.sqrt(-2.0 * F.ln(u)) * F.cos(v * 6.283185307179586)
    return clamp(c + strength * (0.35 + 0.65 * (1.0 - brightness)) * normal)


def feather(i: Column, n: int, overlap: int, start_edge: bool, end_edge: bool) -> Column:
    """Weight along one axis of a tile: ramps of 1e-3..1 over the overlap at inner edges."""

    def ramp(k: Column) -> Column:
        return F.lit(1e-3) if overlap == 1 else 1e-3 + (1 - 1e-3) * k / float(overlap - 1)

    w = F.lit(1.0)
    if overlap > 0 and not start_edge:
        w = w * F.when(i < overlap, ramp(i)).otherwise(1.0)
    if overlap > 0 and not end_edge:
        w = w * F.when(i >= n - overlap, ramp(n - 1 - i)).otherwise(1.0)
    return w
