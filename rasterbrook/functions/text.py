"""Text, JSON and packet functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults and allowed ranges of the processing parameters.
PARAMS = {
    "wb_clip_percent": (0.5, 0.2, 1.5), "black_point": (0.8, 0.5, 2.0), "white_point": (99.2, 97.0, 99.5), "clahe_clip": (1.4, 0.5, 4.0),
    "unsharp_amount": (0.35, 0.0, 1.0), "unsharp_sigma": (1.2, 0.5, 3.0), "desat_strength": (0.2, 0.0, 0.6), "desat_sigma": (7.0, 2.0, 20.0),
    "shadow_lift": (0.0, 0.0, 40.0), "gamma": (1.0, 0.4, 2.2), "lab_strength": (0.85, 0.0, 1.5), "highlight_compression": (0.0, 0.0, 0.5),
    "vibrance": (0.0, -0.3, 0.6), "clahe_grid": (8.0, 4.0, 16.0),
}
#: Parameters that take the nearest of a few values.
CHOICES = {"clahe_grid": (4.0, 8.0, 16.0)}
#: Image types by file suffix.
MIME = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp"}


def json_in_text(text: Column) -> Column:
    """From the first { to the last }, null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def params(json: Column, names=tuple(PARAMS)) -> dict[str, Column]:
    """Each parameter as a number in its range; missing or not a number: its default."""
    got = F.from_json(json, ", ".join(f"{n} string" for n in names))
    out = {}
    for n in names:
        default, lo, hi = PARAMS[n]
        value = got[n].try_cast("double")
        value = F.least(F.greatest(F.coalesce(value, F.lit(float(default))), F.lit(float(lo))), F.lit(float(hi)))
        if n in CHOICES:
            value = F.array_min(F.array(*[F.struct(F.abs(value - c).alias("d"), F.lit(c).alias("c")) for c in CHOICES[n]]))["c"]
        out[n] = value
    return out


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^a-zA-Z0-9_]+", "_"))


def strength_token(value: Column) -> Column:
    return F.translate(F.format_string("%.3f", value), ".", "p")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def mime(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("image/jpeg"))


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime(path), F.lit(";base64,"), F.base64(content))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss_SSSSSS")


def checksum(command: Column, data: Column) -> Column:
    """(command + sum of the bytes) modulo 256."""
    return (command + F.aggregate(data, F.lit(0).cast("long"), lambda a, x: a + x)) % 256


def rationals(flat: Column) -> Column:
    """[n0, d0, n1, d1, ..] to [n0 / d0, ..], pairs over zero left out."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(flat) - 1, F.lit(1)), F.lit(2)), lambda i: F.try_divide(F.get(flat, i - 1).cast("double"), F.get(flat, i).cast("double")))
    return F.filter(pairs, lambda x: x.isNotNull())


def sentence(parts: Column) -> Column:
    """Messages as one sentence: joined by "; ", first letter large, a full stop."""
    said = F.array_join(parts, "; ")
    return F.when(F.size(parts) == 0, F.lit("Looks balanced.")).otherwise(F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, 2, 1 << 20), F.lit(".")))
