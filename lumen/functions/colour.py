"""Column functions on colours: structs (r, g, b) of ints, null if unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def parse_hex(text: Column) -> Column:
    """#RGB, RRGGBB and AARRGGBB, with or without #; null for anything else."""
    s = F.regexp_replace(F.trim(text), "^#+", "")
    s = F.when(F.length(s) == 8, F.substring(s, 3, 6)).when(F.length(s) == 3, F.regexp_replace(s, "(.)", "$1$1")).otherwise(s)
    part = lambda k: F.conv(F.substring(s, k, 2), 16, 10)
    return F.when(s.rlike("^[0-9a-fA-F]{6}$"), rgb(part(1), part(3), part(5)))


def luminance(c: Column) -> Column:
    """Relative luminance as the web accessibility guidelines define it."""
    lin = lambda v: F.when(v / 255 <= 0.03928, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * lin(c["r"]) + 0.7152 * lin(c["g"]) + 0.0722 * lin(c["b"])


def contrast(a: Column, b: Column) -> Column:
    """1 to 21; null if either is unknown."""
    x, y = luminance(a), luminance(b)
    return F.when(a.isNotNull() & b.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def tint(c: Column, by: Column) -> Column:
    """Towards white by a positive share, towards black by a negative one; fractions are cut off."""
    move = lambda v: F.when(by > 0, v + (255 - v) * by).otherwise(v * (1 + by)).cast("int")
    return F.when(F.coalesce(by, F.lit(0.0)) == 0, c).otherwise(rgb(move(c["r"]), move(c["g"]), move(c["b"])))


def hexs(c: Column) -> Column:
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    return F.when(c.isNull(), "?").otherwise(F.concat(F.lit("#"), two(c["r"]), two(c["g"]), two(c["b"])))


def from_components(parts: Column) -> Column:
    """PDF colour components in [0, 1]: one grey, three RGB, four CMYK; null for other counts."""
    at = lambda k: F.get(parts, F.lit(k))
    byte = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255)
    cmyk = [byte((1 - at(k)) * (1 - at(3))) for k in range(3)]
    return F.when(F.size(parts) == 1, rgb(byte(at(0)), byte(at(0)), byte(at(0)))).when(F.size(parts) == 3, rgb(byte(at(0)), byte(at(1)), byte(at(2)))).when(F.size(parts) == 4, rgb(*cmyk))
