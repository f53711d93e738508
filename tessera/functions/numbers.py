"""Numeric Catalyst expressions: ratios, distances, boxes, correlations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0: unavailable is never 0 (A1)."""
    return numerator / F.nullif(denominator, F.lit(0))


def ratio_status(denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit("unavailable")).otherwise(F.lit("available"))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit integers."""
    return F.bit_count(a.bitwiseXOR(b))


def from_hex64(text: Column) -> Column:
    """A 16-digit hex string as a signed 64-bit integer."""
    return F.conv(text, 16, -10).cast("long")


def half_even(x: Column) -> Column:
    """Rounding to integers, ties to even."""
    return F.rint(x).cast("int")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive integers, as a fold of Euclid's steps.

    47 steps are enough for any 32-bit pair.
    """
    start = F.struct(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0).cast("long"))).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(47)), start, step, lambda s: s["x"])


def aspect(width: Column, height: Column) -> Column:
    """``w:h`` reduced by the greatest common divisor."""
    g = gcd(width, height)
    return F.concat((width / g).cast("long").cast("string"), F.lit(":"), (height / g).cast("long").cast("string"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def standardized(a: Column) -> Column:
    """Centred and scaled to unit norm; zeros if flat."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)
    centred = F.transform(a, lambda x: x.cast("double") - mean)
    norm = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(centred, lambda x: F.when(norm > 1e-9, x / norm).otherwise(F.lit(0.0)))


def mapped_correlation(a: Column, b: Column) -> Column:
    """Pearson's r as (r + 1) / 2 within 0..1; 0 where either side is flat."""
    n = F.size(a)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    ma, mb = total(a) / n, total(b) / n
    da, db = F.transform(a, lambda x: x.cast("double") - ma), F.transform(b, lambda x: x.cast("double") - mb)
    bottom = F.sqrt(dot(da, da) * dot(db, db))
    return F.when(bottom <= 1e-9, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dot(da, db) / bottom + 1) / 2)))


def map_box(box: Column, scale: Column, dx: Column, dy: Column) -> Column:
    """A box under scale and offset, rounded half to even, corners in order."""
    xs = [half_even(box[c] * scale + dx) for c in ("x1", "x2")]
    ys = [half_even(box[c] * scale + dy) for c in ("y1", "y2")]
    return F.struct(F.least(*xs).alias("x1"), F.least(*ys).alias("y1"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2"))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """The box within the image; null if nothing is left; ``changed`` says whether it moved."""
    x1, x2 = F.greatest(F.lit(0), F.least(box["x1"], width)), F.greatest(F.lit(0), F.least(box["x2"], width))
    y1, y2 = F.greatest(F.lit(0), F.least(box["y1"], height)), F.greatest(F.lit(0), F.least(box["y2"], height))
    changed = (x1 != box["x1"]) | (x2 != box["x2"]) | (y1 != box["y1"]) | (y2 != box["y2"])
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), changed.alias("changed")))
