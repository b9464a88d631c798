"""Joins on boxes: what covers, backs or holds what. Always with the page as an equi key, so partitions stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(outer: str, inner: str, tolerance: float = 0.0) -> Column:
    """Whether box `outer` (x0, y0, x1, y1) holds `inner`, edges included."""
    o, i = (lambda c: F.col(f"{outer}.{c}")), (lambda c: F.col(f"{inner}.{c}"))
    return (o("x0") <= i("x0") + tolerance) & (o("y0") <= i("y0") + tolerance) & (o("x1") >= i("x1") - tolerance) & (o("y1") >= i("y1") - tolerance)


def covered(shapes: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, z, cover_z, cover): each shape that a later opaque one covers whole, with the first that does.

    shapes: keys, z, name, x0, y0, x1, y1, opaque.
    """
    a, b = shapes.alias("a"), shapes.where("opaque").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    pairs = a.join(b, [*on, F.col("b.z") > F.col("a.z"), contains("b", "a", tolerance)])
    return pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.z").alias("z")).agg(F.min("b.z").alias("cover_z"), F.min_by("b.name", "b.z").alias("cover"))


def background(texts: DataFrame, fills: DataFrame, keys: list[str], tolerance: float = 2.0, least_opacity: float = 0.9) -> DataFrame:
    """texts with `back`: the fill last listed among those painted before the text that hold it; null if none.

    texts: keys, seqno, box; fills: keys, fill_ord, seqno, box, rgb, opacity. An as-of join by listing, not by seqno.
    """
    t, f = texts.alias("t"), fills.where(F.col("opacity") >= least_opacity).alias("f")
    on = [F.col(f"t.{k}") == F.col(f"f.{k}") for k in keys]
    pairs = t.join(f, [*on, F.col("f.seqno") < F.col("t.seqno"), contains("f", "t", tolerance)], "left")
    own = [F.col(f"t.{c}").alias(c) for c in texts.columns]
    return pairs.groupBy(*own).agg(F.max_by("f.rgb", "f.fill_ord").alias("back"))


def held(texts: DataFrame, boxes: DataFrame, keys: list[str], tolerance: float = 2.0, later: bool = False) -> DataFrame:
    """texts that lie in one of the boxes (painted after them, if `later`): a semi-join."""
    t, b = texts.alias("t"), boxes.alias("b")
    on = [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys] + [contains("b", "t", tolerance)]
    return t.join(b, [*on, F.col("b.seqno") > F.col("t.seqno")] if later else on, "left_semi")


def in_ranges(cells: DataFrame, ranges: DataFrame, keys: list[str], at: str = "col", low: str = "lo", high: str = "hi") -> DataFrame:
    """cells whose number lies in a range of the same keys: ranges are few per key, so a residual on the equi join."""
    c, r = cells.alias("c"), ranges.alias("r")
    on = [F.col(f"c.{k}") == F.col(f"r.{k}") for k in keys]
    return c.join(r, [*on, F.col(f"c.{at}").between(F.col(f"r.{low}"), F.col(f"r.{high}"))], "left_semi")
