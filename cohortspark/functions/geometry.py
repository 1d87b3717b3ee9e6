"""Geometry of axis-aligned boxes as Column expressions.

A box is six DOUBLE columns ``x0 y0 z0 x1 y1 z1``, a point three, ``cx cy cz``,
behind a prefix such as ``a_``. Nothing here but ``segment_box_distance`` leaves whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

AXES = ("x", "y", "z")


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def norm(parts: list[Column]) -> Column:
    return F.sqrt(_sum([p * p for p in parts]))


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two centroids."""
    return norm([F.col(f"{a}c{x}") - F.col(f"{b}c{x}") for x in AXES])


def axis_gap(a: str, b: str, x: str) -> Column:
    return F.greatest(F.col(f"{a}{x}0") - F.col(f"{b}{x}1"), F.col(f"{b}{x}0") - F.col(f"{a}{x}1"), F.lit(0.0))


def box_distance(a: str, b: str) -> Column:
    """Gap between two boxes; 0 if they touch or overlap."""
    return norm([axis_gap(a, b, x) for x in AXES])


def minimum_surface_distance(a: str, b: str) -> tuple[Column, Column]:
    """``distance`` between the boxes, and the ``method`` that says it is an approximation of that between surfaces."""
    return box_distance(a, b).alias("distance"), F.lit("axis-aligned boxes (approximate)").alias("method")


def contains(a: str, b: str) -> Column:
    """Whether ``a`` holds all of ``b``, faces included."""
    return _all([(F.col(f"{a}{x}0") <= F.col(f"{b}{x}0")) & (F.col(f"{a}{x}1") >= F.col(f"{b}{x}1")) for x in AXES])


def intersects(a: str, b: str) -> Column:
    """Touching counts."""
    return _all([(F.col(f"{a}{x}0") <= F.col(f"{b}{x}1")) & (F.col(f"{b}{x}0") <= F.col(f"{a}{x}1")) for x in AXES])


def adjacent(a: str, b: str, tolerance: float = 1.0) -> Column:
    return ~intersects(a, b) & (box_distance(a, b) <= tolerance)


def extent(p: str, x: str) -> Column:
    return F.greatest(F.col(f"{p}{x}1") - F.col(f"{p}{x}0"), F.lit(0.0))


def box_volume(p: str = "") -> Column:
    return extent(p, "x") * extent(p, "y") * extent(p, "z")


def box_surface_area(p: str = "") -> Column:
    return 2 * (extent(p, "x") * extent(p, "y") + extent(p, "x") * extent(p, "z") + extent(p, "y") * extent(p, "z"))


def max_extent(p: str = "") -> Column:
    return F.greatest(*(F.col(f"{p}{x}1") - F.col(f"{p}{x}0") for x in AXES))


def trajectory_length(s: str = "s", e: str = "e") -> Column:
    return norm([F.col(f"{e}{x}") - F.col(f"{s}{x}") for x in AXES])


def segment_intersects_box(s: str, e: str, b: str) -> Column:
    """Slab test for the segment from ``sx sy sz`` to ``ex ey ez``; an axis is parallel below 1e-12."""
    low, high, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for x in AXES:
        start, delta = F.col(f"{s}{x}"), F.col(f"{e}{x}") - F.col(f"{s}{x}")
        flat = F.abs(delta) < 1e-12
        t0 = F.when(~flat, (F.col(f"{b}{x}0") - start) / delta)
        t1 = F.when(~flat, (F.col(f"{b}{x}1") - start) / delta)
        low, high = F.greatest(low, F.least(t0, t1)), F.least(high, F.greatest(t0, t1))  # nulls don't count
        outside = outside | (flat & ((start < F.col(f"{b}{x}0")) | (start > F.col(f"{b}{x}1"))))
    return ~outside & (low <= high)


@F.pandas_udf(DoubleType())
def _least_distance(sx: pd.Series, sy: pd.Series, sz: pd.Series, ex: pd.Series, ey: pd.Series, ez: pd.Series, x0: pd.Series, y0: pd.Series, z0: pd.Series, x1: pd.Series, y1: pd.Series, z1: pd.Series) -> pd.Series:
    start, end, low, high = (np.array(c, dtype=float) for c in ((sx, sy, sz), (ex, ey, ez), (x0, y0, z0), (x1, y1, z1)))
    delta = end - start
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = np.concatenate([(low - start) / delta, (high - start) / delta])
        crossed[~(np.abs(np.concatenate([delta, delta])) >= 1e-12) | ~((crossed > 0) & (crossed < 1))] = 0.0
        ends = np.zeros((1, start.shape[1]))
        knots = np.sort(np.concatenate([ends, crossed, ends + 1]), axis=0)

        def squared(t: np.ndarray) -> np.ndarray:
            p = start + delta * t
            return (np.maximum(np.maximum(low - p, p - high), 0.0) ** 2).sum(axis=0)

        least = squared(knots[0])
        for t, after in zip(knots[:-1], knots[1:], strict=True):
            p = start + delta * ((t + after) / 2)
            face = np.where(p < low, low, high)
            out = (p < low) | (p > high)
            slope, curve = np.where(out, delta * (start - face), 0.0).sum(axis=0), np.where(out, delta * delta, 0.0).sum(axis=0)
            still = np.where(curve > 0, np.clip(-slope / curve, t, after), t)
            least = np.minimum(least, np.minimum(squared(after), squared(still)))
    return pd.Series(np.sqrt(least))


def segment_box_distance(s: str, e: str, b: str) -> Column:
    """Least distance of a segment and a box; null where one of their numbers is.

    Along the segment the squared distance is convex and, between the places where
    the segment passes a face's plane, quadratic. So the least value is at such a
    place, at an end, or at the stationary point of a piece, moved into the piece.
    Worked out in arrays for many pairs at once.
    """
    return _least_distance(*(F.col(f"{p}{x}") for p in (s, e) for x in AXES), *(F.col(f"{b}{x}{i}") for i in "01" for x in AXES))
