"""Box, area and distance of rings in one pass over their vertex arrays.

Rings arrive as Arrow lists: one flat array of numbers and the offsets of the rings in it. Each vertex is carried from bd09mc to
wgs84 and on to UTM once, for the whole batch; edges are neighbours in the flat arrays, and the figures of a ring are segmented
sums, minima and maxima between offsets. No vertex or edge becomes a row, so nothing is grouped or shuffled.

The formulas are those of ``functions.coords`` and ``functions.utm``, whose fixed values are used.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from placehull.functions.coords import (
    BD_ANGLE,
    BD_ANGULAR,
    BD_MERCATOR,
    BD_RADIAL,
    BD_SHIFT,
    GCJ_BOX,
    GCJ_LAT_POLY,
    GCJ_LAT_WAVES,
    GCJ_LNG_POLY,
    GCJ_LNG_WAVES,
    GCJ_ORIGIN,
    KRASOVSKY_A,
    KRASOVSKY_E2,
)
from placehull.functions.utm import ALPHA, ECCENTRICITY, FALSE_EASTING, RECTIFYING_RADIUS, UTM_SCALE, central_meridian

# Functions of this module travel to the executors by value: they need no copy of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Points = tuple[np.ndarray, np.ndarray]
MEASURES = ("edges", "min_lng", "max_lng", "min_lat", "max_lat", "area_km2", "distance_m")
KINDS = ("bigint", *["double"] * 6)


def mercator_to_bd09(x: np.ndarray, y: np.ndarray) -> Points:
    """NaN at or below the last band."""
    lng, lat = np.full(len(x), np.nan), np.full(len(x), np.nan)
    above = np.inf
    for low, intercept, slope, *poly, scale in BD_MERCATOR:
        here = (y > low) & (y <= above)
        above = low
        lng[here] = x[here] * slope + intercept
        lat[here] = np.polynomial.polynomial.polyval(y[here] / scale, poly)
    return lng, lat


def bd09_to_gcj02(lng: np.ndarray, lat: np.ndarray) -> Points:
    x, y = lng - BD_SHIFT[0], lat - BD_SHIFT[1]
    r = np.hypot(x, y) - BD_RADIAL * np.sin(y * BD_ANGLE)
    theta = np.arctan2(y, x) - BD_ANGULAR * np.cos(x * BD_ANGLE)
    return r * np.cos(theta), r * np.sin(theta)


def _offset(poly: Sequence[float], waves: Sequence[tuple[float, str, float]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = sum(c * p for c, p in zip(poly, (1.0, x, y, x * x, y * y, x * y, np.sqrt(np.abs(x)))) if c)
    for amplitude, axis, turns in waves:
        total = total + amplitude * 2 / 3 * np.sin((x if axis == "x" else y) * (turns * np.pi))
    return total


def gcj02_to_wgs84(lng: np.ndarray, lat: np.ndarray) -> Points:
    """One step of the inverse; points outside the box stay."""
    west, east, south, north = GCJ_BOX
    inside = (lng >= west) & (lng <= east) & (lat >= south) & (lat <= north)
    x, y = lng - GCJ_ORIGIN[0], lat - GCJ_ORIGIN[1]
    w = 1 - KRASOVSKY_E2 * np.sin(np.radians(lat)) ** 2
    per_metre = 180.0 / (KRASOVSKY_A * np.pi)
    d_lng = per_metre * _offset(GCJ_LNG_POLY, GCJ_LNG_WAVES, x, y) * np.sqrt(w) / np.cos(np.radians(lat))
    d_lat = per_metre / (1 - KRASOVSKY_E2) * _offset(GCJ_LAT_POLY, GCJ_LAT_WAVES, x, y) * w * np.sqrt(w)
    return np.where(inside, lng - d_lng, lng), np.where(inside, lat - d_lat, lat)


def wgs84_to_utm(lng: np.ndarray, lat: np.ndarray, meridian: float) -> Points:
    lam, s = np.radians(lng - meridian), np.sin(np.radians(lat))
    e = ECCENTRICITY
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    flat = np.arctan2(t, np.cos(lam)) + 1j * np.arctanh(np.sin(lam) / np.hypot(1, t))
    # sin(2 j (xi + i eta)) holds both series: its real part the northing's terms, its imaginary part the easting's
    bent = flat + sum(a * np.sin(2 * j * flat) for j, a in enumerate(ALPHA, start=1))
    k = UTM_SCALE * RECTIFYING_RADIUS
    return FALSE_EASTING + k * bent.imag, k * bent.real


def _distance(ax: np.ndarray, ay: np.ndarray, dx: np.ndarray, dy: np.ndarray, by: np.ndarray, at: np.ndarray) -> np.ndarray:
    """From the origin to each ring (edges from ``at`` on): 0 inside, else to the nearest edge."""
    with np.errstate(divide="ignore", invalid="ignore"):
        foot = -(ax * dx + ay * dy) / (dx * dx + dy * dy)
        crossing = ax - ay * dx / dy
    foot = np.clip(np.nan_to_num(foot, nan=0.0), 0.0, 1.0)
    gap = np.hypot(ax + foot * dx, ay + foot * dy)
    crosses = ((ay > 0) != (by > 0)) & (crossing > 0)
    inside = np.add.reduceat(crosses.astype(np.int64), at) % 2 == 1
    return np.where(inside, 0.0, np.minimum.reduceat(gap, at))


def measure(
    values: np.ndarray, offsets: np.ndarray, e0: np.ndarray, n0: np.ndarray, meridian: float, with_distance: bool = True
) -> dict[str, np.ndarray]:
    """Figures of closed rings: ``values`` x1, y1, x2, y2, ..., ring i between ``offsets`` i and i + 1, distance to (e0, n0).

    NaN where a vertex lies off every Mercator band; a ring has two vertices or more.
    """
    starts, ends = offsets[:-1] // 2, offsets[1:] // 2
    lng, lat = gcj02_to_wgs84(*bd09_to_gcj02(*mercator_to_bd09(values[0::2], values[1::2])))
    east, north = wgs84_to_utm(lng, lat, meridian)
    ring = np.repeat(np.arange(len(starts)), ends - starts)
    east, north = east - e0[ring], north - n0[ring]  # from the point: small products
    box = [f.reduceat(v, starts) for v in (lng, lat) for f in (np.minimum, np.maximum)]
    # an edge from each vertex to the next; the last vertex of a ring has none
    first = np.delete(np.arange(len(lng)), ends - 1)
    at = starts - np.arange(len(starts))
    ax, ay, bx, by = east[first], north[first], east[first + 1], north[first + 1]
    dx, dy = bx - ax, by - ay
    area = np.abs(np.add.reduceat(ax * by - bx * ay, at)) / 2e6
    distance = _distance(ax, ay, dx, dy, by, at) if with_distance else np.full(len(starts), np.nan)
    whole = ~np.isnan(area)
    edges = (ends - starts - 1).astype(np.float64)
    columns = [edges, *box, area, distance]
    return {name: np.where(whole, v, np.nan) for name, v in zip(MEASURES, columns)}


def ring_points(whole: bool = False) -> Callable:
    """Column function (numbers) -> the ring's vertices in wgs84 degrees, NaN off the bands; null without a ring.

    With ``whole`` a ring with a vertex off the bands is null.

    Nondeterministic like ``ring_measures``, for the same reason.
    """
    kind = pa.struct([("lng", pa.float64()), ("lat", pa.float64())])

    @F.arrow_udf("array<struct<lng: double, lat: double>>")
    def run(numbers: pa.Array) -> pa.Array:
        there = np.asarray(numbers.is_valid())
        rings = numbers.filter(pa.array(there))
        if not len(rings):
            return pa.nulls(len(numbers), pa.list_(kind))
        offsets = np.asarray(rings.offsets).astype(np.int64)
        values = np.asarray(rings.values)[offsets[0] : offsets[-1]]
        points = gcj02_to_wgs84(*bd09_to_gcj02(*mercator_to_bd09(values[0::2], values[1::2])))
        sizes = np.zeros(len(numbers), np.int32)
        sizes[there] = np.diff(offsets) // 2
        starts = np.append(0, np.cumsum(sizes)).astype(np.int32)
        vertices = pa.StructArray.from_arrays([pa.array(p) for p in points], fields=list(kind))
        if whole:
            off = np.append(0, np.cumsum(np.isnan(points[1])))
            there = there & (off[starts[1:]] == off[starts[:-1]])
        return pa.ListArray.from_arrays(pa.array(starts), vertices, mask=pa.array(~there))

    return run.asNondeterministic()


def ring_measures(zone: int, with_distance: bool = True) -> Callable:
    """Column function (numbers, e, n) -> struct of ``MEASURES``; null without a ring or off the bands.

    The distance is null as well where it is not asked for. It is declared nondeterministic, so that filters on its figures stay
    above it instead of being pushed down with a copy of it and of all steps below.
    """
    meridian = central_meridian(zone)
    kinds = pa.struct([(n, pa.int64() if k == "bigint" else pa.float64()) for n, k in zip(MEASURES, KINDS)])

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {k}" for n, k in zip(MEASURES, KINDS)) + ">")
    def run(numbers: pa.Array, e: pa.Array, n: pa.Array) -> pa.Array:
        there = np.asarray(numbers.is_valid())
        rings = numbers.filter(pa.array(there))
        if not len(rings):
            return pa.nulls(len(numbers), kinds)
        offsets = np.asarray(rings.offsets).astype(np.int64)
        values = np.asarray(rings.values)[offsets[0] : offsets[-1]]
        e0, n0 = (np.asarray(c.fill_null(np.nan), np.float64)[there] for c in (e, n))
        found = measure(values, offsets - offsets[0], e0, n0, meridian, with_distance)
        good = ~np.isnan(found["area_km2"])
        out = []
        for name, kind in zip(MEASURES, KINDS):
            column = np.zeros(len(numbers))
            column[there] = np.nan_to_num(found[name])
            none = np.ones(len(numbers), bool) if name == "distance_m" and not with_distance else None
            out.append(pa.array(column.astype(np.int64) if kind == "bigint" else column, mask=none))
        mask = np.ones(len(numbers), bool)
        mask[np.flatnonzero(there)[good]] = False
        return pa.StructArray.from_arrays(out, fields=list(kinds), mask=pa.array(mask))

    return run.asNondeterministic()
