"""Coordinate systems as column expressions.

A *step* maps the names of an (x, y) pair of columns to the SQL texts of another pair. A
conversion is a list of steps, applied one ``withColumns`` at a time, so that each
intermediate value is computed once per row. Texts rather than ``Column`` arithmetic: a step
then costs one call into the JVM instead of hundreds.

Inside a conversion a missing value is NaN, never null, and no step divides (in Spark a
quotient is always nullable): generated code for non-null doubles is a fraction of the size,
which keeps the loop over vertices below the size limit of the JIT compiler.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pair = tuple[str, str]
Step = Callable[[str, str], Pair]

# --- fixed values of the published systems -------------------------------------------------
KRASOVSKY_A = 6378245.0
KRASOVSKY_E2 = 0.00669342162296594323
GCJ_ORIGIN = (105.0, 35.0)
GCJ_BOX = (72.004, 137.8347, 0.8293, 55.8271)  # lng min, lng max, lat min, lat max
# (constant, x, y, x*x, y*y, x*y, sqrt|x|)
GCJ_LAT_POLY = (-100.0, 2.0, 3.0, 0.0, 0.2, 0.1, 0.2)
GCJ_LNG_POLY = (300.0, 1.0, 2.0, 0.1, 0.0, 0.1, 0.1)
# (amplitude, axis, angular factor in units of pi); every term is scaled by 2/3
GCJ_LAT_WAVES = (
    (20.0, "x", 6.0), (20.0, "x", 2.0), (20.0, "y", 1.0),
    (40.0, "y", 1 / 3), (160.0, "y", 1 / 12), (320.0, "y", 1 / 30),
)
GCJ_LNG_WAVES = (
    (20.0, "x", 6.0), (20.0, "x", 2.0), (20.0, "x", 1.0),
    (40.0, "x", 1 / 3), (150.0, "x", 1 / 12), (300.0, "x", 1 / 30),
)
BD_ANGLE = math.pi * 3000.0 / 180.0
BD_RADIAL, BD_ANGULAR = 0.00002, 0.000003
BD_SHIFT = (0.0065, 0.006)
# bd09mc: lower bound of y, then lng intercept, lng slope, seven lat coefficients, y scale
BD_MERCATOR = (
    (12890594.86,
     1.410526172116255e-8, 0.00000898305509648872, -1.9939833816331, 200.9824383106796,
     -187.2403703815547, 91.6087516669843, -23.38765649603339, 2.57121317296198,
     -0.03801003308653, 17337981.2),
    (8362377.87,
     -7.435856389565537e-9, 0.000008983055097726239, -0.78625201886289, 96.32687599759846,
     -1.85204757529826, -59.36935905485877, 47.40033549296737, -16.50741931063887,
     2.28786674699375, 10260144.86),
    (5591021,
     -3.030883460898826e-8, 0.00000898305509983578, 0.30071316287616, 59.74293618442277,
     7.357984074871, -25.38371002664745, 13.45380521110908, -3.29883767235584,
     0.32710905363475, 6856817.37),
    (3481989.83,
     -1.981981304930552e-8, 0.000008983055099779535, 0.03278182852591, 40.31678527705744,
     0.65659298677277, -4.44255534477492, 0.85341911805263, 0.12923347998204,
     -0.04625736007561, 4482777.06),
    (1678043.12,
     3.09191371068437e-9, 0.000008983055096812155, 0.00006995724062, 23.10934304144901,
     -0.00023663490511, -0.6321817810242, -0.00663494467273, 0.03430082397953,
     -0.00466043876332, 2555164.4),
    (0,
     2.890871144776878e-9, 0.000008983055095805407, -3.068298e-8, 7.47137025468032,
     -0.00000353937994, -0.02145144861037, -0.00001234426596, 0.00010322952773,
     -0.00000323890364, 826088.5),
)
HAVERSINE_RADIUS_KM = 6378.137
# --------------------------------------------------------------------------------------------


def num(value: float) -> str:
    """A double literal in SQL text."""
    return f"({float(value)!r}D)"


NAN = "double('NaN')"


def outside_china(lng: str, lat: str) -> str:
    """True where the gcj02 offset does not apply."""
    west, east, south, north = (num(v) for v in GCJ_BOX)
    return f"({lng} < {west} or {lng} > {east} or {lat} < {south} or {lat} > {north})"


def _series(poly: Sequence[float], waves, x: str, y: str) -> str:
    powers = ("1D", x, y, f"{x} * {x}", f"{y} * {y}", f"{x} * {y}", f"sqrt(abs({x}))")
    terms = [f"{num(c)} * {p}" for c, p in zip(poly, powers) if c]
    for amplitude, axis, turns in waves:
        angle = f"{x if axis == 'x' else y} * {num(turns * math.pi)}"
        terms.append(f"{num(amplitude * 2 / 3)} * sin({angle})")
    return "(" + " + ".join(terms) + ")"


def gcj_lat_series(x: str, y: str) -> str:
    """Latitude offset in metres; x, y are degrees from the series origin."""
    return _series(GCJ_LAT_POLY, GCJ_LAT_WAVES, x, y)


def gcj_lng_series(x: str, y: str) -> str:
    """Longitude offset in metres; x, y are degrees from the series origin."""
    return _series(GCJ_LNG_POLY, GCJ_LNG_WAVES, x, y)


def _gcj_shift(sign: int) -> Step:
    def step(lng: str, lat: str) -> Pair:
        x, y = f"({lng} - {num(GCJ_ORIGIN[0])})", f"({lat} - {num(GCJ_ORIGIN[1])})"
        w = f"(1D - {num(KRASOVSKY_E2)} * sin(radians({lat})) * sin(radians({lat})))"
        east = num(sign * 180.0 / (KRASOVSKY_A * math.pi))
        north = num(sign * 180.0 / (KRASOVSKY_A * math.pi * (1 - KRASOVSKY_E2)))
        d_lng = f"{east} * {gcj_lng_series(x, y)} * sqrt({w}) * sec(radians({lat}))"
        d_lat = f"{north} * {gcj_lat_series(x, y)} * {w} * sqrt({w})"
        away = outside_china(lng, lat)
        return (
            f"case when {away} then {lng} else {lng} + {d_lng} end",
            f"case when {away} then {lat} else {lat} + {d_lat} end",
        )

    return step


def _to_polar_bd(lng: str, lat: str) -> Pair:
    k = num(BD_ANGLE)
    return (
        f"sqrt({lng} * {lng} + {lat} * {lat}) + {num(BD_RADIAL)} * sin({lat} * {k})",
        f"atan2({lat}, {lng}) + {num(BD_ANGULAR)} * cos({lng} * {k})",
    )


def _from_polar_bd(r: str, theta: str) -> Pair:
    return f"{r} * cos({theta}) + {num(BD_SHIFT[0])}", f"{r} * sin({theta}) + {num(BD_SHIFT[1])}"


def _unshift_bd(lng: str, lat: str) -> Pair:
    return f"{lng} - {num(BD_SHIFT[0])}", f"{lat} - {num(BD_SHIFT[1])}"


def _to_polar_gcj(x: str, y: str) -> Pair:
    k = num(BD_ANGLE)
    return (
        f"sqrt({x} * {x} + {y} * {y}) - {num(BD_RADIAL)} * sin({y} * {k})",
        f"atan2({y}, {x}) - {num(BD_ANGULAR)} * cos({x} * {k})",
    )


def _from_polar(r: str, theta: str) -> Pair:
    return f"{r} * cos({theta})", f"{r} * sin({theta})"


def _mercator_to_bd(x: str, y: str) -> Pair:
    """Band picked by y; y at or below the last bound (and NaN) gives NaN."""
    lng = lat = f"case when isnan({y}) then {NAN}"
    for low, intercept, slope, *poly, scale in BD_MERCATOR:
        c = f"({y} * {num(1 / scale)})"
        value = num(poly[-1])
        for coefficient in reversed(poly[:-1]):
            value = f"({value} * {c} + {num(coefficient)})"
        lng += f" when {y} > {num(low)} then {x} * {num(slope)} + {num(intercept)}"
        lat += f" when {y} > {num(low)} then {value}"
    return f"{lng} else {NAN} end", f"{lat} else {NAN} end"


GCJ02_TO_WGS84: list[Step] = [_gcj_shift(-1)]
WGS84_TO_GCJ02: list[Step] = [_gcj_shift(1)]
GCJ02_TO_BD09: list[Step] = [_to_polar_bd, _from_polar_bd]
BD09_TO_GCJ02: list[Step] = [_unshift_bd, _to_polar_gcj, _from_polar]
BD09MC_TO_BD09: list[Step] = [_mercator_to_bd]

CONVERSIONS: dict[tuple[str, str], list[Step]] = {
    ("wgs84", "wgs84"): [],
    ("wgs84", "gcj02"): WGS84_TO_GCJ02,
    ("gcj02", "wgs84"): GCJ02_TO_WGS84,
    ("gcj02", "bd09"): GCJ02_TO_BD09,
    ("bd09", "gcj02"): BD09_TO_GCJ02,
    ("wgs84", "bd09"): WGS84_TO_GCJ02 + GCJ02_TO_BD09,
    ("bd09", "wgs84"): BD09_TO_GCJ02 + GCJ02_TO_WGS84,
    ("bd09mc", "bd09"): BD09MC_TO_BD09,
    ("bd09mc", "wgs84"): BD09MC_TO_BD09 + BD09_TO_GCJ02 + GCJ02_TO_WGS84,
}


def or_nan(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(math.nan))


def or_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def run_steps(
    df: DataFrame, steps: Sequence[Step], points: Sequence[tuple[tuple[str, str], tuple[str, str]]]
) -> DataFrame:
    """Apply ``steps`` to several ((in_x, in_y), (out_x, out_y)) pairs side by side (NaN = missing)."""
    df = df.withColumns({o: or_nan(F.col(i)) for ins, outs in points for i, o in zip(ins, outs)})
    for step in steps:
        df = df.withColumns({
            name: F.expr(sql) for _, pair in points for name, sql in zip(pair, step(*pair))
        })
    return df


def stage_cut(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hand the columns on through a generator that has no generated code.

    Spark fuses a chain of projections into one method, and the JIT compiler leaves a method
    of more than 8000 bytes interpreted, which is tens of times slower here. A cut ends the
    fused method for about the price of copying the row, and keeps the partitioning.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.transform(F.array(F.struct(*columns)), lambda v: v)))


def convert(
    df: DataFrame,
    source: str,
    target: str,
    lng: str = "lng",
    lat: str = "lat",
    out: tuple[str, str] = ("lng", "lat"),
) -> DataFrame:
    """Add ``out`` columns holding (lng, lat) reprojected from ``source`` to ``target``."""
    df = run_steps(df, CONVERSIONS[source, target], [((lng, lat), out)])
    return df.withColumns({c: or_null(F.col(c)) for c in out})


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians(lat1 - lat2) / 2)
    half_lng = F.sin(F.radians(lng1 - lng2) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * F.lit(2 * HAVERSINE_RADIUS_KM)
