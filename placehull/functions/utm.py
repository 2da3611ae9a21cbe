"""wgs84 degrees to UTM metres by the sixth-order Krüger series (Karney 2011)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placehull.functions.coords import num, stage_cut

# --- fixed values: WGS-84 ellipsoid and UTM grid ---
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0

_N = WGS84_F / (2 - WGS84_F)
ECCENTRICITY = math.sqrt(WGS84_F * (2 - WGS84_F))
RECTIFYING_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# numerators and denominators of the n-powers of each alpha, lowest power first
_ALPHA_TERMS = (
    (1, ((1, 2), (-2, 3), (5, 16), (41, 180), (-127, 288), (7891, 37800))),
    (2, ((13, 48), (-3, 5), (557, 1440), (281, 630), (-1983433, 1935360))),
    (3, ((61, 240), (-103, 140), (15061, 26880), (167603, 181440))),
    (4, ((49561, 161280), (-179, 168), (6601661, 7257600))),
    (5, ((34729, 80640), (-3418889, 1995840))),
    (6, ((212378941, 319334400),)),
)
ALPHA = tuple(
    sum(p / q * _N ** (order + k) for k, (p, q) in enumerate(terms))
    for order, terms in _ALPHA_TERMS
)


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def to_utm(
    df: DataFrame,
    points: Sequence[tuple[tuple[str, str], tuple[str, str]]],
    zone: int = 50,
    cut: bool = False,
) -> DataFrame:
    """Add UTM columns for several ((lng, lat), (easting, northing)) pairs (northern grid).

    The multiples of the two angles come from the double- and sum-angle identities, one
    staged select per doubling, so only a dozen transcendental calls are made per point.
    Missing coordinates are NaN in and out, as in the other conversions. ``cut`` divides the
    generated code in the middle, for use on rows as numerous as vertices.
    """
    kept = [c for c in df.columns if c not in {c for _, outs in points for c in outs}]

    def stage(df: DataFrame, build) -> DataFrame:
        return df.withColumns({
            name: F.expr(sql)
            for i, (ins, outs) in enumerate(points)
            for name, sql in build(ins, outs, f"__utm{i}_").items()
        })

    def conformal(ins, outs, t):
        lng, lat = ins
        s, e = f"sin(radians({lat}))", num(ECCENTRICITY)
        return {
            f"{t}lam": f"radians({lng} - {num(central_meridian(zone))})",
            f"{t}t": f"sinh(atanh({s}) - {e} * atanh({e} * {s}))",
        }

    def spherical(ins, outs, t):
        return {
            f"{t}xi": f"atan2({t}t, cos({t}lam))",
            f"{t}eta": f"atanh(sin({t}lam) * cos(atan({t}t)))",
        }

    def first_multiple(ins, outs, t):
        return {
            f"{t}s1": f"sin(2D * {t}xi)", f"{t}c1": f"cos(2D * {t}xi)",
            f"{t}h1": f"sinh(2D * {t}eta)", f"{t}g1": f"cosh(2D * {t}eta)",
        }

    def multiples(*sums):
        def build(ins, outs, t):
            out = {}
            for k, a, b in sums:
                out[f"{t}s{k}"] = f"{t}s{a} * {t}c{b} + {t}c{a} * {t}s{b}"
                out[f"{t}c{k}"] = f"{t}c{a} * {t}c{b} - {t}s{a} * {t}s{b}"
                out[f"{t}h{k}"] = f"{t}h{a} * {t}g{b} + {t}g{a} * {t}h{b}"
                out[f"{t}g{k}"] = f"{t}g{a} * {t}g{b} + {t}h{a} * {t}h{b}"
            return out

        return build

    def grid(ins, outs, t):
        series = list(enumerate(ALPHA, start=1))
        east = " + ".join(f"{num(a)} * {t}c{j} * {t}h{j}" for j, a in series)
        north = " + ".join(f"{num(a)} * {t}s{j} * {t}g{j}" for j, a in series)
        k = num(UTM_SCALE * RECTIFYING_RADIUS)
        return {
            outs[0]: f"{num(FALSE_EASTING)} + {k} * ({t}eta + {east})",
            outs[1]: f"{k} * ({t}xi + {north})",
        }

    df = stage(stage(df, conformal), spherical)
    if cut:
        angles = [f"__utm{i}_{a}" for i in range(len(points)) for a in ("xi", "eta")]
        df = stage_cut(df.select(*kept, *angles), angles)
    for build in (first_multiple, multiples((2, 1, 1)), multiples((3, 2, 1), (4, 2, 2)),
                  multiples((5, 4, 1), (6, 3, 3)), grid):
        df = stage(df, build)
    return df.select(*kept, *[c for _, outs in points for c in outs])
