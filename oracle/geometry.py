"""SQL fragments for coordinate conversions; each returns CTE items stacked on a source CTE."""

from __future__ import annotations

from placehull.functions.coords import BD_MERCATOR
from placehull.functions.utm import ALPHA, ECCENTRICITY, RECTIFYING_RADIUS, UTM_SCALE

BD = "(pi() * 3000.0 / 180.0)"


def gcj(src: str, name: str, lng: str, lat: str, sign: str) -> str:
    """Columns lng/lat of ``src`` moved by the gcj02 offset (sign + or -)."""
    return f"""{name}_a as (select *, {lng} - 105.0 as gx, {lat} - 35.0 as gy,
  1 - 0.00669342162296594323 * sin(radians({lat})) * sin(radians({lat})) as gw from {src}),
{name}_b as (select *,
  -100.0 + 2.0*gx + 3.0*gy + 0.2*gy*gy + 0.1*gx*gy + 0.2*sqrt(abs(gx))
   + (20.0*sin(6.0*gx*pi()) + 20.0*sin(2.0*gx*pi())) * 2.0/3.0
   + (20.0*sin(gy*pi()) + 40.0*sin(gy/3.0*pi())) * 2.0/3.0
   + (160.0*sin(gy/12.0*pi()) + 320.0*sin(gy/30.0*pi())) * 2.0/3.0 as mlat,
  300.0 + gx + 2.0*gy + 0.1*gx*gx + 0.1*gx*gy + 0.1*sqrt(abs(gx))
   + (20.0*sin(6.0*gx*pi()) + 20.0*sin(2.0*gx*pi())) * 2.0/3.0
   + (20.0*sin(gx*pi()) + 40.0*sin(gx/3.0*pi())) * 2.0/3.0
   + (150.0*sin(gx/12.0*pi()) + 300.0*sin(gx/30.0*pi())) * 2.0/3.0 as mlng
 from {name}_a),
{name} as (select * exclude (gx, gy, gw, mlat, mlng) replace (
  case when {outside(lng, lat)} then {lng}
    else {lng} {sign} mlng * 180.0 / (6378245.0 / sqrt(gw) * cos(radians({lat})) * pi()) end as {lng},
  case when {outside(lng, lat)} then {lat}
    else {lat} {sign} mlat * 180.0 / (6378245.0 * (1 - 0.00669342162296594323) / (gw * sqrt(gw)) * pi()) end as {lat})
 from {name}_b)"""


def outside(lng: str, lat: str) -> str:
    return f"({lng} < 72.004 or {lng} > 137.8347 or {lat} < 0.8293 or {lat} > 55.8271)"


def to_bd(src: str, name: str, lng: str, lat: str) -> str:
    return f"""{name}_a as (select *,
  sqrt({lng}*{lng} + {lat}*{lat}) + 0.00002*sin({lat}*{BD}) as bz,
  atan2({lat}, {lng}) + 0.000003*cos({lng}*{BD}) as bt from {src}),
{name} as (select * exclude (bz, bt) replace (bz*cos(bt) + 0.0065 as {lng}, bz*sin(bt) + 0.006 as {lat}) from {name}_a)"""


def from_bd(src: str, name: str, lng: str, lat: str) -> str:
    return f"""{name}_a as (select *, {lng} - 0.0065 as qx, {lat} - 0.006 as qy from {src}),
{name}_b as (select *, sqrt(qx*qx + qy*qy) - 0.00002*sin(qy*{BD}) as bz,
  atan2(qy, qx) - 0.000003*cos(qx*{BD}) as bt from {name}_a),
{name} as (select * exclude (qx, qy, bz, bt) replace (bz*cos(bt) as {lng}, bz*sin(bt) as {lat}) from {name}_b)"""


def bd_to_wgs(src: str, name: str, lng: str, lat: str) -> str:
    return from_bd(src, f"{name}_g", lng, lat) + ",\n" + gcj(f"{name}_g", name, lng, lat, "-")


def mercator_to_bd(src: str, name: str, lng: str, lat: str) -> str:
    """Columns hold Mercator metres on the way in and bd09 degrees on the way out."""
    def poly(p, scale):
        return " + ".join([repr(p[0])] + [f"({c!r}) * pow({lat} / {scale!r}, {i})" for i, c in enumerate(p[1:], 1)])

    lngs = " ".join(f"when {lat} > {low!r} then {a!r} + {b!r} * {lng}" for low, a, b, *_ in BD_MERCATOR)
    lats = " ".join(f"when {lat} > {low!r} then {poly(p, s)}" for low, _, _, *p, s in BD_MERCATOR)
    return f"{name} as (select * replace (case {lngs} end as {lng}, case {lats} end as {lat}) from {src})"


def mercator_to_wgs(src: str, name: str, lng: str, lat: str) -> str:
    return mercator_to_bd(src, f"{name}_m", lng, lat) + ",\n" + bd_to_wgs(f"{name}_m", name, lng, lat)


def utm(src: str, name: str, lng: str, lat: str, e: str, n: str) -> str:
    """Adds columns e, n (zone 50) computed by the plain series."""
    east = " + ".join(f"({a!r})*cos({2*j}*uxi)*sinh({2*j}*ueta)" for j, a in enumerate(ALPHA, 1))
    north = " + ".join(f"({a!r})*sin({2*j}*uxi)*cosh({2*j}*ueta)" for j, a in enumerate(ALPHA, 1))
    k = f"cast({UTM_SCALE * RECTIFYING_RADIUS!r} as double)"
    return f"""{name}_a as (select *, radians({lng} - 117.0) as ulam,
  sinh(atanh(sin(radians({lat}))) - {ECCENTRICITY!r} * atanh({ECCENTRICITY!r} * sin(radians({lat})))) as ut from {src}),
{name}_b as (select *, atan2(ut, cos(ulam)) as uxi,
  asinh(sin(ulam) / sqrt(ut*ut + cos(ulam)*cos(ulam))) as ueta from {name}_a),
{name} as (select * exclude (ulam, ut, uxi, ueta), 500000.0 + {k}*(ueta + {east}) as {e},
  {k}*(uxi + {north}) as {n} from {name}_b)"""


def haversine(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return f"""2 * 6378.137 * asin(least(1.0, sqrt(
  pow(sin(radians({lat1} - {lat2}) / 2), 2)
  + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng1} - {lng2}) / 2), 2))))"""
