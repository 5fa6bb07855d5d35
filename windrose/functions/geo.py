"""Coordinates, capacities by place, and spatial predicates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .scalar import finite


def to_180(lon: Column) -> Column:
    """longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def to_360(lon: Column) -> Column:
    """longitude in [0, 360)."""
    return F.pmod(lon, F.lit(360.0))


def pv_density(lat: Column) -> Column:
    """MW per square kilometre at a latitude: panel output over the row spacing
    that keeps rows unshaded at the winter solstice."""
    tilt = F.radians(K.PV_TILT[0] * F.abs(lat) + K.PV_TILT[1])
    low_sun = F.radians(F.greatest(90.0 - F.abs(lat) - K.SOLSTICE_TILT, F.lit(0.1)))
    return K.PV_PEAK * K.PV_FILL * F.cos(tilt) / (F.cos(tilt) + F.sin(tilt) / F.tan(low_sun))


def turbine_capacity_gw() -> Column:
    """of one turbine, from the area between turbines."""
    return F.lit((K.SPACING_ROTORS * K.ROTOR_M / 1000) ** 2 * K.WIND_DENSITY / 1000)


def polygon_capacity_gw(area_m2: Column, lat: Column) -> Column:
    """Of a solar polygon; 0 where it isn't finite."""
    cap = area_m2 / 1e6 * pv_density(lat) / 1000
    return F.when(finite(cap), cap).otherwise(0.0)


def grid_capacity_gw(tech: Column, percent: Column, area_km2: Column, landmask: Column) -> Column:
    """of a grid cell with so many per cent of usable area."""
    share = percent / 100.0
    wind = F.when(landmask > K.LAND_FROM, K.GRID_WIND_LAND).otherwise(K.GRID_WIND_OTHER)
    return F.when(tech == "solar", K.GRID_PV_DENSITY).otherwise(wind) * share * area_km2 / 1000


def cell_centre(row: Column, col: Column) -> tuple[Column, Column]:
    """longitude and latitude of a cell of the one-degree grid."""
    return col - 179.5, 89.5 - row


def web_mercator_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """longitude and latitude."""
    r = K.WEB_MERCATOR_RADIUS
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - F.pi() / 2)


def to_rotated(lon: Column, lat: Column, pole: tuple[float, float] = K.ROTATED_POLE) -> tuple[Column, Column]:
    """F8: longitude and latitude about a rotated pole."""
    d, f = F.radians(lon - pole[0]), F.radians(lat)
    p = F.radians(F.lit(pole[1]))
    rlat = F.degrees(F.asin(F.sin(f) * F.sin(p) + F.cos(f) * F.cos(p) * F.cos(d)))
    # 0 - x, not -x: a negative zero would turn 180 into -180
    rlon = F.degrees(F.atan2((0.0 - F.sin(d)) * F.cos(f), F.cos(p) * F.sin(f) - F.sin(p) * F.cos(f) * F.cos(d)))
    return rlon, rlat


def in_rotated_domain(lon: Column, lat: Column, domain: tuple[float, float, float, float]) -> Column:
    """domain = (west, east, south, north) in rotated degrees, all inclusive."""
    rlon, rlat = to_rotated(lon, lat)
    return rlon.between(domain[0], domain[1]) & rlat.between(domain[2], domain[3])


def in_box(lon: Column, lat: Column, north: Column, west: Column, south: Column, east: Column) -> Column:
    """Inclusive; a box with west beyond east goes over 0 degrees."""
    x = to_360(lon)
    inside = F.when(west <= east, (x >= west) & (x <= east)).otherwise((x >= west) | (x <= east))
    return (lat <= north) & (lat >= south) & inside


def crosses(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray to the east meets the edge; an odd number means inside."""
    at = (x2 - x1) * F.try_divide(lat - y1, y2 - y1) + x1
    return ((y1 > lat) != (y2 > lat)) & F.coalesce(lon < at, F.lit(False))


def on_edge(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """On the edge itself."""
    straight = (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) == 0
    return straight & lon.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))


def boundary(west: Column, east: Column, south: Column, north: Column, n: int) -> Column:
    """n points on each edge of a rectangle, as structs of side, step, lon, lat."""
    part = lambda a, b, k: a + (b - a) * k / float(n - 1)
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    side = lambda s, x, y: F.transform(steps, lambda k: F.struct(F.lit(s).alias("side"), k.alias("step"), x(k).alias("lon"), y(k).alias("lat")))
    return F.concat(
        side(0, lambda k: part(west, east, k), lambda k: north + k * 0.0),
        side(1, lambda k: east + k * 0.0, lambda k: part(north, south, k)),
        side(2, lambda k: part(east, west, k), lambda k: south + k * 0.0),
        side(3, lambda k: west + k * 0.0, lambda k: part(south, north, k)),
    )
