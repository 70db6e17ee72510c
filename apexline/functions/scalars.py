"""Column functions: geometry, units, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG

#: The ellipsoid of the local frame, and miles in a kilometre.
R_EQUATOR, R_POLE = 6_378_000.0, 6_357_000.0
MPH = 0.621371


def rounded(value: Column | str, places: int) -> Column:
    """A double to so many places, halves away from zero, as SQL engines do: what is rounded is the scaled double.

    Spark's own round() takes the shortest decimal that means the double, so it decides halves otherwise: a crossing
    at 20.6505 s, or a distance of 1.0545 m, is a half that lies a bit above or below as a double.
    """
    x = (F.col(value) if isinstance(value, str) else value) * float(10**places)
    whole = F.rint(x)
    off = x - whole
    return F.when((off == 0.5) & (x > 0), whole + 1).when((off == -0.5) & (x < 0), whole - 1).otherwise(whole) / float(10**places) + 0.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.lit(2 * CONFIG.earth_m) * F.asin(F.sqrt(h))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(CONFIG.earth_m) * F.sqrt(x * x + F.radians(lat2 - lat1) ** 2)


def canonical(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in metres."""
    h, p, q = 1 + alt / R_EQUATOR, F.radians(lat), F.radians(lon)
    return h * R_EQUATOR * F.cos(p) * F.cos(q), h * R_EQUATOR * F.cos(p) * F.sin(q), h * R_POLE * F.sin(p)


def local_xy(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a point in the frame at (lat0, lon0) on the ground."""
    x, y, z = canonical(lat, lon, alt)
    x0, y0, z0 = canonical(lat0, lon0, F.lit(0.0))
    dx, dy, dz = x - x0, y - y0, z - z0
    p, q = F.radians(lat0), F.radians(lon0)
    # North and up along the gradients of the map, made unit vectors.
    nx, ny, nz = -R_EQUATOR * F.sin(p) * F.cos(q), -R_EQUATOR * F.sin(p) * F.sin(q), R_POLE * F.cos(p)
    ux, uy, uz = F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.lit(R_POLE / R_EQUATOR) * F.sin(p)
    unit = lambda a, b, c: F.sqrt(a * a + b * b + c * c)
    east = -dx * F.sin(q) + dy * F.cos(q)
    return east, (dx * nx + dy * ny + dz * nz) / unit(nx, ny, nz), (dx * ux + dy * uy + dz * uz) / unit(ux, uy, uz)


def crosses(x0: Column, y0: Column, x1: Column, y1: Column, line: Column) -> tuple[Column, Column]:
    """Whether a step straddles the segment ``line`` (x1, y1, x2, y2) strictly on both sides, and at what share of the step.

    The share is the distance to the line by the step's own way across it, by the line's unit direction,
    so that no length of the line is in it: across a line x = c it is (c - x0) / (x1 - x0), to the last bit.
    """
    side = lambda ax, ay, bx, by, px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    lx0, ly0, lx1, ly1 = (line[c] for c in ("x1", "y1", "x2", "y2"))
    a, b = side(lx0, ly0, lx1, ly1, x0, y0), side(lx0, ly0, lx1, ly1, x1, y1)
    c, d = side(x0, y0, x1, y1, lx0, ly0), side(x0, y0, x1, y1, lx1, ly1)
    hit = (a * b < 0) & (c * d < 0)
    length = F.sqrt((lx1 - lx0) * (lx1 - lx0) + (ly1 - ly0) * (ly1 - ly0))
    ux, uy = (lx1 - lx0) / length, (ly1 - ly0) / length
    return hit, F.when(hit, (uy * (lx0 - x0) - ux * (ly0 - y0)) / (uy * (x1 - x0) - ux * (y1 - y0)))


def speed(mps: Column, unit: str = "kmh") -> Column:
    kmh = mps * 3.6
    return kmh * MPH if unit == "mph" else kmh


def lap_clock(seconds: Column) -> Column:
    """``m:ss.mmm``; a dash where there is no time."""
    ms = F.bround(seconds * 1000).cast("long")
    shown = F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)
    return F.when(seconds.isNull() | F.isnan(seconds), "—").otherwise(shown)


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def delta_text(seconds: Column) -> Column:
    return F.when(F.abs(seconds) < 0.005, "0.00 s").otherwise(F.format_string("%+.2f s", seconds))


def lap_label(lap_id: Column) -> Column:
    return F.format_string("Lap %d", lap_id + 1)


def clean(value: Column, unknown: float | None = None) -> Column:
    """Null for NaN, infinities and the value that stands for unknown."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~(bad | (value == unknown) if unknown is not None else bad), value)


def saturate(value: Column, half: float) -> Column:
    """From 0 towards 1, a half at ``half``."""
    return value / (value + half)


def buckets(value: Column, low: Column, high: Column, n: int = 16) -> Column:
    """0 to n - 1 between ``low`` and ``high``; the middle if they are equal, -1 for null and NaN."""
    place = F.least(F.greatest(F.floor((value - low) / (high - low) * n), F.lit(0)), F.lit(n - 1))
    return F.when(value.isNull() | F.isnan(value), -1).when(high <= low, n // 2).otherwise(place).cast("int")


def global_of(east: Column, north: Column, up: Column, lat0: Column, lon0: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and altitude of a point in the frame of :func:`local_xy`: its inverse."""
    p, q = F.radians(lat0), F.radians(lon0)
    x0, y0, z0 = canonical(lat0, lon0, F.lit(0.0))
    n = F.sqrt((R_EQUATOR * F.sin(p)) ** 2 + (R_POLE * F.cos(p)) ** 2)
    u = F.sqrt(F.cos(p) ** 2 + (R_POLE / R_EQUATOR * F.sin(p)) ** 2)
    # North and up aren't quite square to each other: two equations for the parts along the ground's radius and the axis.
    a, b, c, d = -R_EQUATOR * F.sin(p) / n, R_POLE * F.cos(p) / n, F.cos(p) / u, R_POLE / R_EQUATOR * F.sin(p) / u
    det = a * d - b * c
    level, axial = (d * north - b * up) / det, (a * up - c * north) / det
    x = x0 - east * F.sin(q) + level * F.cos(q)
    y = y0 + east * F.cos(q) + level * F.sin(q)
    z = z0 + axial
    flat, high = F.sqrt(x * x + y * y) / R_EQUATOR, z / R_POLE
    return F.degrees(F.atan2(high, flat)), F.degrees(F.atan2(y, x)), (F.sqrt(flat * flat + high * high) - 1) * R_EQUATOR


def clock_text(ms: Column) -> Column:
    """HH:MM in UTC of milliseconds since 1970; null where unknown (0 or less)."""
    minutes = F.floor(ms / 60_000).cast("long") % 1440
    return F.when(ms > 0, F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")))


def line_to_global(line: Column, lat0: Column, lon0: Column) -> Column:
    """A timing line's ends as (lat1, lon1, lat2, lon2): the form that outlasts a recording's own frame."""
    ends = [global_of(line[f"x{i}"], line[f"y{i}"], F.lit(0.0), lat0, lon0) for i in (1, 2)]
    return F.struct(*[v.alias(f"{n}{i}") for i, (lat, lon, _) in enumerate(ends, 1) for n, v in (("lat", lat), ("lon", lon))])


def line_to_local(line: Column, lat0: Column, lon0: Column) -> Column:
    """The inverse of :func:`line_to_global`, in the frame at (lat0, lon0)."""
    ends = [local_xy(line[f"lat{i}"], line[f"lon{i}"], F.lit(0.0), lat0, lon0) for i in (1, 2)]
    return F.struct(*[v.alias(f"{n}{i}") for i, (east, north, _) in enumerate(ends, 1) for n, v in (("x", east), ("y", north))])


def instant_ms(text: Column) -> Column:
    """Milliseconds since 1970 of a written time, in UTC unless it names another zone; null for what is no time."""
    named = text.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$")
    return F.unix_millis(F.try_to_timestamp(F.when(named, F.trim(text)).otherwise(F.concat(F.trim(text), F.lit("Z")))))
