"""Geodesy and plane geometry as columns. Rings are arrays of struct<x, y>."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32
#: Ellipsoids (semi-major axis, flattening) and the seven parameters from Pulkovo 1942 to WGS84
#: (metres, arc seconds, parts per million; coordinate-frame rotation).
KRASSOVSKY = (6378245.0, 1 / 298.3)
WGS84 = (6378137.0, 1 / 298.257223563)
PULKOVO_TO_WGS84 = (23.92, -141.27, -80.9, 0.0, -0.35, -0.82, -0.12)
#: The same from Pulkovo 1942(83), in the same sense of rotation.
PULKOVO83_TO_WGS84 = (24.0, -123.0, -94.0, -0.02, 0.25, 0.13, 1.1)
TO_WGS84 = {4284: PULKOVO_TO_WGS84, 4179: PULKOVO83_TO_WGS84}
#: Parameter sets with the area they are for (west, south, east, north; west over east: across 180) and how many metres they are good to.
SHIFTS = (
    (4284, (19.57, 35.14, -168.97, 81.91), 3.0, PULKOVO_TO_WGS84),
    (4179, (9.92, 41.24, 28.68, 54.74), 2.0, PULKOVO83_TO_WGS84),
)
UTM_SCALE, UTM_EASTING, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0
MERCATOR_RADIUS = 6378137.0


def bbox_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    middle = F.radians((south + north) / 2)
    return F.abs(east - west) * KM_PER_DEGREE * F.cos(middle) * F.abs(north - south) * KM_PER_DEGREE


def shift_metres(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Planar distance between two near points in degrees."""
    per = KM_PER_DEGREE * 1000
    return F.hypot((lon1 - lon0) * per * F.cos(F.radians(lat0)), (lat1 - lat0) * per)


def centre_span_bbox(lon: Column, lat: Column, width_km: Column, height_km: Column) -> tuple[Column, Column, Column, Column]:
    """west, south, east, north of a box given by its centre and extent."""
    dy = height_km / (2 * KM_PER_DEGREE)
    dx = width_km / (2 * KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    return lon - dx, lat - dy, lon + dx, lat + dy


def ordered_bbox(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return MERCATOR_RADIUS * F.radians(lon), MERCATOR_RADIUS * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Back from `mercator`."""
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - math.pi / 2)


def ring_mercator(ring: Column) -> Column:
    """A ring in degrees on the Mercator plane, in metres."""

    def moved(p: Column) -> Column:
        x, y = mercator(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, moved)


def degrees_minutes(degrees: Column, minutes: Column) -> Column:
    return degrees + minutes / 60


def to_wgs84(lon: Column, lat: Column, code: int = 4284) -> tuple[Column, Column]:
    """Longitude and latitude on WGS84 of a point on Pulkovo 1942, or the datum of another code with parameters: to earth-centred axes on one ellipsoid, a
    seven-parameter shift, and back on the other. The way back is a closed approximation, good to micrometres at
    the surface."""
    a, f = KRASSOVSKY
    e2 = f * (2 - f)
    phi, lam = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    x, y, z = n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - e2) * F.sin(phi)
    dx, dy, dz, rx, ry, rz, ppm = TO_WGS84[code]
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    s = 1 + ppm * 1e-6
    u, v, w = dx + s * (x + rz * y - ry * z), dy + s * (-rz * x + y + rx * z), dz + s * (ry * x - rx * y + z)
    a, f = WGS84
    e2, b = f * (2 - f), a * (1 - f)
    p = F.hypot(u, v)
    theta = F.atan2(w * a, p * b)
    back = F.atan2(w + (a * a - b * b) / b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))
    return F.degrees(F.atan2(v, u)), F.degrees(back)


def best_parameters(code: Column, lon: Column, lat: Column, shifts=SHIFTS) -> Column:
    """The seven parameters for a datum at a place, as an array: of the sets of that code, one whose area holds the place comes before
    one whose area doesn't, then the one that is good to fewer metres, then the one listed first. NULL without a set."""
    rated = []
    for k, (of, (west, south, east, north), metres, v) in enumerate(shifts):
        there = lat.between(south, north) & (lon.between(west, east) if west <= east else (lon >= west) | (lon <= east))
        values = F.array(*[F.lit(float(x)) for x in (*v[:3], *(math.radians(r / 3600) for r in v[3:6]), 1 + v[6] * 1e-6)])
        away = F.when(F.coalesce(there, F.lit(False)), 0).otherwise(1)
        rated.append(F.when(code == of, F.struct(away.alias("away"), F.lit(float(metres)).alias("metres"), F.lit(k).alias("k"), values.alias("values"))))
    return F.array_min(F.array_compact(F.array(*rated)))["values"]


def ring_to_wgs84(ring: Column, code: Column, shifts=SHIFTS) -> Column:
    """A ring on the datum of each row's code, point by point as to_wgs84 does it with the set that is best at the ring's first
    corner; NULL for codes without parameters."""
    first = F.get(ring, F.lit(0))
    return ring_shifted(ring, best_parameters(code, first["x"], first["y"], shifts))


def ring_on_wgs84(ring: Column, code: int) -> Column:
    """A ring given on WGS84 (4326), the Mercator plane (3857), the north polar plane (3413) or a datum of SHIFTS, on WGS84."""
    if code == 4326:
        return ring
    planes = {3857: mercator_to_lonlat, 3413: polar_to_lonlat}
    if code in planes:

        def back(p: Column) -> Column:
            lon, lat = planes[code](p["x"], p["y"])
            return F.struct(lon.alias("x"), lat.alias("y"))

        return F.transform(ring, back)
    if code not in {s[0] for s in SHIFTS}:
        raise ValueError(f"no way to WGS84 from code {code}")
    return ring_to_wgs84(ring, F.lit(code))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A box as a closed ring, counter-clockwise from its lower left corner; edges may be given in either order."""
    (w, e), (s, n) = ordered_bbox(west, east), ordered_bbox(south, north)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))


def ring_shifted(ring: Column, chosen: Column) -> Column:
    """A ring moved by seven parameters. One small step after the other, so that the plan stays as small as the formulas."""
    a, f = KRASSOVSKY
    e2 = f * (2 - f)
    dx, dy, dz, rx, ry, rz, s = (F.get(chosen, F.lit(i)) for i in range(7))
    of = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    at = F.transform(ring, lambda p: of(sin=F.sin(F.radians(p["y"])), cos=F.cos(F.radians(p["y"])), lam=F.radians(p["x"])))
    at = F.transform(at, lambda p: of(sin=p["sin"], cos=p["cos"], lam=p["lam"], n=a / F.sqrt(1 - e2 * p["sin"] * p["sin"])))
    at = F.transform(at, lambda p: of(x=p["n"] * p["cos"] * F.cos(p["lam"]), y=p["n"] * p["cos"] * F.sin(p["lam"]), z=p["n"] * (1 - e2) * p["sin"]))
    at = F.transform(at, lambda p: of(u=dx + s * (p["x"] + rz * p["y"] - ry * p["z"]), v=dy + s * (-rz * p["x"] + p["y"] + rx * p["z"]), w=dz + s * (ry * p["x"] - rx * p["y"] + p["z"])))
    a, f = WGS84
    e2, b = f * (2 - f), a * (1 - f)
    at = F.transform(at, lambda p: of(lam=F.atan2(p["v"], p["u"]), w=p["w"], p=F.hypot(p["u"], p["v"])))
    at = F.transform(at, lambda p: of(lam=p["lam"], w=p["w"], p=p["p"], th=F.atan2(p["w"] * a, p["p"] * b)))
    back = lambda p: F.atan2(p["w"] + (a * a - b * b) / b * F.pow(F.sin(p["th"]), 3), p["p"] - e2 * a * F.pow(F.cos(p["th"]), 3))
    return F.when(chosen.isNotNull(), F.transform(at, lambda p: of(x=F.degrees(p["lam"]), y=F.degrees(back(p)))))


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area of a closed ring."""
    total = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda acc, i: acc + ring[i - 1]["x"] * ring[i]["y"] - ring[i]["x"] * ring[i - 1]["y"])
    return F.when(F.size(ring) >= 4, F.abs(total) / 2)


def winding(ring: Column, x: Column, y: Column) -> Column:
    """How often a closed ring goes round a point that is not on it: counter-clockwise less clockwise."""
    up = lambda a, b: (a["y"] <= y) & (b["y"] > y)
    left = lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
    turn = lambda a, b: F.when(up(a, b) & (left(a, b) > 0), 1).when(up(b, a) & (left(a, b) < 0), -1).otherwise(0)
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    return F.when(F.size(ring) > 1, F.aggregate(steps, F.lit(0), lambda n, i: n + turn(ring[i - 1], ring[i]))).otherwise(0)


def ring_sides(ring: Column) -> Column:
    """The sides of a closed ring, as an array of struct<x1, y1, x2, y2>."""
    side = lambda i: F.struct(ring[i]["x"].alias("x1"), ring[i]["y"].alias("y1"), ring[i + 1]["x"].alias("x2"), ring[i + 1]["y"].alias("y2"))
    return F.when(F.size(ring) > 1, F.transform(F.sequence(F.lit(0), F.size(ring) - 2), side)).otherwise(F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double>>"))


def side_meets_box(s: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a side has a point in a box, edges included: the span of it that is inside all four half-planes isn't empty."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    first, last, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for step, room in ((-dx, s["x1"] - west), (dx, east - s["x1"]), (-dy, s["y1"] - south), (dy, north - s["y1"])):
        at = F.try_divide(room, step)
        first, last = F.when(step < 0, F.greatest(first, at)).otherwise(first), F.when(step > 0, F.least(last, at)).otherwise(last)
        inside = inside & ((step != 0) | (room >= 0))
    return inside & (first <= last)


def meets_box(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether the area of a closed ring and a box share a point, edges included: a side comes into the box, or the ring goes round it."""
    return F.exists(ring_sides(ring), lambda s: side_meets_box(s, west, south, east, north)) | (F.pmod(winding(ring, west, south), F.lit(2)) == 1)


def sides_meet(s: Column, t: Column) -> Column:
    """Whether two sides share a point, ends included."""
    of = lambda a, x, y: (a["x2"] - a["x1"]) * (y - a["y1"]) - (a["y2"] - a["y1"]) * (x - a["x1"])
    across = lambda a, b: F.signum(of(a, b["x1"], b["y1"])) * F.signum(of(a, b["x2"], b["y2"])) <= 0
    apart = lambda p, q: (F.greatest(s[p], s[q]) < F.least(t[p], t[q])) | (F.greatest(t[p], t[q]) < F.least(s[p], s[q]))
    return across(s, t) & across(t, s) & ~apart("x1", "x2") & ~apart("y1", "y2")


def rings_meet(a: Column, b: Column) -> Column:
    """Whether the areas of two closed rings share a point, edges included: sides meet, or one goes round the other's first corner."""
    crossing = F.exists(ring_sides(a), lambda s: F.exists(ring_sides(b), lambda t: sides_meet(s, t)))
    around = lambda of, other: F.pmod(winding(of, F.get(other, F.lit(0))["x"], F.get(other, F.lit(0))["y"]), F.lit(2)) == 1
    return crossing | around(a, b) | around(b, a)


def geo_to_pixel(value: Column, low: Column, high: Column, size: Column) -> Column:
    """Linear position of a coordinate between two edges, rounded half to even."""
    return F.bround((value - low) / (high - low) * size).cast("int")


def grid_size(low: Column, high: Column, resolution: float) -> Column:
    return F.greatest(F.lit(1), F.bround((high - low) / resolution).cast("int"))


def pixel_centre(row: Column, col: Column, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """x and y of a pixel's centre on the affine's plane."""
    a, b, c, d, e, f = map(float, affine)
    return a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f


def area_units(m2: Column) -> tuple[Column, Column]:
    """Square kilometres and hectares."""
    return m2 / 1e6, m2 / 1e4


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def utm_series() -> tuple[float, tuple[float, ...]]:
    """Radius of the rectifying circle and the coefficients of the transverse projection, by the third flattening to its
    fourth power: good to micrometres within a zone."""
    a, f = WGS84
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    return radius, alpha


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres on a zone's transverse Mercator plane, WGS84; southern points get the false northing."""
    radius, alpha = utm_series()
    f = WGS84[1]
    e = math.sqrt(f * (2 - f))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    scale = UTM_SCALE * radius
    return UTM_EASTING + scale * x, F.when(lat < 0, UTM_SOUTH).otherwise(0.0) + scale * y


def on_zone(rows: DataFrame, points: dict[str, tuple[str, str]], zone: int, x: str, y: str) -> DataFrame:
    """Adds easting and northing of points {name: columns of longitude, latitude} as x and y with their names, as `utm` does it but without
    false origins: from one hemisphere to the other there is no jump. Steps are columns of their own, so that every number is worked out once for
    a row, however often the formulas name it."""
    radius, alpha = utm_series()
    f, c = WGS84[1], F.col
    e = math.sqrt(f * (2 - f))
    steps: dict[str, Column] = {}
    for k, (lon, lat) in points.items():
        steps |= {f"_s{k}": F.sin(F.radians(lat)), f"_l{k}": F.radians(c(lon) - (zone * 6 - 183))}
    rows, steps = rows.withColumns(steps), {}
    for k in points:
        steps |= {f"_t{k}": F.sinh(F.atanh(f"_s{k}") - e * F.atanh(e * c(f"_s{k}")))}
    rows, steps = rows.withColumns(steps), {}
    for k in points:
        t, lam = c(f"_t{k}"), c(f"_l{k}")
        steps |= {f"_xi{k}": F.atan2(t, F.cos(lam)), f"_eta{k}": F.atanh(F.sin(lam) / F.sqrt(1 + t * t))}
    rows, steps = rows.withColumns(steps), {}
    for k in points:
        xi, eta = c(f"_xi{k}"), c(f"_eta{k}")
        east, north = eta, xi
        for n, a in enumerate(alpha, 1):
            east = east + a * F.cos(2 * n * xi) * F.sinh(2 * n * eta)
            north = north + a * F.sin(2 * n * xi) * F.cosh(2 * n * eta)
        steps |= {f"{x}{k}": UTM_SCALE * radius * east, f"{y}{k}": UTM_SCALE * radius * north}
    return rows.withColumns(steps).drop(*[f"_{n}{k}" for n in ("s", "l", "t", "xi", "eta") for k in points])


def tile_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile that holds a point."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    inside = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    return inside(x), inside(y)


def _eccentricity() -> tuple[float, float]:
    a, f = WGS84
    return a, math.sqrt(f * (2 - f))


def polar(lon: Column, lat: Column, lon_0: float = -45.0, true_at: float = 70.0) -> tuple[Column, Column]:
    """Metres on the north polar stereographic plane, WGS84, true to scale at a latitude; lon_0 points down."""
    a, e = _eccentricity()
    at = math.radians(true_at)
    t_of = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    scale = a * math.cos(at) / math.sqrt(1 - (e * math.sin(at)) ** 2) / t_of(at)
    phi, lam = F.radians(lat), F.radians(lon - lon_0)
    s = e * F.sin(phi)
    rho = scale * F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    return rho * F.sin(lam), -rho * F.cos(lam)


def polar_to_lonlat(x: Column, y: Column, lon_0: float = -45.0, true_at: float = 70.0) -> tuple[Column, Column]:
    """Back from `polar`, good to well under a millimetre."""
    a, e = _eccentricity()
    at = math.radians(true_at)
    t_at = math.tan(math.pi / 4 - at / 2) / ((1 - e * math.sin(at)) / (1 + e * math.sin(at))) ** (e / 2)
    t = F.hypot(x, y) * (t_at / (a * math.cos(at) / math.sqrt(1 - (e * math.sin(at)) ** 2)))
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(5):  # each step is good to e^2 of the last
        s = e * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return F.pmod(F.degrees(F.atan2(x, -y)) + (lon_0 + 180), F.lit(360.0)) - 180, F.degrees(phi)


def _authalic(phi, sin, log):
    """q of Snyder's equal-area formulas; sin and log of columns or numbers."""
    _, e = _eccentricity()
    s = sin(phi)
    return (1 - e * e) * (s / (1 - e * e * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))


def equal_area(lon: Column, lat: Column, lon_0: Column, lat_0: Column) -> tuple[Column, Column]:
    """Metres on the azimuthal equal-area plane around a point, WGS84."""
    a, e = _eccentricity()
    q_pole = _authalic(math.pi / 2, math.sin, math.log)
    radius = a * math.sqrt(q_pole / 2)
    phi_0, lam = F.radians(lat_0), F.radians(lon - lon_0)
    beta, beta_0 = (F.asin(F.least(F.greatest(_authalic(F.radians(v), F.sin, F.ln) / q_pole, F.lit(-1.0)), F.lit(1.0))) for v in (lat, lat_0))
    d = a * F.cos(phi_0) / F.sqrt(1 - e * e * F.sin(phi_0) * F.sin(phi_0)) / (radius * F.cos(beta_0))
    b = radius * F.sqrt(2 / (1 + F.sin(beta_0) * F.sin(beta) + F.cos(beta_0) * F.cos(beta) * F.cos(lam)))
    return b * d * F.cos(beta) * F.sin(lam), b / d * (F.cos(beta_0) * F.sin(beta) - F.sin(beta_0) * F.cos(beta) * F.cos(lam))


def equal_area_to_lonlat(x: Column, y: Column, lon_0: float, lat_0: float) -> tuple[Column, Column]:
    """Back from `equal_area` around a given point."""
    a, e = _eccentricity()
    q_pole = _authalic(math.pi / 2, math.sin, math.log)
    radius, phi_0 = a * math.sqrt(q_pole / 2), math.radians(lat_0)
    beta_0 = math.asin(_authalic(phi_0, math.sin, math.log) / q_pole)
    d = a * math.cos(phi_0) / math.sqrt(1 - (e * math.sin(phi_0)) ** 2) / (radius * math.cos(beta_0))
    rho = F.hypot(x / d, y * d)
    c = 2 * F.asin(rho / (2 * radius))
    beta = F.when(rho > 0, F.asin(F.cos(c) * math.sin(beta_0) + d * y * F.sin(c) * math.cos(beta_0) / rho)).otherwise(beta_0)
    lon = F.atan2(x * F.sin(c), d * rho * math.cos(beta_0) * F.cos(c) - d * d * y * math.sin(beta_0) * F.sin(c))
    q, phi = q_pole * F.sin(beta), beta
    for _ in range(4):
        s = F.sin(phi)
        w = 1 - e * e * s * s
        phi = phi + w * w / (2 * F.cos(phi)) * (q / (1 - e * e) - s / w + F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    return F.when(rho > 0, lon_0 + F.degrees(lon)).otherwise(lon_0), F.degrees(phi)


def densified_box(west: Column, south: Column, east: Column, north: Column, plane, points: int = 21) -> Column:
    """Struct x0, y0, x1, y1: least and largest x and y, on a plane (lon, lat -> x, y), of a box's edges with so many points put on each
    between its corners. Every point is put on the plane once; take the fields in a later select, or all of it is done for each."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(points + 1)), lambda k: k / (points + 1))
    at = lambda lo, hi, t: lo + (hi - lo) * t
    point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    along = lambda lat: F.transform(steps, lambda t: point(at(west, east, t), lat + 0 * t))
    up = lambda lon: F.transform(steps, lambda t: point(lon + 0 * t, at(south, north, t)))

    def placed(p: Column) -> Column:
        x, y = plane(p["lon"], p["lat"])
        return F.struct(x.alias("x"), y.alias("y"))

    on_plane = F.transform(F.concat(along(south), along(north), up(west), up(east)), placed)
    ends = (("x0", F.least, "x"), ("y0", F.least, "y"), ("x1", F.greatest, "x"), ("y1", F.greatest, "y"))
    none = F.struct(*[F.lit(None).cast("double").alias(n) for n, _, _ in ends])
    return F.aggregate(on_plane, none, lambda m, p: F.struct(*[f(m[n], p[v]).alias(n) for n, f, v in ends]))


def densified_bounds(west: Column, south: Column, east: Column, north: Column, plane, points: int = 21) -> tuple[Column, Column, Column, Column]:
    """The four numbers of `densified_box`."""
    box = densified_box(west, south, east, north, plane, points)
    return box["x0"], box["y0"], box["x1"], box["y1"]
