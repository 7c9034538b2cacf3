"""Distances on the globe, and the grid cells that turn a radius search into an equi-join."""

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_KM

# Cell edges in degrees. A cover begins with the smallest edge that is at least a circle's half-width, so its
# box meets at most 3 x 3 cells, whatever its radius.
CELL_EDGES = [0.0125 * 2**level for level in range(15)]
# Edges in degrees of the areas that businesses are dealt out to: an area holds the circles around its points whose box is
# at most an edge wide, with half an edge around it. The last one is wider than the globe on either side.
AREA_EDGES = [0.0125 * 2 ** (level / 2) for level in range(31)]
_KM_PER_DEGREE = EARTH_KM * math.pi / 180
_SLACK = 1.001
# How much wider bounds are than what they have to hold, against rounding.
_SURE = 1 + 1e-9
# How often a cell on a circle's border is cut, and by how much a distance may be off, in km.
COVER_DEPTH, _MARGIN_KM = 2, 0.001


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    return haversine_of(lat2 - lat1, lon2 - lon1, F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))


def haversine_of(north: Column, east: Column, cos1: Column, cos2: Column) -> Column:
    """`haversine` from the differences in degrees and the cosines of both latitudes."""
    half_lat, half_lon = F.radians(north) / 2, F.radians(east) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + cos1 * cos2 * (F.sin(half_lon) * F.sin(half_lon))
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * 2 * EARTH_KM


def haversine_within(north: Column, east: Column, cos1: Column, cos2: Column, radius_km: Column) -> Column:
    """`haversine_of` <= radius (no NULL among them), worked out only for points near the border. As x^2 (1 - x^2 / 3) <= sin(x)^2 <= x^2, most
    are told by squares: inside if the upper bound is below the radius' lower one, outside if the lower is above its upper one."""
    lat2, lon2 = (F.radians(d) / 2 * (F.radians(d) / 2) for d in (north, east))
    reach2 = radius_km / (2 * EARTH_KM) * (radius_km / (2 * EARTH_KM))
    both = cos1 * cos2
    # Only a latitude beyond a pole makes it negative, and the bounds wrong.
    inside = (both >= 0) & ((lat2 + both * lon2) * _SURE <= reach2 * (1 - reach2 / 3))
    least = lat2 * (1 - lat2 / 3) + both * (lon2 * (1 - lon2 / 3))
    # Nothing is above 1 but NaN, which the formula takes for the far side of the globe.
    outside = (both >= 0) & (least > reach2 * _SURE) & (least < 2.0)
    return (radius_km >= 0) & ~outside & (inside | (haversine_of(north, east, cos1, cos2) <= radius_km))


def round_km(km: Column, places: int) -> Column:
    """`round` of a distance. Its way over decimals is taken only near a tie, as it costs more than the distance; elsewhere the nearest
    whole number of steps is the same, and dividing it gives the double next to the decimal, as there."""
    steps = km * float(10**places)
    plain = (km >= 0) & (steps < float(1 << 40)) & (F.abs(steps - F.rint(steps)) < 0.499)
    return F.when(plain, F.rint(steps) / float(10**places)).otherwise(F.round(km, places))


def box_half_widths(lat: Column, radius_km: Column) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that safely hold the circle. A circle that reaches a pole
    spans all longitudes."""
    dlat = radius_km / _KM_PER_DEGREE * _SLACK + 1e-6
    reaches_pole = F.abs(lat) + dlat >= 89.99
    ratio = F.sin(F.radians(F.least(dlat, F.lit(90.0)))) / F.cos(F.radians(F.when(reaches_pole, 0.0).otherwise(lat)))
    wide = reaches_pole | (ratio >= 1.0)
    dlon = F.when(wide, 180.0).otherwise(
        F.degrees(F.asin(F.when(wide, 0.0).otherwise(ratio))) * _SLACK + 1e-6
    )
    return dlat, dlon


def in_box(lat: Column, lon: Column, center_lat: float, center_lon: float, radius_km: float) -> Column:
    """Constant bounds around a circle, for pushdown into the scan."""
    dlat = radius_km / _KM_PER_DEGREE * _SLACK + 1e-6
    inside = lat.between(float(center_lat - dlat), float(center_lat + dlat))
    if abs(center_lat) + dlat >= 89.99:
        return inside
    ratio = math.sin(math.radians(dlat)) / math.cos(math.radians(center_lat))
    if ratio >= 1:
        return inside
    dlon = math.degrees(math.asin(ratio)) * _SLACK + 1e-6
    west, east = center_lon - dlon, center_lon + dlon
    spans = lon.between(float(west), float(east))
    if west < -180:
        spans = spans | (lon >= float(west + 360))
    if east > 180:
        spans = spans | (lon <= float(east - 360))
    return inside & spans


def area_level(lat: Column, radius_km: Column) -> Column:
    """The level of the areas for a circle: the smallest whose edge is at least the width of the circle's box."""
    half = F.least(F.greatest(*box_half_widths(lat, radius_km)), F.lit(180.0))
    level = F.ceil(F.log2(half * 2 / AREA_EDGES[0]) * 2)
    return F.least(F.greatest(level, F.lit(0)), F.lit(len(AREA_EDGES) - 1)).cast("int")


def area_name(level: Column, row: Column, column: Column) -> Column:
    return F.concat_ws(":", F.concat(F.lit("area"), level.cast("string")), row.cast("string"), column.cast("string"))


def circle_area(lat: Column, lon: Column, radius_km: Column) -> Column:
    """The area that a circle's middle lies in."""
    level = area_level(lat, radius_km)
    edge = F.get(F.array(*[F.lit(e) for e in AREA_EDGES]), level)
    return area_name(level, F.floor(lat / edge), F.floor(lon / edge))


def point_areas(lat: Column, lon: Column, level: int) -> Column:
    """The areas of a level whose circles may hold a point: those at most half an edge away (date line included)."""
    edge = AREA_EDGES[level]
    half = edge / 2 + 1e-6

    def along(x: Column) -> Column:
        return F.sequence(F.floor((x - half) / edge), F.floor((x + half) / edge))

    wests = F.concat(
        along(lon), F.when(lon < half - 180.0, along(lon + 360.0)).otherwise(F.array().cast("array<bigint>")),
        F.when(lon > 180.0 - half, along(lon - 360.0)).otherwise(F.array().cast("array<bigint>")))
    names = F.flatten(F.transform(along(lat), lambda r: F.transform(
        F.array_distinct(wests), lambda c: area_name(F.lit(level), r, c))))
    return F.coalesce(names, F.array().cast("array<string>"))


def in_band(lat: Column, center_lat: Column, radius_km: Column) -> Column:
    """Whether a latitude is near enough for a circle; one subtraction."""
    return F.abs(lat - center_lat) <= radius_km * (_SLACK / _KM_PER_DEGREE) + 1e-6


def in_widths(north: Column, east: Column, dlat: Column, dlon: Column) -> Column:
    """Whether differences in latitude and longitude lie in a circle's box, also across the date line."""
    return (F.abs(north) <= dlat) & (F.least(F.abs(east), F.lit(360.0) - F.abs(east)) <= dlon)


def cell_name(level: Column, row: Column, column: Column) -> Column:
    return F.concat_ws(":", F.concat(F.lit("cell"), level.cast("string")), row.cast("string"), column.cast("string"))


def point_cells(lat: Column, lon: Column) -> Column:
    """The cell of a point on every level, as array<struct<kind,place>>."""
    return F.array(*[
        F.struct(
            F.lit(f"cell{level}").alias("kind"),
            cell_name(F.lit(level), F.floor(lat / edge), F.floor(lon / edge)).alias("place"),
        )
        for level, edge in enumerate(CELL_EDGES)
    ])


def _spread_bits(x: Column) -> Column:
    """The low 24 bits of a number with a gap behind each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def curve_position(lat: Column, lon: Column) -> Column:
    """The place of a point on a space-filling curve over the globe (bits of latitude and longitude in turn): points that are
    near on the curve are near on the globe. NULL without coordinates."""
    rows, columns = (F.floor((x + half) / (2 * half) * ((1 << 24) - 1)).cast("bigint") for x, half in ((lat, 90.0), (lon, 180.0)))
    return F.shiftleft(_spread_bits(rows), 1).bitwiseOR(_spread_bits(columns))


def circle_level(lat: Column, radius_km: Column) -> Column:
    """The grid level of a circle. The cells of any level would do; this one keeps them few."""
    dlat, dlon = box_half_widths(lat, radius_km)
    level = F.ceil(F.log2(F.greatest(dlat, dlon) / CELL_EDGES[0]))
    return F.least(F.greatest(level, F.lit(0)), F.lit(len(CELL_EDGES) - 1)).cast("int")


def circle_cells(lat: Column, lon: Column, radius_km: Column, level: Column) -> Column:
    """The names of the cells of a level that the box of a circle meets (date line included)."""
    dlat, dlon = box_half_widths(lat, radius_km)
    edge = F.get(F.array(*[F.lit(e) for e in CELL_EDGES]), level)
    # A box over the date line goes on at the other side: the same longitudes 360 degrees away.
    shifted = F.transform(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)), lambda s: F.struct(
        F.greatest(lon - dlon + s, F.lit(-180.0)).alias("west"), F.least(lon + dlon + s, F.lit(180.0)).alias("east")))
    spans = F.transform(
        F.filter(shifted, lambda s: s["west"] <= s["east"]),
        lambda s: F.sequence(F.floor(s["west"] / edge), F.floor(s["east"] / edge)))
    rows = F.sequence(
        F.floor(F.greatest(lat - dlat, F.lit(-90.0)) / edge), F.floor(F.least(lat + dlat, F.lit(90.0)) / edge))
    return F.flatten(F.transform(
        rows, lambda r: F.transform(F.array_distinct(F.flatten(spans)), lambda c: cell_name(level, r, c))))


def _distance(lat1, lat2, dlon):
    """`haversine` of arrays, with the difference in longitude."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(dlon) / 2) ** 2
    return np.arcsin(np.sqrt(np.minimum(a, 1.0))) * 2 * EARTH_KM


def circle_rows(lat: np.ndarray, lon: np.ndarray, rows: np.ndarray, at_lat: float, at_lon: float, radius_km: float) -> np.ndarray:
    """Of `rows`, ascending places in points sorted by latitude, those in a circle."""
    dlat = radius_km / _KM_PER_DEGREE * _SLACK + 1e-6
    first, last = np.searchsorted(lat, at_lat - dlat, "left"), np.searchsorted(lat, at_lat + dlat, "right")
    rows = rows[np.searchsorted(rows, first):np.searchsorted(rows, last)]
    if abs(at_lat) + dlat < 89.99:
        ratio = math.sin(math.radians(dlat)) / math.cos(math.radians(at_lat))
        if ratio < 1:
            east = np.abs(lon[rows] - at_lon)
            rows = rows[np.minimum(east, np.abs(360.0 - east)) <= math.degrees(math.asin(ratio)) * _SLACK + 1e-6]
    return rows[_distance(lat[rows], at_lat, at_lon - lon[rows]) <= radius_km]


def _cell_distances(level, row, col, lat, lon):
    """The least and the greatest distance in km from points to cells.

    On a parallel the distance grows with the difference in longitude. Along a meridian it has one minimum and grows on
    both sides, so the greatest distance is at a corner, the least one at that minimum or at the end next to it."""
    edge = np.array(CELL_EDGES)[level]
    south, north = np.maximum(row * edge, -90.0), np.minimum((row + 1) * edge, 90.0)
    west = (col * edge - lon + 180.0) % 360.0 - 180.0
    east = west + edge
    spans = (west <= 0) & (east >= 0) | (east >= 360.0)
    near = np.where(spans, 0.0, np.minimum(np.minimum(np.abs(west), np.abs(east)), np.abs(east - 360.0)))
    far = np.where(east >= 180.0, 180.0, np.maximum(np.abs(west), np.abs(east)))
    lowest = np.degrees(np.arctan2(np.sin(np.radians(lat)), np.cos(np.radians(lat)) * np.cos(np.radians(near))))
    least = _distance(lat, np.clip(lowest, south, north), near)
    return least, np.maximum(_distance(lat, south, far), _distance(lat, north, far))


def _ranges(first, last):
    """For each pair of bounds the numbers from one to the other, and whose they are."""
    many = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(many)), many)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]


def circle_cover(lat: np.ndarray, lon: np.ndarray, radius_km: np.ndarray, depth: int = COVER_DEPTH):
    """(circle, level, row, col, inside) of the cells that cover circles: cells that lie whole in the circle, and others
    that its border may cross, up to `depth` levels smaller than the ones that the circle's box begins with."""
    # As `box_half_widths`.
    dlat = radius_km / _KM_PER_DEGREE * _SLACK + 1e-6
    pole = np.abs(lat) + dlat >= 89.99
    ratio = np.sin(np.radians(np.minimum(dlat, 90.0))) / np.cos(np.radians(np.where(pole, 0.0, lat)))
    wide = pole | (ratio >= 1.0)
    dlon = np.where(wide, 180.0, np.degrees(np.arcsin(np.where(wide, 0.0, ratio))) * _SLACK + 1e-6)
    level = np.clip(np.ceil(np.log2(np.maximum(dlat, dlon) / CELL_EDGES[0])), 0, len(CELL_EDGES) - 1).astype(np.int64)
    edge = np.array(CELL_EDGES)[level]
    whole = lambda x: np.floor(x / edge).astype(np.int64)
    circle, row = _ranges(whole(np.maximum(lat - dlat, -90.0)), whole(np.minimum(lat + dlat, 90.0)))
    found = []
    # A box over the date line goes on at the other side: the same longitudes 360 degrees away.
    for shift in (0.0, 360.0, -360.0):
        west, east = np.maximum(lon - dlon + shift, -180.0), np.minimum(lon + dlon + shift, 180.0)
        own, col = _ranges(whole(west)[circle], np.where(west <= east, whole(east), whole(west) - 1)[circle])
        found.append(np.stack([circle[own], level[circle[own]], row[own], col]))
    cells = np.unique(np.concatenate(found, axis=1), axis=1)
    for d in range(depth + 1):
        at = cells[0]
        least, greatest = _cell_distances(*cells[1:], lat[at], lon[at])
        meets, inside = least <= radius_km[at] + _MARGIN_KM, greatest <= radius_km[at] - _MARGIN_KM
        if d > COVER_DEPTH:
            # Latitudes beyond a pole are no part of a cell's distances; at any depth points there are tested as at this one.
            size = np.array(CELL_EDGES)[cells[1]]
            beyond = (cells[2] * size < -90.0) | ((cells[2] + 1) * size > 90.0)
            meets, inside = meets | beyond, inside & ~beyond
        cells, inside = cells[:, meets], inside[meets]
        if d < depth:
            split = ~inside & (cells[1] > 0)
            c = cells[:, split]
            parts = [np.stack([c[0], c[1] - 1, 2 * c[2] + i, 2 * c[3] + j]) for i in (0, 1) for j in (0, 1)]
            cells = np.concatenate([cells[:, ~split], *parts], axis=1)
    return (*cells, inside)
