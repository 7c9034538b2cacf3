"""Where: state, city or circle, for one query or as join keys for many."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.shared import materialize
from .skew import spread_join


def in_state(business: DataFrame, state: str) -> DataFrame:
    return business.filter(F.col("state") == state)


def in_city(business: DataFrame, city: str) -> DataFrame:
    return business.filter(F.col("city") == city)


def distance_to(lat: float, lon: float) -> Column:
    return geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(float(lat)), F.lit(float(lon)))


def in_radius(business: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """At most `radius_km` away. The constant box reaches the scan, the distance decides."""
    box = geo.in_box(F.col("latitude"), F.col("longitude"), lat, lon, radius_km)
    return business.filter(box & (distance_to(lat, lon) <= float(radius_km)))


#: For each mode what a locality has to hold and the filter it stands for.
_MODES = {
    "state": ((str,), in_state),
    "city": ((str,), in_city),
    "radial": ((tuple, (int, float)), lambda df, point, km: in_radius(df, *point, km)),
}


def in_locality(business: DataFrame, locality: tuple) -> DataFrame:
    """Filter by `('state', s)`, `('city', c)` or `('radial', (lat, lon), km)`; mode in any case."""
    mode, values = str(locality[0]).lower() if locality else "", tuple(locality[1:])
    if mode not in _MODES:
        raise ValueError(f"a locality is one of {', '.join(_MODES)}, not {mode!r}")
    kinds, apply = _MODES[mode]
    if len(values) != len(kinds) or not all(map(isinstance, values, kinds)):
        raise ValueError(f"a {mode} locality does not look like {values!r}")
    return apply(business, *values)


_PLACES = {"kind": "string", "place": "string", "inside": "boolean"}


def _places(batches, depth):
    for batch in batches:
        mode = pc.utf8_lower(batch.column("locality_mode")).to_pylist()
        lat, lon, radius = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("latitude", "longitude", "radius_km"))
        round_ = np.array([m == "radial" for m in mode]) & ~(np.isnan(lat) | np.isnan(lon) | np.isnan(radius))
        where = np.flatnonzero(round_)
        circle, level, row, col, inside = geo.circle_cover(lat[where], lon[where], radius[where], depth)
        kinds = [f"cell{n}" for n in level.tolist()]
        rows = where[circle].tolist()
        places = [f"{k}:{r}:{c}" for k, r, c in zip(kinds, row.tolist(), col.tolist())]
        flags = inside.tolist()
        for i, (m, state, city) in enumerate(zip(mode, batch.column("state").to_pylist(), batch.column("city").to_pylist())):
            name = {"state": state, "city": city}.get(m)
            if name is not None:
                rows.append(i)
                kinds.append(m)
                places.append(f"{m}:{name}")
                flags.append(True)
        taken = batch.take(pa.array(rows, pa.int64()))
        added = [pa.array(kinds, pa.string()), pa.array(places, pa.string()), pa.array(flags, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*taken.columns, *added], names=[*batch.schema.names, *_PLACES])


def place_rows(queries: DataFrame, depth: int = geo.COVER_DEPTH) -> DataFrame:
    """Queries with a row for each of their places: its `kind`, its name `place`, and whether it lies whole `inside`
    the query's locality. A state or city is one place, a circle is covered by cells of several sizes, those on its border cut `depth` times."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema]
    return queries.mapInArrow(lambda batches: _places(batches, depth), ", ".join([*fields, *[f"{n} {t}" for n, t in _PLACES.items()]]))


def business_places(business: DataFrame, queried: DataFrame) -> DataFrame:
    """One row per business and place key, only of the kinds that some query uses. There are no more
    kinds than state, city and the cell sizes, which bounds the broadcast."""
    known = ["state", "city", *[f"cell{level}" for level in range(len(geo.CELL_EDGES))]]
    kinds = F.broadcast(queried.select("kind").where(F.col("kind").isin(known)).distinct())
    keys = F.concat(
        F.array(
            F.struct(F.lit("state").alias("kind"), F.concat(F.lit("state:"), F.col("state")).alias("place")),
            F.struct(F.lit("city").alias("kind"), F.concat(F.lit("city:"), F.col("city")).alias("place")),
        ),
        geo.point_cells(F.col("latitude"), F.col("longitude")),
    )
    return business.select("*", F.inline(keys)).join(kinds, "kind", "left_semi")


def query_area() -> Column:
    """The area of a query's locality: its state, its city, or where the middle of its circle lies."""
    mode = F.lower("locality_mode")
    return (
        F.when(mode == "state", F.concat(F.lit("state:"), F.col("state")))
        .when(mode == "city", F.concat(F.lit("city:"), F.col("city")))
        .when(mode == "radial", geo.circle_area(F.col("latitude"), F.col("longitude"), F.col("radius_km")))
    )


def area_rows(business: DataFrame, asked: DataFrame) -> DataFrame:
    """A row of `business` for each area among those `asked` (column `area`) that may look at it: its state, its city, and on each
    level of circles in use about four areas. So rows grow with the businesses, not with who asks."""
    wanted = asked.select("area").where("area is not null").distinct()
    # No more than the kinds of areas there are.
    kinds = {r[0] for r in wanted.select(F.substring_index("area", ":", 1)).distinct().collect()}
    names = [F.array(F.concat(F.lit(f"{k}:"), F.col(k))) for k in ("state", "city") if k in kinds]
    names += [geo.point_areas(F.col("latitude"), F.col("longitude"), level) for level in range(len(geo.AREA_EDGES)) if f"area{level}" in kinds]
    every = F.array_distinct(F.concat(F.array().cast("array<string>"), *names))
    return business.withColumn("area", F.explode(every)).join(wanted, "area", "left_semi")


def within_query_circle(latitude: str = "latitude", longitude: str = "longitude",
                        query_latitude: str = "query_latitude", query_longitude: str = "query_longitude") -> Column:
    """The exact test behind the cells, for those that are not inside as a whole; always true outside radial mode."""
    distance = geo.haversine(F.col(latitude), F.col(longitude), F.col(query_latitude), F.col(query_longitude))
    return F.col("inside") | (distance <= F.col("radius_km"))


# Each pair is read for its distance, so fewer pairs outside a circle are worth more cells than in a search by category.
# A circle has some fifty then, so few bytes of circles are much work.
JOIN_DEPTH, CIRCLES_PER_TASK = 3, 4096


def radial_join(queries: DataFrame, business: DataFrame, per_task: int | None = None) -> DataFrame:
    """(query_id, business_id, distance_km) for every business inside a query's circle."""
    asked = queries.filter(F.lower("locality_mode") == "radial").select(
        "query_id", "locality_mode", "state", "city", "latitude", "longitude", "radius_km")
    dealt = asked.repartition(-(-asked.count() // CIRCLES_PER_TASK) or 1)
    # Read for the kinds, the counts and the join; stored, circles are covered once.
    circles = materialize(place_rows(dealt, JOIN_DEPTH).select(
        "query_id", "kind", "place", "inside", "radius_km", F.col("latitude").alias("query_latitude"),
        F.col("longitude").alias("query_longitude"), F.cos(F.radians("latitude")).alias("query_cos")), "circles")
    points = business_places(business.select("business_id", "state", "city", "latitude", "longitude"), circles).select(
        "place", "business_id", "latitude", "longitude", F.cos(F.radians("latitude")).alias("cos"))
    between = (F.col("query_latitude") - F.col("latitude"), F.col("query_longitude") - F.col("longitude"), F.col("cos"), F.col("query_cos"))
    return (
        spread_join(points, circles.drop("kind"), ["place"], ["business_id"], ["query_id"], per_task=per_task)
        .filter(F.col("inside") | geo.haversine_within(*between, F.col("radius_km")))
        .select("query_id", "business_id", geo.haversine_of(*between).alias("distance_km"))
    )
