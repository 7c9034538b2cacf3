"""Requests to queries: defaults, checks, keys that let queries share work."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EARTH_KM, HOME_LATITUDE, HOME_LONGITUDE, MAX_RESULTS, MAX_SCOPE, REQUEST_DEFAULTS
from ..functions.text import day_index

_FIELDS = [
    "locality_mode", "state", "city", "latitude", "longitude", "radius", "categories", "scope", "day",
    "time_minutes", "n", "currently_open", "recommend_reviewed", "trip_duration", "detail",
]
_BODY = T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS])


def _tokens(raw: Column) -> Column:
    """Category names from a JSON list or a comma-separated text: trimmed, empty ones left out."""
    listed = F.from_json(F.when(F.startswith(F.ltrim(raw), F.lit("[")), raw), "array<string>")
    names = F.coalesce(listed, F.split(raw, ","))
    return F.filter(F.transform(names, lambda c: F.trim(c)), lambda c: c != "")


def normalize_requests(requests: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """Request bodies (query_id, user_id, body as JSON text) to rows of the query table. A missing
    field gets its default; a field that cannot be read as its type stays NULL for `reject_reason`. A missing point
    is the user's own home, if `homes` (user_id, latitude, longitude; see `home_locations`) has one, else the default home.
    Flags are false for false, 0, 0.0 and an empty text in any case, as JSON or as text, and true for anything else."""
    parsed = requests.withColumn("r", F.from_json("body", _BODY))
    home = [F.lit(HOME_LATITUDE), F.lit(HOME_LONGITUDE)]
    if homes is not None:
        once = homes.groupBy("user_id").agg(F.max(F.struct("latitude", "longitude")).alias("home"))
        parsed = parsed.join(once, "user_id", "left")
        home = [F.coalesce(F.col("home.latitude"), home[0]), F.coalesce(F.col("home.longitude"), home[1])]

    def given(field: str) -> Column:
        return F.col(f"r.{field}")

    def text(field: str) -> Column:
        return F.coalesce(given(field), F.lit(REQUEST_DEFAULTS[field]))

    def number(field: str, default: float | Column, kind: str = "double") -> Column:
        value = F.when(given(field).isNull(), default if isinstance(default, Column) else F.lit(float(default))).otherwise(given(field).try_cast("double"))
        # A whole number is asked for: 2.7 is none and stays NULL.
        return value if kind == "double" else F.when(value == F.floor(value), value.try_cast(kind))

    def flag(field: str) -> Column:
        value = F.lower(given(field))
        return F.when(value.isNull(), F.lit(REQUEST_DEFAULTS[field])).otherwise(
            ~value.isin("false", "0", "0.0", ""))

    mode = text("locality_mode")
    radial = mode == "radial"
    return parsed.select(
        "query_id", "user_id", mode.alias("locality_mode"),
        F.when(mode == "state", text("state")).alias("state"),
        F.when(mode == "city", text("city")).alias("city"),
        F.when(radial, number("latitude", home[0])).alias("latitude"),
        F.when(radial, number("longitude", home[1])).alias("longitude"),
        F.when(radial, number("radius", REQUEST_DEFAULTS["radius"])).alias("radius_km"),
        _tokens(text("categories")).alias("categories"),
        number("scope", REQUEST_DEFAULTS["scope"], "int").alias("scope"),
        text("day").alias("day"),
        number("time_minutes", REQUEST_DEFAULTS["time_minutes"], "int").alias("time_minutes"),
        number("n", REQUEST_DEFAULTS["n"], "int").alias("n"),
        flag("currently_open").alias("currently_open"),
        flag("recommend_reviewed").alias("recommend_reviewed"),
        flag("trip_duration").alias("trip_duration"),
        flag("detail").alias("detail"),
    )


def reject_reason() -> Column:
    """Why a query cannot be answered; NULL for a good one. The first thing wrong is reported."""
    mode = F.lower("locality_mode")
    return (
        F.when(mode.isNull() | ~mode.isin("state", "city", "radial"), "unknown locality mode")
        .when((mode == "state") & F.col("state").isNull(), "invalid locality")
        .when((mode == "city") & F.col("city").isNull(), "invalid locality")
        .when((mode == "radial") & (F.col("latitude").isNull() | F.col("longitude").isNull()), "invalid point")
        .when((mode == "radial") & ~(F.abs("latitude") <= 90) | (mode == "radial") & ~(F.abs("longitude") <= 180), "invalid point")
        .when((mode == "radial") & F.col("radius_km").isNull(), "missing radius")
        .when((mode == "radial") & ~F.col("radius_km").between(0.0, EARTH_KM * 3.2), "invalid radius")
        .when(F.coalesce(F.size("categories"), F.lit(0)) == 0, "no categories")
        .when(F.col("scope").isNull() | F.col("n").isNull(), "invalid number")
        .when(~F.col("scope").between(0, MAX_SCOPE), "scope out of range")
        .when(~F.col("n").between(1, MAX_RESULTS), "number of results out of range")
        .when(~F.coalesce("time_minutes", F.lit(0)).between(0, 24 * 60 - 1), "time out of range")
        .when(F.col("currently_open") & (day_index(F.col("day")).isNull() | F.col("time_minutes").isNull()),
              "invalid day or time")
    )


def split_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good queries, rejected queries with a reason)."""
    checked = queries.withColumn("reason", reject_reason())
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def base_key() -> Column:
    """Queries with this key in common differ only in day, time, size and flags: user, categories in
    any order, scope and locality are the same."""
    return _digest(F.col("user_id"), F.array_sort("categories").alias("categories"), F.col("scope"), *_locality())


def _locality() -> list[Column]:
    return [F.lower("locality_mode").alias("mode"), *map(F.col, ("state", "city", "latitude", "longitude", "radius_km"))]


def _digest(*fields: Column) -> Column:
    """A hash of the fields as JSON, which keeps NULL, empty and joined texts apart."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def terms_key() -> Column:
    return _digest(F.col("terms"))


def pool_id() -> Column:
    """Queries with this key in common look at the same businesses: matched terms and locality are the same."""
    return _digest(F.col("terms"), *_locality())
