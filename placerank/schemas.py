"""Explicit schemas of the raw JSON tables and of the query table (no inference pass)."""

from pyspark.sql import types as T

from .config import COMPLIMENTS, DAYS, RAW_ATTRIBUTES

CORRUPT = "_corrupt_record"


def _struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _D, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

TIP = _struct(user_id=_S, business_id=_S, text=_S, date=_S, compliment_count=_L)

CHECKIN = _struct(business_id=_S, date=_S)

USER = _struct(
    user_id=_S, name=_S, review_count=_L, yelping_since=_S, useful=_L, funny=_L, cool=_L,
    elite=_S, friends=_S, fans=_L, average_stars=_D,
    **{f"compliment_{c}": _L for c in COMPLIMENTS},
)

# A profile is a user row that may also hold the home location.
PROFILE = T.StructType(USER.fields + _struct(latitude=_D, longitude=_D).fields)

REVIEW = _struct(
    review_id=_S, user_id=_S, business_id=_S, stars=_D, useful=_L, funny=_L, cool=_L, text=_S, date=_S,
)

BUSINESS = _struct(
    business_id=_S, name=_S, address=_S, city=_S, state=_S, latitude=_D, longitude=_D, stars=_D,
    review_count=_L, is_open=_L, categories=_S,
    attributes=_struct(**{a: _S for a in RAW_ATTRIBUTES}),
    hours=_struct(**{d: _S for d in DAYS}),
)

QUERIES = _struct(
    query_id=_S, user_id=_S, locality_mode=_S, state=_S, city=_S, latitude=_D, longitude=_D,
    radius_km=_D, categories=T.ArrayType(_S), scope=_I, day=_S, time_minutes=_I, n=_I,
    currently_open=_B, recommend_reviewed=_B, trip_duration=_B, detail=_B,
)

RAW = {"tip": TIP, "checkin": CHECKIN, "user": USER, "review": REVIEW, "business": BUSINESS}
