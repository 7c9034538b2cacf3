"""Raw JSON tables to typed tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DAYS, ORDINALS, PRICE, RAW_ATTRIBUTES, TRISTATES
from ..functions import attributes, hours, text
from ..operators.expansion import document_vectors
from ..operators.columns import cast_columns, columns_matching, narrow_bigints, narrow_floats, promote_fields, row_sum
from ..sources.readers import read_json_or_reject


def clean_tip(tip: DataFrame) -> DataFrame:
    return cast_columns(tip, date="timestamp", compliment_count="int")


def clean_checkin(checkin: DataFrame) -> DataFrame:
    return checkin.select("business_id", text.split_timestamps(F.col("date")).alias("dates"))


def clean_user(user: DataFrame) -> DataFrame:
    """Compliments become one sum; `compliment_cool` is left out as the twin of `compliment_funny`."""
    user = user.drop("compliment_cool")
    parts = columns_matching(user, "compliment_")
    user = user.withColumn("compliments", row_sum(parts).try_cast("int")).drop(*parts)
    user = cast_columns(user, yelping_since="timestamp", average_stars="float")
    return narrow_bigints(user).withColumn("friends", text.split_list(F.col("friends")))


def clean_review(review: DataFrame) -> DataFrame:
    return narrow_bigints(cast_columns(review, date="timestamp", stars="float"))


def with_category_vectors(business: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """Clean businesses with `categories_vec`, the mean of their categories' vectors (zeros where none is known)."""
    found = document_vectors(business, "business_id", "categories", word_vectors)
    return business.join(found.withColumnRenamed("vector", "categories_vec"), "business_id", "left")


def clean_business(business: DataFrame) -> DataFrame:
    """Typed scalars, numeric attributes, category list, quality and minutes of opening hours.
    Businesses without categories are left out."""
    business = business.filter(F.col("categories").isNotNull())
    business = narrow_floats(business, ["latitude", "longitude", "stars"])
    business = cast_columns(business, review_count="int", is_open="boolean")
    business = promote_fields(business, "attributes", RAW_ATTRIBUTES)
    encoded = {c: attributes.tristate(F.col(c)) for c in TRISTATES}
    encoded |= {c: attributes.ordinal_attribute(c, F.col(c)) for c in ORDINALS}
    encoded[PRICE] = F.col(PRICE).try_cast("tinyint")
    flags = attributes.ambience_flags(F.col("Ambience"))
    kept = [encoded.get(c, F.col(c)).alias(c) for c in business.columns if c not in ("Ambience", "hours", "categories")]
    minutes = []
    for day in DAYS:
        opens, closes = hours.day_columns(day)
        minutes += [
            hours.open_minutes(F.col(f"hours.{day}")).alias(opens),
            hours.close_minutes(F.col(f"hours.{day}")).alias(closes),
        ]
    return business.select(
        *kept, text.split_list(F.col("categories")).alias("categories"), *flags,
        attributes.quality(F.col("review_count"), F.col("stars")).alias("quality"), *minutes,
    )


def clean_file(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(clean table, rejected lines) of a raw JSON file of one `kind`: tip, checkin, user, review or business."""
    plans = {"tip": clean_tip, "checkin": clean_checkin, "user": clean_user, "review": clean_review, "business": clean_business}
    rows, rejects = read_json_or_reject(spark, path, schemas.RAW[kind])
    return plans[kind](rows), rejects
