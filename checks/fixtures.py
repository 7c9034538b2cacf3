"""Domain views derived from the given tables; `checks/oracle.py` holds the same rules as SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank import schemas
from placerank.config import AMBIENCES, COMPLIMENTS, DAYS, TRISTATES
from placerank.operators.expansion import category_vocabulary
from placerank.plans import clean_business, clean_review, clean_user

HOME = (27.948, -82.46)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(index: str, labels: list) -> F.col:
    chosen = F.lit(None).cast("string")
    for i, label in enumerate(labels):
        if label is not None:
            chosen = F.when(F.expr(index) == i, label).otherwise(chosen)
    return chosen


def _ambience():
    mark = F.when(F.expr("k % 2 = 0"), "u").otherwise("")
    entries = [
        F.concat(mark, F.lit(f"'{a}': "), F.when(F.expr(f"(k div {i + 3}) % 3 = 0"), "True").otherwise("False"))
        for i, a in enumerate(AMBIENCES)
    ]
    return (
        F.when(F.expr("(k div 5) % 5 = 0"), F.lit(None).cast("string"))
        .when(F.expr("(k div 5) % 5 = 1"), "None")
        .otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *entries), F.lit("}")))
    )


def _hours(day: int):
    return (
        F.when(F.expr(f"(k + {day}) % 5 = 1"), "0:0-0:0")
        .when(F.expr(f"(k + {day}) % 5 = 2"), "9:0-17:30")
        .when(F.expr(f"(k + {day}) % 5 = 3"), "18:0-2:0")
        .when(F.expr(f"(k + {day}) % 5 = 4"), F.expr("concat(k % 12, ':', 15 * (k % 4), '-', 12 + k % 12, ':0')"))
    )


def business_raw(spark: SparkSession, sf: str) -> DataFrame:
    reviews = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("c"))
    attributes = {
        a: F.lit(None).cast("string") if a == "DogsAllowed"
        else _pick(f"((k div {j + 1}) + {j}) % 4", ["True", "False", "None", None])
        for j, a in enumerate(TRISTATES)
    }
    attributes["NoiseLevel"] = _pick("(k div 6) % 6", ["u'quiet'", "'average'", "loud", "u'very_loud'", "None", None])
    attributes["RestaurantsAttire"] = _pick("(k div 25) % 5", ["u'casual'", "'dressy'", "formal", "None", None])
    attributes["RestaurantsPriceRange2"] = _pick("(k div 36) % 6", ["1", "2", "3", "4", "None", None])
    attributes["Ambience"] = _ambience()
    ordered = [f.name for f in schemas.BUSINESS["attributes"].dataType]
    return (
        table(spark, sf, "part").withColumn("k", F.col("p_partkey")).join(reviews, "k", "left").select(
            F.expr("concat('b', k)").alias("business_id"),
            F.col("p_name").alias("name"),
            F.expr("concat(p_brand, ' ', p_size)").alias("address"),
            F.expr("concat('City', k % 20)").alias("city"),
            F.expr("concat('S', k % 5)").alias("state"),
            F.expr("27.5D + (37 * k % 1000) / 1000D").alias("latitude"),
            F.expr("-83D + (91 * k % 1000) / 1000D").alias("longitude"),
            F.expr("1D + (7 * k % 9) / 2D").alias("stars"),
            F.coalesce("c", F.lit(0)).alias("review_count"),
            F.expr("if(k % 6 = 0, 0L, 1L)").alias("is_open"),
            F.expr("if(k % 50 = 0, null, concat(replace(p_name, ' ', ', '), ', ', p_type))").alias("categories"),
            F.struct(*[attributes[a].alias(a) for a in ordered]).alias("attributes"),
            F.struct(*[_hours(d).alias(day) for d, day in enumerate(DAYS)]).alias("hours"),
        )
    )


def review_raw(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd'))").alias("review_id"),
        F.expr("concat('u', o_custkey)").alias("user_id"),
        F.expr("concat('b', l_partkey)").alias("business_id"),
        F.expr("1D + ((l_quantity - 1) % 9) / 2D").alias("stars"),
        F.expr("cast(l_linenumber as bigint)").alias("useful"),
        F.expr("cast(l_linenumber % 3 as bigint)").alias("funny"),
        F.expr("cast(l_linenumber % 2 as bigint)").alias("cool"),
        F.expr("concat(l_returnflag, l_linestatus)").alias("text"),
        F.expr("date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')").alias("date"),
    )


def user_raw(spark: SparkSession, sf: str) -> DataFrame:
    def compliment(i: int) -> str:
        return f"{8 + 1 if COMPLIMENTS[i] == 'cool' else i + 1} * k % 7"

    return table(spark, sf, "customer").withColumn("k", F.col("c_custkey")).select(
        F.expr("concat('u', k)").alias("user_id"),
        F.col("c_name").alias("name"),
        F.expr("k % 100").alias("review_count"),
        F.expr("""if(k % 97 = 0, 'unknown', concat(2010 + k % 10, '-', lpad(1 + k % 12, 2, '0'), '-',
                  lpad(1 + k % 28, 2, '0'), ' ', lpad(k % 24, 2, '0'), ':00:00'))""").alias("yelping_since"),
        F.expr("k % 50").alias("useful"), F.expr("k % 30").alias("funny"), F.expr("k % 20").alias("cool"),
        F.lit("").alias("elite"),
        F.expr("concat_ws(', ', concat('u', k + 1), concat('u', k + 2), concat('u', k + 3))").alias("friends"),
        F.expr("k % 7").alias("fans"),
        F.expr("1D + (k % 9) / 2D").alias("average_stars"),
        *[F.expr(compliment(i)).alias(f"compliment_{c}") for i, c in enumerate(COMPLIMENTS)],
    )


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Users with a home location, except every third, and a name, except every tenth."""
    k = F.expr("cast(substr(user_id, 2) as bigint)")
    return user_raw(spark, sf).withColumns({
        "latitude": F.when(k % 3 != 0, F.lit(27.0) + (k % 10) / 10.0),
        "longitude": F.when(k % 3 != 0, F.lit(-82.0) - (k % 10) / 10.0),
        "name": F.when(k % 10 != 0, F.col("name")),
    })


def tip_raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.expr("concat('u', user_id)").alias("user_id"),
        F.expr("concat('b', user_id)").alias("business_id"),
        F.col("event_type").alias("text"),
        F.expr("date_format(ts, 'yyyy-MM-dd HH:mm:ss')").alias("date"),
        F.expr("cast(floor(value) as bigint)").alias("compliment_count"),
    )


def checkin_raw(spark: SparkSession, sf: str) -> DataFrame:
    """One check-in list per event: its time, an hour later and, for odd ids, a text that is no time."""
    return table(spark, sf, "events").select(
        F.expr("concat('b', event_id)").alias("business_id"),
        F.expr("""concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',  ',
                  date_format(ts + interval 1 hour, 'yyyy-MM-dd HH:mm:ss'),
                  if(event_id % 2 = 1, ', later', ''))""").alias("date"),
    )


def business(spark: SparkSession, sf: str) -> DataFrame:
    return clean_business(business_raw(spark, sf))


def review(spark: SparkSession, sf: str) -> DataFrame:
    return clean_review(review_raw(spark, sf))


def user(spark: SparkSession, sf: str) -> DataFrame:
    return clean_user(user_raw(spark, sf))


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.expr("concat('w', vec_id)").alias("word"), F.col("embedding").alias("vector"))


def category_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A vector for each word of the category vocabulary, picked by the word's hash."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    rows = vectors.agg(F.count("*").alias("n")).scalar()
    words = category_vocabulary(business(spark, sf)).withColumn(
        "vec_id", F.expr("cast(conv(substr(md5(word), 1, 6), 16, 10) as bigint)") % rows)
    return words.join(vectors, "vec_id").select("word", "vector")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per customer. Every tenth asks as a user without any review."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    customers = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    return customers.join(parts, F.col("k") == F.col("p_partkey")).select(
        F.expr("concat('q', k)").alias("query_id"),
        F.expr("concat(if(k % 10 = 0, 'x', 'u'), k)").alias("user_id"),
        F.expr("element_at(array('radial', 'City', 'state'), cast(k % 3 + 1 as int))").alias("locality_mode"),
        F.expr("if(k % 3 = 2, concat('S', k % 5), null)").alias("state"),
        F.expr("if(k % 3 = 1, concat('City', k % 20), null)").alias("city"),
        F.expr("if(k % 3 = 0, 27.5D + (37 * k % 1000) / 1000D, null)").alias("latitude"),
        F.expr("if(k % 3 = 0, -83D + (91 * k % 1000) / 1000D, null)").alias("longitude"),
        F.expr("if(k % 3 = 0, 5D + 5D * (k % 4), null)").alias("radius_km"),
        F.expr("if(k % 2 = 0, split(p_name, ' '), slice(split(p_name, ' '), 1, 1))").alias("categories"),
        F.lit(0).alias("scope"),
        F.expr(f"element_at(array({', '.join(repr(d) for d in DAYS)}), cast(k % 7 + 1 as int))").alias("day"),
        F.expr("cast(37 * k % 1440 as int)").alias("time_minutes"),
        F.lit(5).alias("n"),
        F.expr("k % 4 != 0").alias("currently_open"), F.expr("k % 5 = 0").alias("recommend_reviewed"),
        F.expr("k % 6 = 0").alias("trip_duration"), F.expr("k % 2 = 0").alias("detail"),
    )


def scoped_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The same queries with a scope of 0 to 2."""
    return queries(spark, sf).withColumn("scope", F.expr("cast(substr(query_id, 2) as int) % 3"))


def broken_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The same queries, most of them damaged in one way or another."""
    k = F.expr("cast(substr(query_id, 2) as int)")
    return queries(spark, sf).withColumns({
        "locality_mode": F.when(k % 8 == 1, "planet").otherwise(F.col("locality_mode")),
        "state": F.when(k % 8 != 2, F.col("state")),
        "latitude": F.when(k % 8 != 3, F.col("latitude")),
        "radius_km": F.when(k % 8 != 6, F.col("radius_km")),
        "categories": F.when(k % 8 == 5, F.array().cast("array<string>")).otherwise(F.col("categories")),
        "day": F.when(k % 8 == 7, "Someday").otherwise(F.col("day")),
    })


def travel_times(spark: SparkSession, sf: str) -> DataFrame:
    from placerank.operators.locality import distance_to

    k = F.expr("cast(substr(business_id, 2) as bigint)")
    return business(spark, sf).select(
        F.lit(HOME[0]).alias("origin_latitude"), F.lit(HOME[1]).alias("origin_longitude"), "business_id",
        F.when(k % 10 != 0, F.round(distance_to(*HOME) * 90)).alias("seconds"),
    )
