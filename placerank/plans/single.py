"""One query: constants instead of joins, so state, city, box and is_open reach the scan as filters."""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DAYS
from ..functions import hours, text, vectors
from ..operators import expansion, locality, preference, ranking
from ..operators.columns import any_category
from ..operators.trips import add_trip_duration
from ..sources.shared import materialize
from ..sources.sinks import write_results, write_text
from .batch import similarity


@dataclass(frozen=True)
class Query:
    """What one user asks. `locality` is ('state', s), ('city', c) or ('radial', (lat, lon), km)."""
    user_id: str
    locality: tuple
    categories: Sequence[str] = field(default_factory=list)
    day: str = "Friday"
    time: int = 21 * 60
    scope: int = 0

    @property
    def mode(self) -> str:
        return str(self.locality[0]).lower()


def similar_categories(spark_df: DataFrame, terms: Sequence[str], scope: int, word_vectors: DataFrame | None) -> list[str]:
    """The query's categories with their nearest words: a list bounded by len(terms) * (scope + 1).
    `spark_df` is the vocabulary; a category outside it raises."""
    spark = spark_df.sparkSession
    asked = spark.createDataFrame([(t, scope) for t in dict.fromkeys(terms)], "term string, scope int")
    strange = expansion.unknown_terms(asked, spark_df).first()
    if strange is not None:
        raise ValueError(f"no business is filed under {strange.term!r}")
    if scope == 0:
        return sorted(set(terms))
    if word_vectors is None:
        raise ValueError("word vectors are needed for a scope above 0")
    matched = expansion.expand_terms(asked, word_vectors).select("matched").distinct()
    return sorted(r.matched for r in matched.collect())


def _pool(business: DataFrame, terms: Sequence[str]) -> DataFrame:
    return business.filter(any_category(terms))


def _single_means(pool: DataFrame) -> Column:
    """Means of the whole pool as a scalar subquery."""
    return preference.impute_means(pool.withColumn("attrs", vectors.pack_attributes()), []).scalar()


def candidate_pool(business: DataFrame, query: Query, terms: Sequence[str]) -> DataFrame:
    """Open businesses of the query's categories and locality with their vectors; gaps are filled with
    the means of the categories everywhere."""
    in_categories = _pool(business, terms)
    means = _single_means(in_categories)
    here = locality.in_locality(in_categories, query.locality).filter("is_open")
    packed = here.withColumn("attrs", vectors.pack_attributes()).withColumn("means", means)
    return preference.unit_vectors(packed)


def user_businesses(business: DataFrame, reviews: DataFrame, user_id: str) -> DataFrame:
    """Everything the user rated, with the latest stars."""
    latest = preference.latest_stars(reviews.filter(F.col("user_id") == user_id))
    return preference.rated_businesses(latest, business)


def preference_vector(pool: DataFrame, rated: DataFrame, terms: Sequence[str]) -> Column:
    """The user's vector for these categories, or the pool's mean, as a scalar subquery."""
    history = _pool(rated, terms)
    own = preference.unit_vectors(
        history.withColumn("attrs", vectors.pack_attributes()).withColumn("means", _single_means(history)))
    mine = preference.preference_vectors(own, []).scalar()
    neutral = preference.mean_vectors(pool, []).scalar()
    return F.coalesce(mine, neutral)


def currently_open(business: DataFrame, day: str, minutes: int) -> DataFrame:
    index = DAYS.index(day.title())
    today, before = hours.day_columns(DAYS[index]), hours.day_columns(DAYS[index - 1])
    return business.filter(hours.open_at(*[F.col(c) for c in today + before], F.lit(int(minutes))))


def rank(business: DataFrame, reviews: DataFrame, query: Query, n: int = 5, open_now: bool = True,
         recommend_reviewed: bool = False, word_vectors: DataFrame | None = None,
         vocabulary: DataFrame | None = None) -> DataFrame:
    """The best `n` businesses in order, with all their columns and similarity and bin."""
    if vocabulary is None:
        vocabulary = word_vectors if word_vectors is not None else expansion.category_vocabulary(business)
    terms = similar_categories(vocabulary, query.categories, query.scope, word_vectors)
    pool = candidate_pool(business, query, terms)
    rated = user_businesses(business, reviews, query.user_id)
    scored = pool.withColumn("preference", preference_vector(pool, rated, terms)).withColumn(
        "similarity", similarity())
    if open_now:
        scored = currently_open(scored, query.day, query.time)
    scored = scored.withColumn("user_id", F.lit(query.user_id))
    if not recommend_reviewed:
        scored = preference.drop_reviewed(scored, rated)
    scored = scored.select(
        F.lit("q").alias("query_id"), "business_id", "name", "address", "city", "stars", "review_count",
        "latitude", "longitude", "categories", "quality", "similarity")
    # Edges and bins read the scores several times; the pool behind them is computed once.
    return ranking.top_n_single(ranking.similarity_bins(materialize(scored, "scored")), n)


def project_results(results: DataFrame, detail: bool = False, trip_duration: bool = False) -> DataFrame:
    """The columns people read, by flag."""
    columns = ["name", "address", "city", "stars", "review_count"]
    columns += ["categories"] * detail + ["trip_duration"] * trip_duration
    return results.select(*columns)


def _with_trips(ranked: DataFrame, query: Query, travel_times: DataFrame | None) -> DataFrame:
    lat, lon = query.locality[1]
    asked = ranked.withColumns({
        "query_latitude": F.lit(float(lat)), "query_longitude": F.lit(float(lon)),
        "locality_mode": F.lit("radial"), "trip_requested": F.lit(True)})
    if travel_times is None:
        return asked.withColumn("trip_duration", F.lit("N/A"))
    return add_trip_duration(asked, travel_times)


def recommend(business: DataFrame, reviews: DataFrame, query: Query, n: int = 5, open_now: bool = True,
              recommend_reviewed: bool = False, trip_duration: bool = False, detail: bool = False,
              word_vectors: DataFrame | None = None, travel_times: DataFrame | None = None,
              vocabulary: DataFrame | None = None) -> DataFrame:
    """Top-N table for one query. Trip durations exist in radial mode only."""
    ranked = rank(business, reviews, query, n, open_now, recommend_reviewed, word_vectors, vocabulary)
    trips = trip_duration and query.mode == "radial"
    if trips:
        ranked = _with_trips(ranked, query, travel_times)
    ordered = ranked.orderBy(F.desc("similarity_bin"), F.desc_nulls_last("quality"), "business_id")
    return project_results(ordered, detail, trips)


def save_recommendation(found: DataFrame, path: str, fmt: str = "text") -> None:
    """Write a recommendation: as padded text lines, or as csv, json or parquet."""
    (write_text if fmt == "text" else write_results)(found, path, *([] if fmt == "text" else [fmt]))


def recommend_json(business: DataFrame, reviews: DataFrame, query: Query, n: int = 5, open_now: bool = True,
                   recommend_reviewed: bool = False, trip_duration: bool = False, detail: bool = False,
                   word_vectors: DataFrame | None = None, travel_times: DataFrame | None = None,
                   vocabulary: DataFrame | None = None) -> DataFrame:
    """The same as one JSON text per result, with id and coordinates. NULL fields stay in the text."""
    ranked = rank(business, reviews, query, n, open_now, recommend_reviewed, word_vectors, vocabulary)
    trips = trip_duration and query.mode == "radial"
    if trips:
        ranked = _with_trips(ranked, query, travel_times)
    ordered = ranked.orderBy(F.desc("similarity_bin"), F.desc_nulls_last("quality"), "business_id")
    return ordered.select(result_json(detail, trips).alias("result"))


def result_json(detail: bool = False, trip_duration: bool = False) -> Column:
    fields = [
        "business_id", "name", "address", "city", F.col("review_count").cast("int").alias("review_count"),
        *[F.col(c).cast("double").alias(c) for c in ("stars", "latitude", "longitude")],
    ]
    if detail:
        fields.append(text.categories_text(F.col("categories")).alias("categories"))
    if trip_duration:
        fields.append("trip_duration")
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
