"""Ratings, imputation and preference vectors."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import vectors
from .columns import is_first_match
from .skew import spread_join


def latest_stars(reviews: DataFrame) -> DataFrame:
    """The star rating of the latest review per user and business; equal dates by review id. One
    combinable aggregate: no sort, and a pair with very many reviews is reduced before the shuffle."""
    latest = F.max_by("stars", F.struct("date", "review_id"))
    return reviews.groupBy("user_id", "business_id").agg(latest.alias("user_stars"))


def rated_businesses(ratings: DataFrame, business: DataFrame, per_task: int | None = None) -> DataFrame:
    """Ratings with the columns of the business; ratings of unknown businesses drop out."""
    return spread_join(ratings, business, ["business_id"], ["user_id"], per_task=per_task)


def drop_reviewed(candidates: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """Candidates (user_id, business_id, ...) that the user has not rated. Without `rated` they bring the ratings along
    (`with_reviewed`), and no candidate is shuffled for the test."""
    if rated is None:
        known = F.coalesce(F.array_contains("reviewed", F.col("business_id")), F.lit(False))
        return candidates.filter(~known).drop("reviewed")
    return candidates.join(rated.select("user_id", "business_id"), ["user_id", "business_id"], "left_anti")


def with_reviewed(asked: DataFrame, rated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`asked` with `reviewed`, the businesses rated under its keys (the user, and where, if candidates are of one place)."""
    seen = rated.groupBy(*keys).agg(F.collect_set("business_id").alias("reviewed"))
    return asked.join(seen, list(keys), "left")


def attribute_totals(df: DataFrame, by: Sequence[str], attrs: str = "attrs") -> DataFrame:
    """Number of values and their sum per attribute, as two arrays per group: the sums of small ints
    are exact, and partial sums of groups can be added up again with `add_totals`."""
    slots = vectors.elements(F.col(attrs))
    aggregates = [F.count(a).alias(f"_n{i}") for i, a in enumerate(slots)]
    aggregates += [F.coalesce(F.sum(a), F.lit(0)).alias(f"_t{i}") for i, a in enumerate(slots)]
    return _collapse(df.groupBy(*by).agg(*aggregates), by)


def add_totals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum up arrays of counts and totals per group."""
    aggregates = [F.sum(F.col("counts")[i]).alias(f"_n{i}") for i in range(vectors.WIDTH)]
    aggregates += [F.sum(F.col("totals")[i]).alias(f"_t{i}") for i in range(vectors.WIDTH)]
    return _collapse(df.groupBy(*by).agg(*aggregates), by)


def _collapse(df: DataFrame, by: Sequence[str]) -> DataFrame:
    def packed(prefix: str):
        return F.array(*[F.col(f"{prefix}{i}") for i in range(vectors.WIDTH)])

    return df.select(*by, packed("_n").alias("counts"), packed("_t").alias("totals"))


def with_means(totals: DataFrame) -> DataFrame:
    """Counts and totals to means; an attribute without a single value gets its default."""
    counts, sums = (vectors.elements(F.col(c)) for c in ("counts", "totals"))
    return totals.withColumn("means", vectors.means_or_defaults(counts, sums)).drop("counts", "totals")


def impute_means(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., means): what fills the gaps of a pool."""
    return with_means(attribute_totals(df, by))


def unit_vectors(df: DataFrame) -> DataFrame:
    """`attrs` and `means` to the filled vector and its length (the unit vector is their ratio)."""
    return (
        df.withColumn("filled", vectors.fill(F.col("attrs"), F.col("means")))
        .withColumn("length", vectors.norm(F.col("filled")))
        .drop("attrs", "means")
    )


def business_vectors(pool: DataFrame, by: Sequence[str], spread_by: Sequence[str] = ("business_id",),
                     per_task: int | None = None) -> DataFrame:
    """Impute within each group and normalise."""
    return unit_vectors(spread_join(pool, impute_means(pool, by), by, spread_by, per_task=per_task))


def preference_vectors(rated: DataFrame, by: Sequence[str], weight: str = "user_stars") -> DataFrame:
    """(by..., preference): star-weighted mean of unit vectors; NULL when all weights are 0."""
    mean = vectors.mean_vector("filled", "length", F.col(weight).cast("double"))
    return rated.groupBy(*by).agg(mean.alias("preference"))


def mean_vectors(pool: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., preference): the unweighted mean of a pool, for users without a history."""
    mean = vectors.mean_vector("filled", "length", F.lit(1.0))
    return pool.groupBy(*by).agg(mean.alias("preference"))


def category_set_totals(business: DataFrame) -> DataFrame:
    """Attribute counts and totals per distinct set of categories: however many businesses share a
    category, only its sets of categories take part in the join with the pools."""
    sets = business.filter(F.col("categories").isNotNull()).withColumn(
        "categories", F.array_sort(F.array_distinct("categories")))
    return attribute_totals(sets, ["categories"])


def pool_means(business: DataFrame, pools: DataFrame, per_task: int | None = None) -> DataFrame:
    """(pool_key, means) over all businesses that share a term with the pool, wherever they are and
    whether or not they are open. `pools` has pool_key and terms."""
    sets = category_set_totals(business).withColumn("term", F.explode("categories"))
    wanted = pools.select("pool_key", "terms").distinct().withColumn("term", F.explode("terms"))
    matched = spread_join(sets, wanted, ["term"], ["categories"], ["pool_key"], per_task=per_task).filter(
        is_first_match(F.col("categories"), F.col("terms"), F.col("term")))
    return with_means(add_totals(matched, ["pool_key"]))


def default_means():
    return F.array(*[F.lit(d) for d in DEFAULTS])
