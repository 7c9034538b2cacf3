"""Recommendations for a whole table of queries in one job.

Three levels of sharing. Queries with the same matched terms and locality look at the same pool of businesses; businesses are
stored in blocks of the areas that pools lie in, for later calls too if a `PoolStore` is given; the neutral taste is a pool's mean. A pool is
scored for each reader: a user with a history in its categories, or all others together. Queries of one reader that differ in
when and how they read the scores are variants, ranked once each. Pools and scores stay inside the tasks (`operators.blocks`): what
leaves them are the best rows, and for the greatest areas histograms for the bins before."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import W2V
from ..functions import hours, text, vectors
from ..operators import blocks, expansion, locality, preference, queries as requests, ranking
from ..operators.columns import is_first_match
from ..operators.skew import key_counts, spread_join
from ..operators.trips import add_trip_duration
from ..sources.pool_store import PoolStore
from ..sources.shared import materialize

_LOCALITY = ["locality_mode", "state", "city", "latitude", "longitude", "radius_km"]
_VARIANT = ["base_key", "day_index", "time_minutes", "currently_open", "recommend_reviewed"]
_READING = ["reader", *_VARIANT[1:]]


def pack_business(business: DataFrame) -> DataFrame:
    """The columns that ranking needs, with attributes and hours as arrays."""
    return business.select(
        "business_id", "state", "city", "latitude", "longitude", "is_open", "categories", "quality",
        vectors.pack_attributes().alias("attrs"), hours.pack_hours().alias("hours"),
    )


def resolve_queries(queries: DataFrame, vocabulary: DataFrame, word_vectors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(queries with their matched terms, rejects with a reason). A category outside the vocabulary
    rejects the whole query; without word vectors only scope 0 can be answered."""
    good, bad = requests.split_queries(queries)
    terms = good.select("query_id", "scope", F.explode(F.array_distinct("categories")).alias("term"))
    # A term that millions of queries ask for is looked up once.
    unknown = expansion.unknown_terms(terms.select("term").distinct(), vocabulary)
    strange = terms.join(unknown, "term", "left_semi").select("query_id").distinct()
    if word_vectors is None:
        too_wide = terms.filter("scope > 0").select("query_id").distinct()
        bad = bad.unionByName(good.join(too_wide, "query_id", "left_semi").withColumn(
            "reason", F.lit("no word vectors for scope")))
        good = good.join(too_wide, "query_id", "left_anti")
    bad = bad.unionByName(good.join(strange, "query_id", "left_semi").withColumn(
        "reason", F.lit("unknown category")))
    good = good.join(strange, "query_id", "left_anti")
    usable = terms.join(good.select("query_id"), "query_id", "left_semi")
    matched = expansion.matched_terms(expansion.expand_terms(usable, word_vectors))
    return good.join(matched, "query_id").withColumns({
        "base_key": requests.base_key(), "pool_key": requests.terms_key(), "pool_id": requests.pool_id(),
        "day_index": text.day_index(F.col("day"))}), bad


def _moment() -> list[Column]:
    return [F.coalesce(c, F.lit(-1)).alias(c) for c in ("day_index", "time_minutes")]


def variants(resolved: DataFrame, keys: list[str] = _VARIANT) -> DataFrame:
    """One row per distinct (base, day, time, flags), named after its first query, sized for its
    largest n. With checked times a base has at most 7 * 1440 * 4 of them, however many queries repeat it."""
    return resolved.select("query_id", "n", keys[0], *_moment(), *keys[3:]).groupBy(*keys).agg(
        F.min("query_id").alias("variant_id"), F.max("n").alias("n"))


def rated_in_pools(asked: DataFrame, rated: DataFrame, per_task: int | None = None) -> DataFrame:
    """(user_id, pool_key, business_id, user_stars, attrs): each user's rated businesses that share a
    term with one of the user's pools, wherever they are and whether or not they are open."""
    wanted = asked.select("user_id", "pool_key", "terms").distinct()
    # By user alone, and the terms tested in the pairs: a rating is one row of the shuffle, however many categories it has.
    return spread_join(rated, wanted, ["user_id"], ["business_id"], ["pool_key"], per_task=per_task).filter(
        F.arrays_overlap("categories", "terms")).select("user_id", "pool_key", "business_id", "user_stars", "attrs")


def pools(resolved: DataFrame, packed: DataFrame, per_task: int | None = None) -> DataFrame:
    """One row per pool: terms, locality, and means of its categories everywhere."""
    columns = ["terms", "pool_key", *_LOCALITY]
    pool = resolved.groupBy("pool_id").agg(*[F.min_by(c, "query_id").alias(c) for c in columns])
    means = preference.pool_means(packed, pool, per_task)
    return pool.join(means, "pool_key", "left").withColumn("means", F.coalesce("means", preference.default_means()))


def _matched(pool: DataFrame, packed: DataFrame, of_pool: list[str], per_task: int | None) -> DataFrame:
    """(pool_id, business_id, quality, hours, attrs): open businesses in each pool's locality and categories, with columns of the
    pool, which the pairs bring along: they are not joined again."""
    renamed = locality.place_rows(pool).withColumnsRenamed(
        {"latitude": "query_latitude", "longitude": "query_longitude"})
    placed = renamed.withColumn("term", F.explode("terms")).drop("state", "city", "locality_mode")
    points = locality.business_places(packed.filter("is_open").drop("is_open"), placed).select(
        "place", "business_id", "latitude", "longitude", "categories", "quality", "attrs", "hours",
        F.explode(F.array_distinct("categories")).alias("term"))
    joined = spread_join(points, placed.drop("kind"), ["place", "term"], ["business_id"], ["pool_id"], per_task=per_task)
    hit = joined.filter(
        is_first_match(F.col("categories"), F.col("terms"), F.col("term")) & locality.within_query_circle())
    return hit.select("pool_id", "business_id", "quality", "hours", "attrs", *of_pool)


def candidates(pool: DataFrame, packed: DataFrame, per_task: int | None = None) -> DataFrame:
    """(pool_id, business_id, quality, hours, attrs, means): the businesses of each pool with its means."""
    return _matched(pool.drop("pool_key"), packed, ["means"], per_task)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pool_tables(resolved: DataFrame, packed: DataFrame, per_task: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pools with means, neutral taste and area, blocks of the businesses of these areas), both stored."""
    radial = F.lower("locality_mode") == "radial"
    pool = pools(resolved, packed, per_task).select(
        "pool_id", "pool_key", "terms", "means", locality.query_area().alias("area"),
        *[F.when(radial, F.col(c).cast("double")).alias(c) for c in ("latitude", "longitude", "radius_km")])
    pool = materialize(pool, "pools")
    shown = packed.filter("is_open and categories is not null").select(
        "business_id", "quality", "hours", "attrs", "categories", "state", "city", "latitude", "longitude")
    packs = materialize(blocks.pack_blocks(locality.area_rows(shown, pool)), "blocks")
    tastes = pool.join(blocks.pool_tastes(packs, pool, _tasks(pool)), "pool_id", "left")
    return materialize(tastes, "tastes"), packs


def known_pools(resolved: DataFrame, business: DataFrame, store: PoolStore, per_task: int | None = None) -> tuple[DataFrame, DataFrame]:
    """`pool_tables` out of a store: only pools that it does not hold yet are looked for among the businesses."""
    new = resolved.join(store.known().select("pool_id"), "pool_id", "left_anti")
    if not new.isEmpty():
        store.add(*pool_tables(new, pack_business(business), per_task))
    return store.read(resolved.select("pool_id").distinct())


def readers(resolved: DataFrame, tastes: DataFrame, history: DataFrame, per_task: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries with their reader, readers with user_id, preference and the columns of their pool).

    A user with rated businesses in the pool's categories reads it alone, with the own preference vector, or the
    pool's mean if all ratings weigh 0; all other users of a pool are one reader with the mean."""
    pairs = ["user_id", "pool_key"]
    own = preference.preference_vectors(preference.business_vectors(history, pairs, per_task=per_task), pairs)
    asked = resolved.join(own.withColumn("known", F.lit(True)), pairs, "left").withColumns({
        "reader": F.when(F.col("known"), F.sha2(F.concat_ws("/", "pool_id", "user_id"), 256)).otherwise(F.col("pool_id")),
        # Nobody has reviewed what a pool holds for users without history in its categories.
        "recommend_reviewed": F.col("recommend_reviewed") & F.coalesce("known", F.lit(False)),
    })
    asked = materialize(asked, "asked")
    columns = ["pool_id", "pool_key", "preference"]
    alone = asked.groupBy("reader").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in columns], F.first(F.when(F.col("known"), F.col("user_id")), True).alias("user_id"))
    return asked.drop("preference", "known"), alone.join(tastes.drop("pool_key"), "pool_id", "left").withColumn(
        "preference", F.coalesce("preference", "neutral")).drop("neutral")


def prepare(resolved: DataFrame, packed: DataFrame, rated: DataFrame, per_task: int | None = None,
            made: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queries with readers, readers, blocks of areas, history); the latter three are stored. `made` are the pool tables, if
    there are any yet."""
    history = materialize(rated_in_pools(resolved, rated, per_task), "history")
    tastes, packs = made or pool_tables(resolved, packed, per_task)
    asked, who = readers(resolved, tastes, history, per_task)
    return asked, materialize(who, "readers"), packs, history


def similarity() -> Column:
    return vectors.weighted_dot(F.col("filled"), F.col("length"), F.col("preference"))


def readings(asked: DataFrame, who: DataFrame, packs: DataFrame, history: DataFrame, per_task: int | None = None) -> DataFrame:
    """A row for each variant of a reader and part of its area: when and how it reads, the pool, the preference, and which of the
    part's businesses the user has reviewed (at most the whole part)."""
    known = who.where("user_id is not null").select("reader", "user_id", "pool_key", "area")
    rated = spread_join(history.select("user_id", "pool_key", "business_id"), known, ["user_id", "pool_key"], ["business_id"], ["reader"],
                        per_task=per_task)
    seen = rated.join(blocks.members(packs), ["area", "business_id"]).groupBy("reader", "part").agg(
        F.collect_set("business_id").alias("seen"))
    reading = variants(asked, _READING).join(who.drop("user_id", "pool_key", "neutral"), "reader")
    return blocks.in_parts(reading, packs).withColumn("per_unit", blocks.cells_per_unit(F.col("size"))).join(seen, ["reader", "part"], "left")


def best_of(asked: DataFrame, who: DataFrame, packs: DataFrame, history: DataFrame, per_task: int | None = None) -> DataFrame:
    """(query_id, business_id, similarity, similarity_bin, rank): the best n for each variant, after open-now and reviewed."""
    reading = materialize(readings(asked, who, packs, history, per_task), "readings")
    parts, whole = _tasks(asked), blocks.parts_of() == 1
    binned, cut = blocks.best_of_whole(packs, reading.where(whole), parts), reading.where(~whole)
    if not cut.isEmpty():
        counted = materialize(blocks.histograms(packs, cut, parts), "histograms")
        binned = binned.unionByName(blocks.best_rows(packs, cut, blocks.edges_of(counted, parts), parts))
    return ranking.top_n(binned).drop("n", "quality")


def recommend_batch(queries: DataFrame, business: DataFrame, reviews: DataFrame,
                    word_vectors: DataFrame | None = None, travel_times: DataFrame | None = None,
                    per_task: int | None = None, min_count: int = W2V["minCount"],
                    pool_store: PoolStore | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) for a table of queries over clean businesses and reviews.

    Jobs run when it is called: intermediate tables are stored in the shared folder (`temporary_tables` removes them)
    and the results read the last ones. Without word vectors a category must occur `min_count` times to be known.
    A `pool_store` for this version of the businesses keeps the pools for the next call.

    Results have query_id, rank, similarity_bin, similarity and the display columns; `categories` is
    filled for queries with detail, `trip_duration` for radial queries that ask for it."""
    vocabulary = word_vectors if word_vectors is not None else expansion.category_vocabulary(business, min_count)
    resolved, rejects = resolve_queries(queries, vocabulary, word_vectors)
    resolved = materialize(resolved, "queries")
    packed = pack_business(business)
    mine = reviews.join(resolved.select("user_id").distinct(), "user_id", "left_semi")
    rated = materialize(preference.rated_businesses(
        preference.latest_stars(mine), packed.select("business_id", "categories", "attrs"), per_task), "rated")
    made = known_pools(resolved, business, pool_store, per_task) if pool_store is not None else None
    asked, who, packs, history = prepare(resolved, packed, rated, per_task, made)
    best = materialize(best_of(asked, who, packs, history, per_task), "best")
    return present(best, asked, business, travel_times, per_task), rejects


def unanswered(results: DataFrame, queries: DataFrame, rejects: DataFrame) -> DataFrame:
    """(query_id, status) for every query: answered, no match, or why it was rejected."""
    found = results.select("query_id").distinct().withColumn("answered", F.lit("answered"))
    bad = rejects.groupBy("query_id").agg(F.min("reason").alias("reason"))
    return queries.select("query_id").join(bad, "query_id", "left").join(found, "query_id", "left").select(
        "query_id", F.coalesce("reason", "answered", F.lit("no match")).alias("status"))


def present(best: DataFrame, resolved: DataFrame, business: DataFrame, travel_times: DataFrame | None,
            per_task: int | None = None) -> DataFrame:
    """Variant results back to every query that asked, with the columns people read."""
    asked = resolved.select(
        "query_id", "n", "reader", *_moment(), *_READING[3:], "locality_mode", "detail", F.col("trip_duration").alias("trip_requested"),
        F.col("latitude").alias("query_latitude"), F.col("longitude").alias("query_longitude"))
    named = asked.join(variants(resolved, _READING).drop("n"), _READING).drop(*_READING)
    ranks = best.withColumnRenamed("query_id", "variant_id")
    results = spread_join(named, ranks, ["variant_id"], ["query_id"], ["business_id"], per_task=per_task,
                          big_counts=key_counts(named, ["variant_id"]), small_counts=key_counts(ranks, ["variant_id"])
                          ).filter(F.col("rank") <= F.col("n"))
    shown = business.select(
        "business_id", "name", "address", "city", "stars", "review_count",
        "latitude", "longitude", "categories")
    results = spread_join(results, shown, ["business_id"], ["query_id"], per_task=per_task).withColumn(
        "categories", F.when(F.col("detail"), text.categories_text(F.col("categories"))))
    if travel_times is not None:
        results = add_trip_duration(results, travel_times)
    else:
        wanted = F.col("trip_requested") & (F.lower("locality_mode") == "radial")
        results = results.withColumn("trip_duration", F.when(wanted, "N/A"))
    return results.select(
        "query_id", "rank", "business_id", "name", "address", "city", "stars", "review_count", "latitude",
        "longitude", "similarity", "similarity_bin", "categories", "trip_duration")
