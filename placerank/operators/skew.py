"""Joins of many rows with many rows in which no key has to fit one task."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

PAIRS_PER_TASK = 20_000_000
# Small inputs with many pairs get a partition for each share of the work limit, however few bytes they are.
SHARES, MOST_PARTITIONS, FEW_PAIRS = 20, 8192, 8
ROWS_PER_TASK = 2_000_000

_BIG, _SMALL = "_big_part", "_small_part"


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n): rows of each key, combined before the shuffle; keys with a NULL join nothing."""
    not_null = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return df.filter(not_null).groupBy(*keys).agg(F.count("*").alias("n"))


def hot_keys(big_counts: DataFrame, small_counts: DataFrame, keys: Sequence[str], per_task: int) -> DataFrame:
    """Every key whose block of pairs is over `per_task`, with the number of parts to cut either side into:
    enough tiles for the work, shaped so that little is repeated, and never more parts than rows. A merge join holds a
    key's rows of the second side, so more than ROWS_PER_TASK of them are cut as well."""
    counts = big_counts.withColumnRenamed("n", "_b").join(small_counts.withColumnRenamed("n", "_s"), list(keys))
    b, s = F.col("_b").cast("double"), F.col("_s").cast("double")
    tiles = F.ceil(b * s / per_task)
    shape = F.when(tiles > 1, F.ceil(F.sqrt(tiles * s / b))).otherwise(1)
    small_parts = F.least(F.col("_s"), F.greatest(F.ceil(s / ROWS_PER_TASK), shape))
    hot = counts.filter((b * s > per_task) | (s > ROWS_PER_TASK)).withColumn(_SMALL, small_parts.cast("bigint"))
    big_parts = F.least(F.col("_b"), F.greatest(F.lit(1), F.ceil(tiles / F.col(_SMALL))))
    return hot.withColumn(_BIG, big_parts.cast("bigint")).drop("_b", "_s")


def _pairs(sides: Sequence[tuple[DataFrame, DataFrame | None]], keys: Sequence[str]) -> tuple[float, float, float, float]:
    """(most pairs that any key has, pairs in all, rows of the first side, most rows of the second that meet one of the first), from the rows of both sides or counts that are known; one shuffle of
    combined counts by the keys' hash, so a collision can only make them greater."""
    parts = []
    for i, (rows, counts) in enumerate(sides):
        known = counts if counts is not None else rows.withColumn("n", F.lit(1).cast("bigint"))
        not_null = reduce(and_, [F.col(k).isNotNull() for k in keys])
        own = [F.col("n").cast("double") if i == j else F.lit(0.0) for j in (0, 1)]
        parts.append(known.filter(not_null).select(F.xxhash64(*keys).alias("k"), own[0].alias("b"), own[1].alias("s")))
    both = parts[0].unionByName(parts[1]).groupBy("k").agg((F.sum("b") * F.sum("s")).alias("pairs"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    held = F.when(F.col("b") > 0, F.col("s"))
    return tuple(both.agg(*[F.coalesce(a, F.lit(0.0)) for a in (F.max("pairs"), F.sum("pairs"), F.sum("b"), F.max(held))]).first())


def _own_part(spread_by: Sequence[str], parts: str) -> Column:
    return F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col(parts), F.lit(1)))


def _every_part(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(parts), F.lit(1)) - 1))


def spread_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
                spread_small_by: Sequence[str] | None = None, how: str = "inner", per_task: int | None = None,
                big_counts: DataFrame | None = None, small_counts: DataFrame | None = None) -> DataFrame:
    """Equi-join whose hot keys are spread out.

    Without `spread_small_by`, `small` has one row per key (a lookup): the work follows the bytes of `big`, and Spark's
    adaptive execution cuts a large key's partition; `how` may be inner or left. With it, both sides may be many rows
    per key (inner only) and bytes say little about the pairs: keys are counted (`big_counts` and `small_counts`
    spare that where sums are known), and the block of a hot key is tiled, each side repeated along the other's
    tiles. Hot keys, however many, are joined in like any table; Spark broadcasts it if its size allows. Either way the big
    side is dealt out by its pairs, as adaptive execution would put all of a few bytes into one task."""
    keys = list(keys)
    if spread_small_by is None:
        return big.join(small, keys, how)
    if how != "inner":
        raise ValueError("only inner joins can repeat the big side")
    per_task = per_task or PAIRS_PER_TASK
    most, pairs, rows, held = _pairs(((big, big_counts), (small, small_counts)), keys)
    # Where pairs are hardly more than rows, bytes say enough about the work.
    parts = min(int(pairs * SHARES / per_task) + 1, MOST_PARTITIONS) if pairs > FEW_PAIRS * rows else 1

    def dealt(df: DataFrame, by: list[str]) -> DataFrame:
        # A broadcast of this side would undo it: the pairs would fall to the tasks of the other.
        return df.repartition(parts, *by).hint("merge") if parts > 1 else df

    if most <= per_task and held <= ROWS_PER_TASK:
        return dealt(big, keys).join(small, keys)
    counts = (big_counts if big_counts is not None else key_counts(big, keys),
              small_counts if small_counts is not None else key_counts(small, keys))
    # A stored table, so that both sides agree on it also when tasks run again.
    hot = materialize(hot_keys(*counts, keys, per_task), "hot")
    left = big.join(hot, keys, "left").withColumn("_i", _own_part(spread_by, _BIG)).withColumn("_j", _every_part(_SMALL))
    right = small.join(hot, keys, "left").withColumn("_i", _every_part(_BIG)).withColumn("_j", _own_part(spread_small_by, _SMALL))
    return dealt(left.drop(_BIG, _SMALL), keys + ["_i", "_j"]).join(right.drop(_BIG, _SMALL), keys + ["_i", "_j"]).drop("_i", "_j")
