"""Business attributes as small numbers, and the popularity score."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AMBIENCES, ORDINALS
from .text import dict_to_map, strip_quotes


def tristate(col: Column) -> Column:
    """`'True'` 1, `'False'` 0, anything else NULL."""
    return F.when(col == "True", 1).when(col == "False", 0).cast("tinyint")


def ordinal(col: Column, codes: dict[str, int]) -> Column:
    """Code of the (unquoted) label; NULL for a label without a code."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])
    return lookup[strip_quotes(col)].cast("tinyint")


def ordinal_attribute(name: str, col: Column) -> Column:
    return ordinal(col, ORDINALS[name])


def map_flags(flags: Column, keys: list[str], prefix: str) -> list[Column]:
    """One 0/1 column per key of a map<string,boolean>; a NULL map gives zeros."""
    return [
        F.when(F.coalesce(flags[k], F.lit(False)), 1).otherwise(0).cast("tinyint").alias(f"{prefix}{k}")
        for k in keys
    ]


def ambience_flags(col: Column) -> list[Column]:
    return map_flags(dict_to_map(col), AMBIENCES, "Ambience_")


def quality(review_count: Column, stars: Column) -> Column:
    """log10(reviews + 1) * stars^2, to three places."""
    return F.round(F.log10(review_count + 1) * F.pow(stars, F.lit(2.0)), 3)
