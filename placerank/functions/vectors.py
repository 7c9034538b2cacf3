"""The attribute vector of a business: packing, filling, normalising, scoring.

Vectors travel as arrays and are worked on through unrolled element access, so the arithmetic stays
plain generated code. Sums that decide a ranking are kept exact: terms are put on a fixed grid of
1e-12 and added as pairs of longs, so the result does not depend on the order in which rows arrive."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ATTRIBUTE_NAMES, DEFAULTS, IMPORTANCE

WIDTH = len(ATTRIBUTE_NAMES)
GRID = 1e12


def pack_attributes() -> Column:
    """The attribute columns in vector order."""
    return F.array(*[F.col(a).cast("tinyint") for a in ATTRIBUTE_NAMES])


def elements(vector: Column) -> list[Column]:
    return [F.get(vector, F.lit(i)) for i in range(WIDTH)]


def fill(attrs: Column, means: Column) -> Column:
    """Attributes with their gaps filled from `means`."""
    return F.array(*[F.coalesce(a.cast("double"), m) for a, m in zip(elements(attrs), elements(means))])


def means_or_defaults(counts: list[Column], totals: list[Column]) -> Column:
    return F.array(*[
        F.when(n > 0, t / n).otherwise(d) for n, t, d in zip(counts, totals, DEFAULTS)
    ])


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def norm(vector: Column) -> Column:
    """Length of a vector; never 0, so that dividing the zero vector by it keeps the zeros."""
    return F.sqrt(F.greatest(total([x * x for x in elements(vector)]), F.lit(1e-300)))


def on_grid(value: Column) -> Column:
    """The nearest multiple of 1e-12, counted in such steps."""
    return F.floor(value * GRID + 0.5)


def exact_sum(steps: Column) -> Column:
    """Aggregate: the sum of whole numbers beyond what a long holds, as a decimal. High and low parts are added
    as longs, which is as exact and much cheaper than adding decimals."""
    high, low = F.shiftright(steps, 31), steps.bitwiseAND(F.lit((1 << 31) - 1))
    return F.sum(high).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(20,0)") + F.sum(low).cast("decimal(20,0)")


def weighted_dot(vector: Column, length: Column, preference: Column) -> Column:
    """Importance-weighted dot product of a unit vector (given unscaled with its length) and a
    preference vector, on the 1e-12 grid."""
    terms = [b * (u * w) for b, u, w in zip(elements(vector), elements(preference), IMPORTANCE)]
    return on_grid(total(terms) / length) / GRID


def mean_vector(vector: str, length: str, weight: Column) -> Column:
    """Aggregate: sum(w * v) / sum(w) over unit vectors; NULL when the weights add up to 0."""
    weights = F.sum(weight)
    scale = weight / F.col(length)
    sums = [exact_sum(on_grid(x * scale)) for x in elements(F.col(vector))]
    return F.when(weights > 0, F.array(*[s.cast("double") / (weights * GRID) for s in sums]))
