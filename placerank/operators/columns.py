"""Projection, cast and null-handling operators over whole tables."""

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cast_columns(df: DataFrame, **types: str) -> DataFrame:
    """`try_cast` the named columns: text that does not fit becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def narrow_bigints(df: DataFrame) -> DataFrame:
    """Every bigint column as int, in one projection."""
    return df.select(*[
        F.col(c).try_cast("int").alias(c) if t == "bigint" else F.col(c) for c, t in df.dtypes
    ])


def narrow_floats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return cast_columns(df, **{c: "float" for c in columns})


def expand_struct(df: DataFrame, struct: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, f"{struct}.*")


def promote_fields(df: DataFrame, struct: str, fields: Sequence[str]) -> DataFrame:
    """Chosen fields of a struct as columns, the struct dropped."""
    return df.withColumns({f: F.col(f"{struct}.{f}") for f in fields}).drop(struct)


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if pattern in c]


def select_matching(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *columns_matching(df, pattern))


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*columns_matching(df, pattern))


def row_sum(columns: Sequence[str]) -> Column:
    """Sum over columns of a row; NULL when one of them is."""
    return reduce(add, [F.col(c) for c in columns])


def fill_nulls(df: DataFrame, values: dict[str, Column | float]) -> DataFrame:
    """Fill each column's gaps with its own value (a constant, or a one-row aggregate as subquery)."""
    return df.withColumns({
        c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in values.items()
    })


def map_columns(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def any_category(terms: Sequence[str], column: str = "categories") -> Column:
    """Whether the category array holds at least one of the terms."""
    if not terms:
        raise ValueError("at least one category is needed")
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(t) for t in terms]))


def is_first_match(categories: Column, terms: Column, term: Column) -> Column:
    """True for exactly one of the terms that a category array shares with a term array, so that a
    join over exploded categories yields each pair once, without a distinct."""
    return F.element_at(F.array_intersect(categories, terms), 1) == term
