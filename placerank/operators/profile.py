"""Profiling aggregates: nulls, distinct values, correlations, descriptions."""

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_rows(one_row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    return one_row.unpivot([], list(columns), name, value)


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of values per column."""
    return df.agg(*[F.count(c).alias(c) for c in columns])


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the mean per column."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def null_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, null_share), most nulls first, from one pass."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return _as_rows(shares, columns, "attribute", "null_share").orderBy(F.desc("null_share"), "attribute")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, value) over all columns at once; the distinct is combined before its shuffle."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "attribute", "value").distinct()


def columns_equal(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: 1 when the columns agree in every row where both have a value, else 0."""
    return df.agg(F.product((F.col(left) == F.col(right)).cast("int")).cast("int").alias("equal"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of all column pairs as (left, right, correlation), in one pass; NULL beside
    a column without variance."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = numbers.agg(
        *[F.stddev_pop(c).alias(f"sd|{c}") for c in columns],
        *[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in combinations(columns, 2)],
    )

    def correlation(a: str, b: str) -> Column:
        if a == b:
            return F.lit(1.0)
        first, second = sorted((a, b), key=list(columns).index)
        spread = F.col(f"sd|{a}") * F.col(f"sd|{b}")
        return F.when(spread > 0, F.col(f"{first}|{second}") / spread)

    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), correlation(a, b).alias("correlation"))
        for a in columns for b in columns
    ])).alias("cell")).select("cell.*")


def vector_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, correlation) by Spark ML, over the rows without a NULL in any of the columns. The matrix has
    a cell for each pair of columns, so it may pass through the driver."""
    columns = list(columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="vector").transform(df.dropna(subset=columns))
    matrix = Correlation.corr(vectors, "vector").first()[0].toArray().tolist()
    cells = [(a, b, matrix[i][j]) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(cells, "left string, right string, correlation double")


def describe(df: DataFrame, value: Column) -> DataFrame:
    """One row: count, mean, stddev, min and max of an expression."""
    v = df.select(value.alias("v"))
    return v.agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev("v").alias("stddev"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def schema_report(df: DataFrame) -> DataFrame:
    """(position, column, type, non_null): the schema, with how much of each column is filled."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.select(F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"),
            F.col(c).alias("non_null"),
        ) for i, (c, t) in enumerate(df.dtypes)
    ])).alias("r")).select("r.*")
