"""Scans. JSON is read with a known schema, so there is no inference pass over the data."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under `schema`; what does not fit it is NULL."""
    return spark.read.schema(schema).json(path)


def read_json_or_reject(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines: rejects are the lines that are no JSON object or have a value of another type, with
    their `file` and `line`. Blank lines are neither."""
    whole = T.StructType(schema.fields + [T.StructField(schemas.CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.from_json("value", whole, options).alias("row"))
    bad = F.col(f"row.{schemas.CORRUPT}").isNotNull() | F.col("row").isNull()
    return lines.where(~bad).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields]), lines.where(bad).select("file", "line")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.PROFILE)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.REVIEW)
