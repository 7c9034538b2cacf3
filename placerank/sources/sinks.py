"""Sinks. All of them are written by the executors; only previews reach the driver."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def write_if_absent(df: DataFrame, path: str, cluster_by: Sequence[str | Column] = (), partition_by: Sequence[str] = ()) -> None:
    """Parquet, left alone when something is there already. `cluster_by` range-sorts the rows so
    that row-group statistics can skip data; `partition_by` makes folders. Rows clustered by `geo.curve_position`
    lie near each other on the globe, so the box of a circle meets few row groups."""
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode("ignore")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a result table as parquet, json or csv (arrays become `a, b, c` text for csv)."""
    if fmt == "csv":
        df = df.select(*[
            F.array_join(c, ", ").alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes
        ])
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def _as_text(column: str, kind: str) -> Column:
    if kind.startswith("array<"):
        return F.concat(F.lit("["), F.array_join(column, ", ", "None"), F.lit("]"))
    return F.coalesce(F.col(column).cast("string"), F.lit("NaN" if kind in ("float", "double") else "None"))


def write_text(df: DataFrame, path: str, width: int | None = None) -> None:
    """Overwrite a result table as one file of text lines in the order of `df`: a header, then the rows, each column as wide as
    its widest value or name and flush right. With a `width` all columns are that wide, flush left, without a header.

    One task writes the file: this is for the rows of an answer, whose number is bounded."""
    shown = {c: _as_text(c, t) for c, t in df.dtypes}
    if width is not None:
        fixed = [F.when(F.col(c).isNull(), "").otherwise(F.array_join(c, ", ") if t.startswith("array<") else F.col(c).cast("string"))
                 for c, t in df.dtypes]
        line = F.format_string(" ".join([f"%-{width}s"] * len(fixed)), *fixed)
        df.select(F.rtrim(line).alias("value")).write.mode("overwrite").text(path)
        return
    spark = df.sparkSession
    texts = df.select(*[s.alias(c) for c, s in shown.items()])
    longest = texts.agg(*[F.max(F.char_length(c)).alias(c) for c in texts.columns]).first()
    widths = {c: max(len(c), longest[c] or 0) for c in texts.columns}
    line = F.concat_ws(" ", *[F.lpad(c, widths[c], " ") for c in texts.columns])
    rows = texts.select(F.monotonically_increasing_id().alias("nth"), line.alias("value"))
    header = spark.createDataFrame([(-1, " ".join(c.rjust(widths[c]) for c in texts.columns))], "nth long, value string")
    header.unionByName(rows).coalesce(1).sortWithinPartitions("nth").select("value").write.mode("overwrite").text(path)


def sample_dump(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, rows: int = 100) -> DataFrame:
    """The first `rows` rows in key order, of chosen columns."""
    return df.orderBy(*order_by).limit(rows).select(*(columns or df.columns))


def rewrite_json(df: DataFrame, path: str) -> None:
    """Replace a JSON-lines table that `df` may itself be derived from: the new rows are complete in
    a staged copy before the old ones are overwritten, so a crash never leaves neither. The copy is Parquet, a fraction of the
    bytes of JSON text."""
    materialize(df, "staged-json").write.mode("overwrite").json(path)


def preview(df: DataFrame, rows: int = 5, truncate: bool = True) -> None:
    df.show(rows, truncate=truncate)
