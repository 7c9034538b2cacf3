"""Helpers of the corpus operators: tables, stored stages, batches of texts."""

import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_path

WORD_GAP = b" \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that what follows survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """`df` as a join's side that is dealt out and never sent whole to the driver and to all tasks: Spark sizes rows after an explode, long
    lists and well-packed files far too low."""
    return df.hint("merge")


def spread(df: DataFrame) -> int:
    """How many partitions to deal `df` out to: what its scan has, or the session's setting if that is more."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def power_of_two(n: float) -> int:
    return 1 << max(0, int(-(-n // 1)) - 1).bit_length()


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def cut(batches, column: str, size: int, rows: int):
    """Cuts of batches, so that the values of a text or binary column have about `size` bytes, in at most `rows` rows."""
    for batch in batches:
        through = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = int(through[lo - 1]) if lo else 0
            hi = max(lo + 1, min(int(np.searchsorted(through, before + size, "right")), lo + rows))
            yield batch.slice(lo, hi - lo)
            lo = hi


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unique_name(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}"


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object of any class whole, so that executors need no copy of this package; see `shared`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast: Broadcast):
    return pickle.loads(broadcast.value)
