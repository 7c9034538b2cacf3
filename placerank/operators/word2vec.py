"""Category embeddings with Spark ML."""

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from ..config import W2V


def fit(business: DataFrame, categories: str = "categories", **settings) -> Word2VecModel:
    """Train on the category lists, in as many tasks as the lists have partitions, unless
    `numPartitions` is given."""
    lists = business.select(categories).filter(business[categories].isNotNull())
    chosen = {"numPartitions": max(1, lists.rdd.getNumPartitions()), **W2V, **settings}
    return Word2Vec(inputCol=categories, outputCol=f"{categories}_vec", **chosen).fit(lists)


def _saved(business: DataFrame, path: str) -> bool:
    spark = business.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def fit_or_load(business: DataFrame, path: str, **settings) -> Word2VecModel:
    """Load the model saved at `path`; train and save it when there is none."""
    if not _saved(business, path):
        fit(business, **settings).save(path)
    return Word2VecModel.load(path)


def word_vectors(model: Word2VecModel) -> DataFrame:
    """(word, vector) as plain arrays."""
    vectors = model.getVectors()
    return vectors.select("word", vector_to_array(vectors["vector"]).alias("vector"))
