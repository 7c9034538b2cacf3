"""Category vocabulary, nearest words, suggestions."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import W2V
from ..sources.shared import materialize
from .skew import spread_join

ROWS_PER_BLOCK = 4096
_NEIGHBOURS = "term string, word string, cosine double, k int"


def category_vocabulary(business: DataFrame, min_count: int = W2V["minCount"]) -> DataFrame:
    """(word, n) of the category tokens seen often enough, in order."""
    tokens = business.select(F.explode("categories").alias("word"))
    counted = tokens.groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count).orderBy("word")


def suggest_categories(vocabulary: DataFrame, query: str, selected: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """Up to `limit` words that contain the text, in any case, and are not selected yet."""
    wanted = query.strip().lower()
    found = vocabulary.select("word").filter(
        F.contains(F.lower("word"), F.lit(wanted)) & F.lit(bool(wanted)))
    if selected:
        found = found.filter(~F.col("word").isin(*selected))
    return found.orderBy("word").limit(limit)


def _grams(text: str, size: Column) -> Column:
    """The distinct pieces of `size` characters of a text; none if it is shorter."""
    last = F.char_length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(F.col(text), i, size)))).otherwise(
        F.array().cast("array<string>"))


def suggest_for_requests(vocabulary: DataFrame, requests: DataFrame, limit: int = 50, per_task: int | None = None) -> DataFrame:
    """(query_id, rank, word): for each request (query_id, text, selected) what `suggest_categories` gives.

    Words are indexed by their pieces of one, two and three characters. A text is looked up by its rarest piece of three
    characters, or of all it has, and the words found are tested whole; each text only once, for however many requests. Null
    texts get nothing; query ids name requests and should differ."""
    asked = requests.select("query_id", F.lower(F.trim("text")).alias("wanted"), F.coalesce(
        F.col("selected"), F.array().cast("array<string>")).alias("selected")).filter(F.col("wanted") != "")
    words = vocabulary.select("word", F.lower("word").alias("lower"))
    pieces = F.flatten(F.array(*[_grams("lower", F.lit(n)) for n in (1, 2, 3)]))
    index = materialize(words.withColumn("gram", F.explode(pieces)), "grams")
    # What other requests of a text have selected bounds how many of its words can be needed.
    texts = asked.groupBy("wanted").agg((F.max(F.size("selected")) + limit).alias("needed"))
    own = texts.withColumn("gram", F.explode(_grams("wanted", F.least(F.char_length("wanted"), F.lit(3)))))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("wanted", "needed").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    hits = spread_join(index, rarest, ["gram"], ["word"], ["wanted"], per_task=per_task).filter(F.contains("lower", "wanted"))
    first = hits.withColumn("nth", F.row_number().over(Window.partitionBy("wanted").orderBy("word"))).filter(F.col("nth") <= F.col("needed"))
    found = spread_join(asked, first.select("wanted", "word"), ["wanted"], ["query_id"], ["word"], per_task=per_task).filter(
        ~F.array_contains("selected", F.col("word")))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("word"))).filter(
        F.col("rank") <= limit).select("query_id", "rank", "word")


def document_vectors(documents: DataFrame, key: str, words: str, vectors: DataFrame) -> DataFrame:
    """(key, vector) for each key: the sum of the known words' vectors over the number of all words, and
    zeros for a document without a known word, an empty or a NULL one. A document is one row of sums from the
    lookup of its words on, not a row for each dimension."""
    size = F.greatest(F.size(F.coalesce(words, F.array().cast("array<string>"))), F.lit(0))
    known = materialize(vectors.select("word", "vector").filter(F.size("vector") > 0), "word-vectors")
    width = known.agg(F.max(F.size("vector"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0.0), width)
    if not width:
        return documents.select(key).distinct().withColumn("vector", zeros)
    tokens = documents.select(key, size.alias("_size"), F.explode_outer(words).alias("word")).join(known, "word", "left")
    sums = [F.sum(F.get("vector", F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(width)]
    summed = tokens.groupBy(key, "_size").agg(F.max(F.when(F.col("vector").isNotNull(), F.size("vector"))).alias("_dims"), *sums)
    dims = F.transform(F.slice(F.array(*[f"_s{i}" for i in range(width)]), F.lit(1), F.coalesce("_dims", F.lit(0))),
                       lambda x: x / F.greatest("_size", F.lit(1)))
    placed = F.transform("_rows", lambda row: F.transform(row, lambda x, i: F.struct(i.alias("_dim"), x.alias("x"))))
    listed = summed.select(key, dims.alias("_own")).groupBy(key).agg(F.collect_list("_own").alias("_rows")).select(
        key, F.sort_array(F.flatten(placed)).alias("_all"))
    found = F.col(key).isNotNull() & (F.size("_all") > 0)
    return listed.select(key, F.when(found, F.transform("_all", lambda d: d["x"])).otherwise(zeros).alias("vector"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _block_neighbours(terms: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """The best k words of one block of words, for each term of one block of terms."""
    if terms.empty or words.empty:
        return pd.DataFrame({
            "term": pd.Series(dtype=object), "word": pd.Series(dtype=object),
            "cosine": pd.Series(dtype=float), "k": pd.Series(dtype="int32")})
    cosines = np.round(_matrix(terms["term_vector"]) @ _matrix(words["vector"]).T, 9)
    names = words["word"].to_numpy()
    order_by_name, known, every = np.argsort(np.argsort(names)), set(names), np.arange(len(names))
    terms_of, words_of, near_of, ks = [], [], [], []
    for term, k, row in zip(terms["term"], terms["k"], cosines):
        others = np.flatnonzero(names != term) if term in known else every
        if k < len(others):
            # Only words as near as the k-th nearest are sorted.
            least = np.partition(row[others], len(others) - k)[len(others) - k]
            others = others[row[others] >= least]
        best = others[np.lexsort((order_by_name[others], -row[others]))][:k]
        terms_of += [term] * len(best)
        words_of.append(names[best])
        near_of.append(row[best])
        ks += [k] * len(best)
    # One frame for the block: a frame for each term would cost more than its search.
    return pd.DataFrame({"term": pd.Series(terms_of, dtype=object), "word": np.concatenate(words_of), "cosine": np.concatenate(near_of), "k": ks})


def nearest_words(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """(term, word, cosine, rank) for the `k` nearest other words of each term; `terms` has term and
    k, one row per term, `vectors` has word and vector.

    Exact search in tiles: terms and words are dealt into blocks, each pair of blocks is one matrix
    product in one task, and only the best k of a tile leave it."""
    vectors = vectors.select("word", "vector")
    terms = terms.filter(F.col("k") > 0)
    # Two counts over a vocabulary-sized table set the number of blocks.
    n_terms = terms.count()
    if not n_terms:
        return terms.sparkSession.createDataFrame([], "term string, word string, cosine double, rank int")
    word_blocks = max(1, -(-vectors.count() // ROWS_PER_BLOCK))
    term_blocks = max(1, -(-n_terms // ROWS_PER_BLOCK))

    def own(column: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(blocks))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))

    left = (
        terms.join(vectors.select(F.col("word").alias("term"), F.col("vector").alias("term_vector")), "term")
        .withColumn("i", own("term", term_blocks)).withColumn("j", every(word_blocks))
    )
    right = vectors.withColumn("j", own("word", word_blocks)).withColumn("i", every(term_blocks))
    tiles = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(
        _block_neighbours, _NEIGHBOURS)
    best = Window.partitionBy("term").orderBy(F.desc("cosine"), "word")
    return (
        tiles.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= F.col("k")).drop("k")
    )


def unknown_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows of `terms` whose term is not in the vocabulary."""
    return terms.join(vocabulary.select(F.col("word").alias("term")), "term", "left_anti")


def expand_terms(terms: DataFrame, vectors: DataFrame | None, scope: str = "scope") -> DataFrame:
    """(key columns..., term, matched): each term itself and, for a scope above 0, as many nearest
    words. Nearest words are looked up once per distinct term, for its largest scope."""
    itself = terms.withColumn("matched", F.col("term"))
    if vectors is None:
        return itself
    asked = terms.groupBy("term").agg(F.max(scope).cast("int").alias("k"))
    near = nearest_words(asked, vectors).select("term", F.col("word").alias("matched"), "rank")
    wider = terms.join(near, "term").filter(F.col("rank") <= F.col(scope)).drop("rank")
    return itself.unionByName(wider.select(*itself.columns))


def matched_terms(expanded: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, terms): the union of the expansions of a query's categories, sorted, each once. The set
    is bounded by the query's own categories and scope."""
    return expanded.groupBy(key).agg(F.sort_array(F.collect_set("matched")).alias("terms"))
