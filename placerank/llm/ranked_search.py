"""Ranked lexical search by the Best Position Algorithm.

The benchmark items are the stated query set; they go out in blocks of bounded size. One pass over the documents
counts each document's terms and keeps its frequencies of the block's terms; corpus statistics come from all of
them. The stored frequencies are then cut into shards of bounded size, wherever they lie, so nothing is shuffled but
each task's best documents.

A shard has an impact list for each term: its documents by falling impact, with direct access to a document's impact and
position. A search reads the lists in rounds from their best positions on, completes every new document by
direct accesses to all lists, and marks the positions at which it stands as seen. A list's best position is
the end of its unbroken run of seen positions; no unseen document stands before it, so the impacts at the best positions
add up to a bound on every unseen score. The search stops once that bound is strictly below the k-th best score, so documents
with an equal score are all seen and their ids decide."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import share, shared, stored, texts
from .decontaminate import words

K, STEP, SHARD_POSTINGS, BLOCK_BYTES = 10, 64, 4_000_000, 2_000_000
#: How many parts the tasks' best documents of an item are ranked in before the last ranking.
SLICES = 64
_SEEN = "doc_id long, n long, terms array<int>, counts array<int>"
_N, _LENGTH = -1, -2


class Block:
    """A block of items: its terms, numbered, and its distinct bags of terms with the ids of their items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.number: dict[bytes, int] = {}
        bags: dict[tuple, list] = {}
        for item_id, text in items:
            own = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            if own:
                ids, counts = np.unique(own, return_counts=True)
                bags.setdefault((tuple(ids.tolist()), tuple(counts.tolist())), []).append(item_id)
        self.bags = [tuple(np.array(x, np.int64) for x in bag) for bag in bags]
        self.items = list(bags.values())


def _count_terms(block, id_col: str, text_col: str):
    """Of each document the number of its terms, and the frequencies of the block's terms in it."""

    def count(batches):
        number = shared(block).number
        get, size = number.get, max(1, len(number))
        for batch in batches:
            lengths, known = [], []
            for i, text in enumerate(texts(batch, text_col)):
                own = words(text)
                lengths.append(len(own))
                ids = np.fromiter((get(w, -1) for w in own), np.int64, len(own))
                known.append(ids[ids >= 0] + i * size)
            code, counts = np.unique(np.concatenate(known) if known else np.empty(0, np.int64), return_counts=True)
            edges = pa.array(np.searchsorted(code, np.arange(batch.num_rows + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(v.astype(np.int32))) for v in (code % size, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(lengths, pa.int64()), *lists],
                                             names=["doc_id", "n", "terms", "counts"])

    return count


def _totals(batches):
    """The task's sums: documents with a term, their terms, documents that hold each of the block's terms."""
    n = length = 0
    frequency = np.zeros(0, np.int64)
    for batch in batches:
        own = batch.column("n").to_numpy()
        n, length = n + int((own > 0).sum()), length + int(own.sum())
        more = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(frequency)).astype(np.int64)
        more[:len(frequency)] += frequency
        frequency = more
    on = np.flatnonzero(frequency)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(([_N, _LENGTH], on)), pa.int64()), pa.array(np.concatenate(([n, length], frequency[on])), pa.int64())],
        names=["key", "total"])


class ImpactList:
    """One term's documents in a shard: by number for direct access, by falling impact for reading."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts = docs, impacts
        self.order = np.lexsort((docs, -impacts))
        self.position = np.empty(len(docs), np.int64)
        self.position[self.order] = np.arange(len(docs))


class Best:
    """The k best (score, id) so far: highest score first, then smallest id, rows without an id last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        """The k-th score, or the least that counts while there are fewer."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = self.rows + list(zip(scores.tolist(), ids))
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:self.k]


class Shard:
    """Impact lists over a run of documents."""

    def __init__(self, ids: list, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, per_doc: np.ndarray,
                 weights: np.ndarray, n_docs: int, n_terms: int):
        # In whole numbers of any size, as the product may pass 64 bits before it is divided.
        length_part = np.array([100 - 75 + 75 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
        doc = np.repeat(np.arange(len(ids)), per_doc)
        order = np.lexsort((doc, terms))
        self.ids, self.weights = ids, weights
        self.doc, terms, tf = doc[order], terms[order], counts[order].astype(np.int64)
        self.impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length_part[self.doc]))
        self.edge = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.lists: dict[int, ImpactList] = {}

    def list_of(self, term: int) -> ImpactList:
        if term not in self.lists:
            a, b = self.edge[term], self.edge[term + 1]
            self.lists[term] = ImpactList(self.doc[a:b], self.impact[a:b])
        return self.lists[term]

    def search(self, terms: np.ndarray, repeats: np.ndarray, best: Best, step: int = STEP) -> int:
        """Puts the shard's best documents for a bag of terms into `best`; returns how many documents it looked at."""
        held = [i for i, t in enumerate(terms.tolist()) if self.weights[t] > 0 and self.edge[t] < self.edge[t + 1]]
        lists = [self.list_of(int(terms[i])) for i in held]
        times = [int(repeats[i]) for i in held]
        seen = [np.zeros(len(x.docs), bool) for x in lists]
        best_position = [0] * len(lists)
        known = np.zeros(len(self.ids), bool)
        while True:
            read = [x.order[p:p + step][~s[p:p + step]] for x, p, s in zip(lists, best_position, seen)]
            fresh = np.unique(np.concatenate([x.docs[r] for x, r in zip(lists, read)])) if lists else np.empty(0, np.int64)
            fresh = fresh[~known[fresh]]
            known[fresh] = True
            scores = np.zeros(len(fresh), np.int64)
            for x, s, c in zip(lists, seen, times):
                at = np.minimum(np.searchsorted(x.docs, fresh), len(x.docs) - 1)
                on = x.docs[at] == fresh
                at = at[on]
                scores[on] += c * x.impacts[at]
                s[x.position[at]] = True
            good = np.flatnonzero(scores >= best.floor())
            if len(good) > best.k:
                good = good[scores[good] >= np.partition(scores[good], -best.k)[-best.k]]
            if len(good):
                best.add(scores[good], [self.ids[fresh[i]] for i in good.tolist()])
            bound = 0
            for i, (x, s) in enumerate(zip(lists, seen)):
                rest = s[best_position[i]:]
                gap = int(np.argmin(rest)) if len(rest) else 0
                best_position[i] += gap if gap or not (len(rest) and rest[0]) else len(rest)
                if best_position[i] < len(x.docs):
                    bound += times[i] * int(x.impacts[x.order[best_position[i] - 1]])
            if bound < best.floor():
                return int(known.sum())
            step *= 2


def _search(block, k: int, weights: np.ndarray, n_docs: int, n_terms: int, postings: int):
    def search(batches):
        bags, held, size = shared(block).bags, [], 0
        best = [Best(k) for _ in bags]

        def run():
            columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(4)]
            shard = Shard(columns[0].to_pylist(), columns[1].to_numpy(), columns[2].flatten().to_numpy(), columns[3].flatten().to_numpy(),
                          columns[2].value_lengths().to_numpy(), weights, n_docs, n_terms)
            for (terms, repeats), own in zip(bags, best):
                shard.search(terms, repeats, own)

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= postings:
                run()
                held, size = [], 0
        if held:
            run()
        rows = [(i, score, doc_id) for i, b in enumerate(best) for score, doc_id in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["bag", "score", "doc_id"])

    return search


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item id, rank, doc_id, score): each item's `k` best documents with a score above 0, best first, equal scores by
    ascending id, rows without an id last.

    Null or termless texts have no terms: such documents are found by nothing and count for no statistic, such items
    find nothing. Rows with equal ids stay documents of their own; repeated rows of items count once, items with equal ids and
    different texts are answered each. Empty tables give no rows. Runs jobs when called."""
    spark, kind = docs.sparkSession, items.schema[item_col].dataType
    asked = items.where(F.col(item_text_col).isNotNull()).select(
        F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text")).distinct()
    n_blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_bytes))
    rows = docs.select(id_col, text_col)
    out = spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, doc_id long, score long")
    for j in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == j).collect()
        found = Block(sorted(((r["item"], bytes(r["text"])) for r in own), key=lambda r: (r[1], str(r[0]))))
        if not found.bags:
            continue
        block = share(spark, found)
        counted = stored(rows.mapInArrow(_count_terms(block, id_col, text_col), _SEEN), "frequencies")
        sums = {r["key"]: r["total"] for r in counted.select("n", "terms").mapInArrow(
            _totals, "key long, total long").groupBy("key").agg(F.sum("total").alias("total")).collect()}
        n_docs, n_terms = sums.get(_N, 0), sums.get(_LENGTH, 0)
        if not n_docs:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sums.get(t, 0) + 1)))
                            for t in range(len(found.number))], np.int64)
        tops = counted.where("n > 0").mapInArrow(
            _search(block, k, weights, n_docs, n_terms, postings), "bag long, score long, doc_id long")
        best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))
        ranked = tops.withColumn("part", part).withColumn(
            "rank", F.row_number().over(Window.partitionBy("bag", "part").orderBy(*best_first))).where(F.col("rank") <= k).withColumn(
            "rank", F.row_number().over(Window.partitionBy("bag").orderBy(*best_first))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, ids in enumerate(found.items) for item in ids],
                                      f"bag long, `{item_col}` {kind.simpleString()}")
        out = out.unionByName(ranked.join(names, "bag").select(item_col, "rank", "doc_id", "score"))
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ten best documents."""
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))
