"""Near-duplicates by MinHash with tensored banding.

Texts with equal shingle sets are one class. A class has two collections of COLLECTION half keys, each the pair of two
minhashes; a table key combines a half key of the first collection with one of the second, so 2 * COLLECTION half keys make
COLLECTION ** 2 tables, each over four minhashes, for the square root of the minhashes that separate tables would take. A
pair of similarity s is missed if it agrees in no half key of one of the collections: with at most 2 * (1 - s**2) **
COLLECTION, which is 7e-5 at s = 0.8 and 1e-7 at 0.9.

In each bucket all classes are first set against one of them, the hub, by their signatures: those that agree with it in LOOSE of
all minhashes are tied to it loosely, those that agree in less than FAR stay. What stays in a bucket is compared pair by pair
in tiles with numpy, once for all buckets that hold the same classes. The share of minhashes that agree obeys the triangle
inequality, so two classes that were not compared, as one is near the hub and the other far from it, differ in at
least FAR - LOOSE of all minhashes, and a pair of similarity 0.8 does so with a chance of about 1e-4.

Loose clusters are then verified on whole shingle sets: a cluster is cut into tiles of bounded size, a pair of tiles gives
exact sizes of all intersections by products of incidence matrices, and a spanning forest of its links is kept. In a
large cluster each tile is first compared with itself and with the first tile. Who is not linked there with the largest component
of the first tile is then compared with all tiles, so links are complete without comparing all tiles of a hot group."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts, unsent
from .components import connected_components

WIDTH, LINK, COLLECTION, ROWS = 2, 80, 10, 2
#: Shares of agreeing minhashes: with its hub, from LOOSE on and below FAR; of a pair that was compared, from NEAR on.
LOOSE, FAR, NEAR = 0.3, 0.75, 0.5
TILE_SHINGLES, TILE_ROWS, _SLICE = 200_000, 1024, 1 << 12
_KNOWN_WORDS = 200_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_29, _32 = np.uint64(29), np.uint64(32)


class _Words(dict):
    """64-bit hashes of words, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        self[word] = out = xxh3_64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _32)) * _B
    x = (x ^ (x >> _29)) * _C
    return x ^ (x >> _32)


def shingles(text: bytes | None, known: dict, width: int = WIDTH) -> np.ndarray:
    """A text's distinct word shingles as ascending 64-bit hashes; of fewer words than `width` the whole sequence is one."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * _A + h[i:len(h) - size + 1 + i])
    return np.unique(out)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _A)
    return seeds[:n], seeds[n:] | np.uint64(1)


def half_keys(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n half keys of each set (rows without shingles: 0): ROWS minhashes of 32 bits side by side."""
    flips, factors = _multipliers(n * ROWS)
    out = np.zeros((len(sets), n), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out.view(np.int64)
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    for k in range(n):
        for r in range(ROWS):
            flip, factor = flips[k * ROWS + r], factors[k * ROWS + r]
            least = np.minimum.reduceat((flat ^ flip) * factor, starts) >> _32
            out[full, k] = (out[full, k] << _32) | least
    return out.view(np.int64)


def _signatures(id_col: str, text_col: str, key: str, width: int, n: int):
    """Id, text key, number of shingles, 128-bit hash of the set and half keys of each row."""

    def run(batches):
        from xxhash import xxh3_128_digest

        known = _Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                if len(known) > _KNOWN_WORDS:
                    known.clear()
                sets = [shingles(t, known, width) for t in texts(some, text_col)]
                halves = half_keys(sets, n)
                edges = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([
                    some.column(id_col).cast(pa.int64()), some.column(key), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(edges, pa.array(halves.reshape(-1)))],
                    names=["doc_id", "text_key", "n", "set_hash", "halves"])

    return run


def table_keys(classes: DataFrame, collection: int) -> DataFrame:
    """(key, node): the tables' keys, each a half key of the first collection with one of the second."""
    first = F.posexplode(F.slice("halves", 1, collection)).alias("i", "a")
    second = F.posexplode(F.slice("halves", collection + 1, collection)).alias("j", "b")
    pairs = classes.select("node", "halves", first).select("node", "i", "a", second)
    return pairs.select(F.xxhash64("i", "a", "j", "b").alias("key"), "node")


def _agreement(batches):
    """The share of minhashes in which both classes of a pair agree."""
    for batch in batches:
        a, b = (batch.column(c).flatten().to_numpy().view(np.uint32).reshape(batch.num_rows, -1) if batch.num_rows
                else np.zeros((0, 1), np.uint32) for c in ("halves", "hub_halves"))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub"), pa.array((a == b).mean(axis=1) if len(a) else [], pa.float64())],
                                         names=["node", "hub", "share"])


def _close(batches):
    """Links of each block of classes with equal (key, i, j) that agree in a share of NEAR of their minhashes: rows of side 0 against
    those of side 1, or all with all."""

    def compare(held):
        signature = np.stack([r[2] for r in held])
        nodes, side = np.array([r[0] for r in held]), np.array([r[1] for r in held])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(b):
            b = a
        elif not len(a):
            return []
        linked = np.zeros((len(held), len(held)), bool)
        for lo in range(0, len(a), 64):
            rows = a[lo:lo + 64]
            same = np.zeros((len(rows), len(b)), np.int16)
            for k in range(signature.shape[1]):
                same += signature[rows, k][:, None] == signature[b, k][None, :]
            linked[np.ix_(rows, b)] = same >= NEAR * signature.shape[1]
        linked |= linked.T
        return [(int(nodes[x]), int(nodes[y])) for x, y in _spanning(linked) if nodes[x] != nodes[y]]

    held, at = [], None
    for batch in batches:
        halves = batch.column("halves").flatten().to_numpy().view(np.uint32).reshape(batch.num_rows, -1) if batch.num_rows else []
        out = []
        keys = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")))
        for key, node, side, own in zip(keys, batch.column("node").to_pylist(), batch.column("side").to_pylist(), halves):
            if key != at:
                out += compare(held) if len(held) > 1 else []
                held, at = [], key
            held.append((node, side, own))
        yield _pairs(out)
    if len(held) > 1:
        yield _pairs(compare(held))


def loose_links(classes: DataFrame, collection: int = COLLECTION, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) of classes (node, halves) that share a bucket and seem similar; see the module."""
    members, signature = table_keys(classes, collection), classes.select("node", "halves")
    hubs = signature.select(F.col("node").alias("hub"), F.col("halves").alias("hub_halves"))
    shared = members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = stored(members.join(unsent(shared), "key").where("node != hub"), "starred")
    pairs = starred.select("node", "hub").distinct()
    compared = pairs.join(unsent(signature), "node").join(unsent(hubs), "hub").select("node", "hub", "halves", "hub_halves")
    compared = stored(compared.mapInArrow(_agreement, "node long, hub long, share double"), "compared")
    near = compared.where(F.col("share") >= LOOSE).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    rest = stored(starred.join(unsent(compared.where(F.col("share") < FAR)), ["node", "hub"]).select("key", "node"), "rest")
    # Buckets with the same classes are known by number, sum and exclusive-or of their hashes; one of them is compared.
    h = F.xxhash64("node")
    buckets = rest.groupBy("key").agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.bit_xor(h).alias("x"))
    chosen = buckets.where("n > 1").groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", F.ceil(
        F.col("n") / F.lit(tile_rows)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node", "key"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    blocks = rest.join(unsent(chosen), "key").withColumn("tile", tile).withColumn("other", other).select(
        "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", (F.col("tile") > F.col("other")).cast("int").alias("side"))
    dealt = blocks.join(unsent(signature), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return near.unionByName(dealt.select("key", "i", "j", "node", "side", "halves").mapInArrow(_close, "a long, b long"))


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of `a` with those of `b`."""
    flat = np.concatenate(a + b)
    values, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    # Only shingles that both sides have add to an intersection.
    left = row < len(a)
    common = np.zeros((2, len(values)), bool)
    common[0, column[left]] = True
    common[1, column[~left]] = True
    number = np.cumsum(common[0] & common[1]) - 1
    keep = (common[0] & common[1])[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, _SLICE):
        i, j = np.searchsorted(column, (lo, lo + _SLICE))
        part = np.zeros((len(a) + len(b), min(_SLICE, int(number[-1]) + 1 - lo)), np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        out += part[:len(a)] @ part[len(a):].T
    return out.astype(np.int64)


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric matrix of links connects."""
    left, edges = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        if not left[i]:
            continue
        left[i], todo = False, [i]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & left)
            left[new] = False
            todo += new.tolist()
            edges += [(x, y) for y in new.tolist()]
    return edges


def _verify(link: int, across: bool):
    """For each row of a block (rows with equal cluster, i, j) its root, the least node that links of the block lead to, and whether
    they lead to the largest component of the rows of side 0. With `across` only rows of different sides are compared."""

    def verify_block(rows):
        nodes, side = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets], np.int64)
        a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(len(rows)),) * 2
        if not len(a) or not len(b):
            return []
        inter = _intersections([sets[i] for i in a], [sets[i] for i in b])
        linked = np.zeros((len(rows), len(rows)), bool)
        linked[np.ix_(a, b)] = 100 * inter >= link * (size[a][:, None] + size[b][None, :] - inter)
        linked |= linked.T
        label, first = _labels(linked), np.flatnonzero(side == 0)
        # The largest component of side 0 by itself, so that all blocks with the same rows there agree on it.
        alone = _labels(linked[np.ix_(first, first)])
        held = first[alone == np.argmax(np.bincount(alone))] if len(first) else first
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, label, nodes)
        major = np.isin(label, label[held])
        return list(zip(nodes.tolist(), least[label].tolist(), major.tolist()))

    def run(batches):
        held, at = [], None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")))
            out = []
            for key, node, side, own in zip(keys, *(batch.column(c).to_pylist() for c in ("node", "side", "shingles"))):
                if key != at:
                    out += verify_block(held) if len(held) > 1 else []
                    held, at = [], key
                held.append((node, side, own))
            yield _rooted(out)
        if len(held) > 1:
            yield _rooted(verify_block(held))

    return run


def _labels(linked: np.ndarray) -> np.ndarray:
    """The number of the component of each row of a symmetric matrix of links."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] >= 0:
            continue
        label[i], todo = i, [i]
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & (label < 0))
            label[new] = i
            todo += new.tolist()
    return label


def _rooted(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["a", "b", "major"])


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _linked(blocks: DataFrame, link: int, across: bool) -> DataFrame:
    """Stored rows (a, b, major) of the blocks (cluster, i, j, side, node, shingles); see `_verify`."""
    dealt = blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return stored(dealt.select("cluster", "i", "j", "side", "node", "shingles").mapInArrow(
        _verify(link, across), "a long, b long, major boolean"), "links")


def _set_of(text_col: str, width: int, keep: list[str]):
    def run(batches):
        known = _Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                if len(known) > _KNOWN_WORDS:
                    known.clear()
                sets = pa.array([shingles(t, known, width).tobytes() for t in texts(some, text_col)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), sets], names=[*keep, "shingles"])

    return run


def verified(tiled: DataFrame, link: int = LINK) -> DataFrame:
    """(node, root) for linked classes; `tiled` has cluster, tile, tiles, node and shingles."""
    tile, tiles = F.col("tile"), F.col("tiles")
    # A block for each tile but the first, which is side 0 of all of them; a cluster of one tile is one block.
    others = F.when(tiles == 1, F.array(F.lit(0))).when(tile == 0, F.sequence(F.lit(1), F.greatest(tiles - 1, F.lit(1)))).otherwise(F.array(tile))
    first = tiled.select("cluster", "node", "shingles", F.lit(0).alias("i"), F.explode(others).alias("j"), (tile > 0).cast("int").alias("side"))
    links = _linked(first, link, False)
    large = tiled.where("tiles > 2")
    joined = links.groupBy(F.col("a").alias("node")).agg(F.max("major").alias("major"))
    counted = large.select("cluster", "node").join(unsent(joined.where("major")), "node", "left").groupBy("cluster").agg(
        F.count("*").alias("all"), F.count("major").alias("joined")).where(F.col("all") > F.col("joined"))
    edges = links.select("a", "b")
    if not counted.isEmpty():
        # As many tiles for those apart as their share of the cluster asks for.
        share = large.select("cluster", "tiles").distinct().join(counted, "cluster").select("cluster", F.ceil(
            F.col("tiles") * (F.col("all") - F.col("joined")) / F.col("all")).cast("int").alias("apart"))
        placed = large.join(share, "cluster").join(unsent(joined), "node", "left").withColumn("major", F.coalesce("major", F.lit(False)))
        # Each row is on side 1, in its own tile; those apart are on side 0 too.
        sides = F.when(F.col("major"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
        own = F.pmod(F.xxhash64("node", "cluster"), F.col("apart")).cast("int")
        twice = placed.withColumn("side", F.explode(sides)).withColumn("row", own)
        across = F.when(F.col("side") == 1, F.transform(F.sequence(F.lit(0), F.col("apart") - 1), lambda i: F.struct(
            i.alias("i"), tile.alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.struct(
                F.col("row").alias("i"), j.alias("j"))))
        edges = edges.unionByName(_linked(twice.select("cluster", "node", "shingles", "side", F.inline(across)), link, True).select("a", "b"))
    return connected_components(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, link: int = LINK,
                    collection: int = COLLECTION, tile_shingles: int = TILE_SHINGLES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its shingle set, and the smallest id that links lead to.

    Two rows are linked if `link` hundredths of their sets' union is common. Null and wordless texts have an empty set and are linked
    with nothing, so their component is their own id. Null ids count for no minimum: a component of nothing else has
    none. Rows with equal ids stay rows of their own. An empty table gives no rows. Other columns are ignored. Runs jobs."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    schema = "doc_id long, text_key long, n long, set_hash binary, halves array<long>"
    rows = stored(keyed.mapInArrow(_signatures("doc_id", "text", "text_key", width, 2 * collection), schema), "signatures")
    # One row stands for a class: the smallest id, or a row without one if no other is there.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = rows.where("n > 0").groupBy("set_hash").agg(
        F.min("doc_id").alias("first"), F.min(rank).alias("row"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    clusters = stored(connected_components(loose_links(classes, collection, tile_rows)), "clusters")
    asked = clusters.withColumnRenamed("root", "cluster").join(
        unsent(classes.select("node", "n", F.col("row.doc_id").alias("doc_id"), F.col("row.text_key").alias("text_key"))), "node")
    totals = asked.groupBy("cluster").agg(F.greatest(
        F.ceil(F.sum("n") / F.lit(tile_shingles)), F.ceil(F.count("*") / F.lit(tile_rows))).cast("int").alias("tiles"))
    placed = asked.join(totals, "cluster").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    placed = placed.withColumnRenamed("doc_id", "own_id")
    texts_of = keyed.join(unsent(placed), "text_key").where(F.col("doc_id").eqNullSafe(F.col("own_id")))
    kept = ["cluster", "tile", "tiles", "node"]
    tiled = stored(texts_of.select(*kept, "text").dropDuplicates(["node"]).mapInArrow(
        _set_of("text", width, kept), "cluster long, tile int, tiles int, node long, shingles binary"), "tiles")
    linked = verified(tiled, link)
    rooted = classes.select("set_hash", "first", "node").join(unsent(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_set = rooted.select("set_hash", "root").join(least, "root").select("set_hash", "component_id")
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_hash")).alias("set_hash"))
    return own.join(unsent(by_set), "set_hash", "left").select("doc_id", "n_shingles", F.when(
        F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document. A row without an id is kept where no row of its component
    has one."""
    return near_duplicates(docs.select("doc_id", "text")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
