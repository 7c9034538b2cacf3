"""Merkle manifest of a dataset, by nested-interval labels.

Every node carries the interval [lo, hi) of leaf ranks that it covers, so a node lies below another if its interval
lies inside the other's, and no pointers are kept. Ranks come from a range partitioning and prefix sums of its counts.
Nodes are made a band of BAND levels at a time: a band's level bucket (lo divided by the width of the band's top) holds
at most FANOUT ** BAND nodes of the bottom level, so no group grows with the data and a large group of leaves is
spread over many buckets.

Proofs go from the top band down. Items are joined with the nodes of their band on (group, level bucket); of
these, at each level, the one whose interval contains the item is its ancestor. Its children outside the interval of the
ancestor below are the siblings: they lie in the difference of both intervals. A bucket's top node brings the path
from there to the root along, so a leaf's whole proof takes one join of the leaves.

A path is a row of steps, one for each level: how many siblings lie to the left and to the right (one byte each), and their
32-byte digests from left to right."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, spread, stored

FANOUT, BAND = 2, 10
NODES = "group string, level int, lo long, hi long, n long, digest binary"
_NODES = pa.schema([("group", pa.string()), ("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()),
                    ("n", pa.int64()), ("digest", pa.binary())])
#: Path rows stand beside the nodes of a bucket under this level.
_PATH = -1


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 over the columns, each as `-` if null, else its number of bytes, a colon and its text."""
    return F.sha2(F.concat(*map(_field, columns)).cast("binary"), 256)


def group_key(value: Column) -> Column:
    """A key without nulls that sorts like the value by bytes, null first."""
    return F.coalesce(F.concat(F.lit("+"), value.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with `lo` (rank of a row inside its `group` by `order`, from 0) and `n` (rows of the group); stored.

    `order` has to be total but for rows that are equal altogether."""
    at, part = fresh(rows, "at"), fresh(rows, "part")
    dealt = rows.repartitionByRange(spread(rows), "group", *order)
    placed = stored(dealt.sortWithinPartitions("group", *order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy("group", part).agg(F.min(at).alias("_first"), F.count("*").alias("_rows"))
    # A group has one row of counts for each partition that holds some of it.
    inside = Window.partitionBy("group")
    before = inside.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("group", part, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
                          F.sum("_rows").over(inside).alias("n"))
    return placed.join(bases, ["group", part]).withColumn("lo", F.col(at) + F.col("_base")).drop(at, part, "_base")


def _hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join([d.hex().encode() for d in digests])).digest()


def _grow(fanout: int, band: int):
    """The nodes of one bucket: the given ones of its bottom level and all above, up to the band's top."""

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, level = table.column("n")[0].as_py(), table.column("level")[0].as_py()
        lo = table.column("lo").to_numpy()
        order = np.argsort(lo)
        digests = table.column("digest").take(pa.array(order)).to_pylist()
        lows, width = lo[order].tolist(), fanout**level
        out = []
        for step in range(band + 1):
            out += [(level + step, a, min(a + width, n), d) for a, d in zip(lows, digests)]
            if width >= n or step == band:
                break
            width *= fanout
            runs = range(0, len(digests), fanout)
            digests, lows = [_hash(digests[i:i + fanout]) for i in runs], [lows[i] for i in runs]
        levels, lows, highs, digests = zip(*out)
        return pa.Table.from_arrays([
            pa.array([key[0].as_py()] * len(out), pa.string()), pa.array(levels, pa.int32()), pa.array(lows, pa.int64()),
            pa.array(highs, pa.int64()), pa.array([n] * len(out), pa.int64()), pa.array(digests, pa.binary())], schema=_NODES)

    return grow


def tree(leaves: DataFrame, fanout: int = FANOUT, band: int = BAND) -> list[DataFrame]:
    """The nodes of every group's tree, one stored table for each band of levels, from the bottom.

    `leaves` has group, lo, n and digest (binary); each group's ranks are 0 to n - 1. No leaves give no tables."""
    largest = leaves.agg(F.max("n")).first()[0]
    items = leaves.select("group", F.lit(0).alias("level"), "lo", "n", "digest")
    bands = []
    while largest is not None:
        base = band * len(bands)
        bucket = F.floor(F.col("lo") / F.lit(fanout ** (base + band))).alias("bucket")
        nodes = stored(items.groupBy("group", bucket).applyInArrow(_grow(fanout, band), NODES), "nodes")
        bands.append(nodes)
        top = base + band
        if largest <= fanout**top:
            break
        items = nodes.where((F.col("level") == top) & (F.col("n") > fanout**top)).select("group", "level", "lo", "n", "digest")
    return bands


def crowns(bands: list[DataFrame]) -> DataFrame:
    """(group, lo, n, digest): the node of each group that covers all its leaves."""
    top = [b.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))) for b in bands]
    out = top[0]
    for t in top[1:]:
        out = out.unionByName(t)
    return out.select("group", "n", "digest")


def _steps(lo: np.ndarray, nodes: dict[int, tuple[np.ndarray, np.ndarray, list[bytes]]]) -> list[bytes]:
    """For each item the steps from the band's bottom to its top: at each level the containing node, and the children of the
    next containing node outside of it."""
    paths = [bytearray() for _ in range(len(lo))]
    levels = sorted(nodes)
    for below, above in zip(levels, levels[1:]):
        (low, high, digests), (top_low, top_high, _) = nodes[below], nodes[above]
        own = np.searchsorted(low, lo, "right") - 1
        parent = np.searchsorted(top_low, lo, "right") - 1
        if np.any((own < 0) | (lo >= high[own]) | (parent < 0) | (lo >= top_high[parent])):
            raise ValueError("a node that covers an item is missing")
        first = np.searchsorted(low, top_low[parent], "left").tolist()
        behind = np.searchsorted(low, top_high[parent], "left").tolist()
        for path, k, a, b in zip(paths, own.tolist(), first, behind):
            path += bytes((k - a, b - k - 1))
            path += b"".join(digests[a:k] + digests[k + 1:b])
    return [bytes(p) for p in paths]


def _attach(finish):
    """Joins a bucket's items with its nodes; `finish(items, lo, paths, subroots)` makes the rows that are returned."""

    def attach(key: tuple[pa.Scalar, ...], items: pa.Table, nodes: pa.Table) -> pa.Table:
        level, low = nodes.column("level").to_numpy(), nodes.column("lo").to_numpy()
        high = nodes.column("hi").to_numpy()
        digest = nodes.column("digest").to_pylist()
        own = {}
        for k in sorted(set(level.tolist()) - {_PATH}):
            at = np.flatnonzero(level == k)
            at = at[np.argsort(low[at])]
            own[k] = (low[at], high[at], [digest[i] for i in at.tolist()])
        (above,) = np.flatnonzero(level == _PATH).tolist()
        crown = nodes.column("crown")[above].as_py()
        lo = items.column("lo").to_numpy()
        paths = [p + digest[above] for p in _steps(lo, own)] if items.num_rows else []
        return finish(items, lo, paths, crown)

    return attach


_UPPER = pa.schema([("group", pa.string()), ("lo", pa.int64()), ("path", pa.binary()), ("crown", pa.binary())])


def _upper(items: pa.Table, lo: np.ndarray, paths: list[bytes], crown: bytes) -> pa.Table:
    return pa.Table.from_arrays([items.column("group").combine_chunks(), pa.array(lo, pa.int64()), pa.array(paths, pa.binary()),
                                 pa.array([crown] * len(paths), pa.binary())], schema=_UPPER)


def attach_paths(leaves: DataFrame, bands: list[DataFrame], above: DataFrame, finish, schema: str,
                 fanout: int = FANOUT, band: int = BAND) -> DataFrame:
    """What `finish` makes of the leaves and their paths. `above` has for each group its `crown` (the digest of its top
    node) and the `path` from there on."""
    for k in reversed(range(len(bands))):
        nodes, base, width = bands[k], band * k, fanout ** (band * (k + 1))
        bucket = F.floor(F.col("lo") / F.lit(width))
        # A group's top node lies in this band if the group is no larger than a bucket of it, but larger than one below.
        ends = nodes.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).join(above, "group").select(
            "group", F.lit(0).cast("long").alias("lo"), "path", "crown")
        tops = ends if k + 1 == len(bands) else ends.unionByName(paths)
        tops = tops.select("group", F.lit(_PATH).alias("level"), "lo", F.col("lo").alias("hi"), F.col("path").alias("digest"), "crown")
        # Aliases part the columns of both sides, which come from one table above the lowest band.
        known = nodes.select(*[F.col(c).alias(c) for c in ("group", "level", "lo", "hi", "digest")],
                             F.lit(None).cast("binary").alias("crown")).unionByName(tops)
        items = leaves if k == 0 else nodes.where(F.col("level") == base).select("group", "lo")
        make, kind = (finish, schema) if k == 0 else (_upper, "group string, lo long, path binary, crown binary")
        joined = items.groupBy("group", bucket.alias("bucket")).cogroup(known.groupBy("group", bucket.alias("bucket")))
        paths = joined.applyInArrow(_attach(make), kind)
        if k:
            paths = stored(paths, "paths")
    return paths


def siblings(path: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    """The steps of a path: digests to the left and to the right, level by level."""
    out, at = [], 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        ends = [path[at + 2 + 32 * i:at + 34 + 32 * i] for i in range(left + right)]
        out.append((ends[:left], ends[left:]))
        at += 2 + 32 * (left + right)
    return out


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest leads to along a path."""
    for left, right in siblings(path):
        leaf = _hash([*left, leaf, *right])
    return leaf


def proof_digest(path: bytes) -> str:
    """Hex SHA-256 over the hex digests of a path."""
    return hashlib.sha256("".join(d.hex() for left, right in siblings(path) for d in left + right).encode()).hexdigest()


def _paths_only(items: pa.Table, lo: np.ndarray, paths: list[bytes], crown: bytes) -> pa.Table:
    return pa.table({"group": items.column("group").combine_chunks(), "path": pa.array(paths, pa.binary())})


def manifest(leaves: DataFrame, order: list[Column], fanout: int = FANOUT,
             band: int = BAND) -> tuple[DataFrame, list[DataFrame], DataFrame, str | None]:
    """(leaves with lo and n, bands of nodes, groups with crown and path, root) for rows with `group` and `digest`.

    Each group is a tree over its leaves, `fanout` consecutive nodes to a parent; the groups' tops, ordered by group, are the
    leaves of a tree above. The root is hex; no rows give no bands and root None."""
    placed = ranked(leaves, order)
    bands = tree(placed, fanout, band)
    if not bands:
        return placed, bands, placed.select("group", F.col("digest").alias("crown"), F.col("digest").alias("path")), None
    top = crowns(bands).select("group", "digest")
    tops = ranked(top.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"), [F.col("name")])
    above = tree(tops, fanout, band)
    root = crowns(above).first()["digest"]
    end = tops.select("group").distinct().select(
        "group", F.lit(b"").alias("path"), F.lit(root).alias("crown"))

    def named(items, lo, paths, crown):
        return pa.table({"group": items.column("name").combine_chunks(), "crown": items.column("digest").combine_chunks(),
                         "path": pa.array(paths, pa.binary())})

    groups = attach_paths(tops.select("group", "lo", "name", "digest"), above, end, named,
                          "group string, crown binary, path binary", fanout, band)
    return placed, bands, stored(groups, "groups"), bytes(root).hex()


def _checked(root: str):
    def check(items: pa.Table, lo: np.ndarray, paths: list[bytes], crown: bytes) -> pa.Table:
        leaves, forged = items.column("digest").to_pylist(), items.column("forged").to_pylist()
        folded = [fold(bad or leaf, p).hex() for leaf, bad, p in zip(leaves, forged, paths)]
        return pa.table({
            "doc_id": items.column("doc_id").combine_chunks(), "leaf": pa.array([d.hex() for d in leaves], pa.string()),
            "subroot": pa.array([crown.hex()] * len(leaves), pa.string()), "root": pa.array([root] * len(leaves), pa.string()),
            "proof_sha256": pa.array([proof_digest(p) for p in paths], pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_())})

    return check


def digest(docs: DataFrame, fanout: int = FANOUT, band: int = BAND) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document; see the module.

    Nulls are hashed as `-`; rows with a null language are a group of their own, before all others, rows with a null id
    come first in their group. Rows with equal ids are ordered by their leaf; equal rows are leaves of their own. Folding takes the
    leaf with n_chars one higher where 7 divides the crc32 of the id. An empty table gives no rows."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    own = [F.col(c) for c in names]
    forged = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("lang")).alias("group"),
        F.unhex(leaf_digest(own)).alias("digest"), F.when(chosen, F.unhex(leaf_digest(forged))).alias("forged")), "leaves")
    placed, bands, groups, root = manifest(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest")], fanout, band)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not bands:
        return docs.sparkSession.createDataFrame([], schema)
    items = placed.select("group", "lo", "doc_id", "digest", "forged")
    return attach_paths(items, bands, groups, _checked(root), schema, fanout, band)
